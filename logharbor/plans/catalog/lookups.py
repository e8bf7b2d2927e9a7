"""Joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor.functions.text import strip_prefix
from logharbor.operators import joins, policy
from logharbor.plans.catalog.base import Tables, query


@query(
    "j01_chained_joins",
    "SELECT o_orderkey, c_name, n_name FROM orders INNER JOIN customer c ON o_custkey = c.c_custkey AND c.c_acctbal >= 0"
    " LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey <> 1",
)
def j01(t: Tables):
    return joins.chain_join(
        t.orders, "orders",
        [
            ("INNER JOIN", "c", t.customer, "orders.o_custkey = c.c_custkey AND c.c_acctbal >= 0"),
            ("LEFT JOIN", "n", t.nation, "n.n_nationkey = c.c_nationkey AND n.n_regionkey <> 1"),
        ],
    ).select("o_orderkey", "c_name", "n_name")


@query(
    "j02_dictionary_details",
    "SELECT r_name, c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
def j02(t: Tables):
    dictionary = t.region.filter("r_name = 'ASIA'")
    details = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return details.join(dictionary, F.col("n_regionkey") == F.col("r_regionkey"), "inner").select("r_name", "c_custkey", "c_name")


@query(
    "j03_belongs_to",
    "SELECT o_orderkey, c_name AS owner_name, c_mktsegment AS owner_segment FROM orders LEFT JOIN"
    " (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey",
)
def j03(t: Tables):
    out = joins.attach_one(t.orders, t.customer.filter("c_acctbal > 0"), "o_custkey", "c_custkey", "owner")
    return out.select("o_orderkey", F.col("owner.c_name").alias("owner_name"), F.col("owner.c_mktsegment").alias("owner_segment"))


@query(
    "j04_has_many",
    "SELECT c_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS position, o_orderkey"
    " FROM customer JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey"
    " UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN"
    " (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def j04(t: Tables):
    out = joins.attach_many(
        t.customer.select("c_custkey"), t.orders.filter("o_orderstatus = 'F'"), "c_custkey", "o_custkey",
        ["o_orderdate", "o_orderkey"], "order",
    )
    return out.select("c_custkey", "position", F.col("order_o_orderkey").alias("o_orderkey"))


@query(
    "j05_many_to_many",
    "WITH d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"
    " SELECT p_partkey, CASE WHEN s_name IS NOT NULL THEN row_number() OVER (PARTITION BY p_partkey ORDER BY s_name) - 1 END AS position,"
    " s_name AS supplier FROM part LEFT JOIN (SELECT l_partkey, s_name FROM d JOIN supplier ON l_suppkey = s_suppkey)"
    " ON l_partkey = p_partkey",
)
def j05(t: Tables):
    links = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"))
    out = joins.attach_linked(t.part.select("p_partkey"), links, t.supplier, "p_partkey", "s_suppkey", ["s_name"], "supplier")
    return out.select("p_partkey", "position", F.col("supplier_s_name").alias("supplier"))


@query(
    "j06_linked_rows",
    "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
)
def j06(t: Tables):
    links = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.linked_to(t.customer, links, "c_custkey").select("c_custkey", "c_name")


@query(
    "j07_compound_semi",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem m"
    " WHERE m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey AND m.l_returnflag = 'R' AND m.l_linestatus = 'F')",
)
def j07(t: Tables):
    granted = t.lineitem.filter("l_returnflag = 'R' AND l_linestatus = 'F'").select("l_partkey", "l_suppkey")
    return joins.linked_to(t.lineitem, granted, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "j08_compound_anti",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem m"
    " WHERE m.l_partkey = l.l_partkey AND m.l_suppkey = l.l_suppkey AND m.l_returnflag = 'A')",
)
def j08(t: Tables):
    ignored = t.lineitem.filter("l_returnflag = 'A'").select("l_partkey", "l_suppkey")
    return joins.without(t.lineitem, ignored, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "j09_subset_offenders",
    "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def j09(t: Tables):
    permitted = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.offenders(t.orders, permitted, "o_custkey")


@query(
    "j10_labels",
    "SELECT c_custkey, coalesce(n_name, '') AS label, concat(coalesce(n_name, '-'), '/', coalesce(s_name, '-')) AS labels"
    " FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON n_nationkey = c_nationkey LEFT JOIN"
    " (SELECT n_nationkey AS k2, n_name AS s_name FROM nation WHERE n_regionkey <> 3) ON k2 = 24 - c_nationkey",
)
def j10(t: Tables):
    labels = t.nation.filter("n_regionkey <> 3").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    rows = t.customer.select(
        "c_custkey", F.col("c_nationkey").alias("code"), F.array(F.col("c_nationkey"), 24 - F.col("c_nationkey")).alias("codes")
    )
    one = joins.with_label(rows, labels, "code", "label")
    many = joins.with_labels(one.drop("code").withColumnRenamed("label", "single"), "c_custkey", "codes", labels, "label", "names")
    return many.select("c_custkey", F.col("single").alias("label"), F.array_join("names", "/", "-").alias("labels"))


PATH_SQL = "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"


def request_rows(t: Tables):
    """Page requests: the language is the role, the scheme is the method."""
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    return t.pages.select(
        "page_id",
        F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1).alias("role"),
        strip_prefix(F.concat(F.lit("/api"), path), "/api").alias("path"),
        F.regexp_extract("url", "^([a-z]+):", 1).alias("method"),
    )


def policy_rows(t: Tables):
    """Policies drawn from the pages: exact paths, :id patterns per language, and a wildcard for http."""
    requests = request_rows(t)
    exact = requests.filter("path LIKE '%.html'").select("role", "path", "method")
    params = requests.filter("method = 'https'").select("role", F.format_string("/%s/:id", "role").alias("path"), "method")
    wild = requests.filter("method = 'http' AND role <> 'en'").select("role", F.format_string("/%s/*", "role").alias("path"), "method")
    return exact.unionByName(params).unionByName(wild).distinct()


_REQUESTS = (
    f"SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS role, {PATH_SQL} AS path,"
    " regexp_extract(url, '^([a-z]+):', 1) AS method FROM pages"
)


@query(
    "j11_path_policies",
    f"""WITH r AS ({_REQUESTS}), p AS (
      SELECT DISTINCT role, path, method FROM r WHERE path LIKE '%.html'
      UNION SELECT role, concat('/', role, '/:id'), method FROM r WHERE method = 'https'
      UNION SELECT role, concat('/', role, '/*'), method FROM r WHERE method = 'http' AND role <> 'en')
    SELECT r.page_id, r.path, p.path AS pattern FROM r JOIN p ON r.role = p.role AND r.method = p.method
      AND regexp_full_match(r.path, regexp_replace(replace(p.path, '/*', '/.*'), ':[^/]+', '[^/]+', 'g'))""",
)
def j11(t: Tables):
    return policy.match_policies(request_rows(t), policy_rows(t)).select("page_id", "path", "pattern")


@query(
    "j11_allowed_requests",
    f"""WITH r AS ({_REQUESTS}), p AS (
      SELECT DISTINCT role, path, method FROM r WHERE path LIKE '%.html'
      UNION SELECT role, concat('/', role, '/:id'), method FROM r WHERE method = 'https'
      UNION SELECT role, concat('/', role, '/*'), method FROM r WHERE method = 'http' AND role <> 'en')
    SELECT r.page_id, EXISTS (SELECT 1 FROM p WHERE r.role = p.role AND r.method = p.method
      AND regexp_full_match(r.path, regexp_replace(replace(p.path, '/*', '/.*'), ':[^/]+', '[^/]+', 'g'))) AS allowed FROM r""",
)
def j11_allowed(t: Tables):
    return policy.allowed(request_rows(t), policy_rows(t)).select("page_id", "allowed")


@query(
    "j12_instance_settings",
    "SELECT event_id, c_name AS tag, c_nationkey AS zone FROM events JOIN customer ON user_id = c_custkey",
)
def j12(t: Tables):
    settings = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("tag"), F.col("c_nationkey").alias("zone"))
    return t.events.join(settings, "user_id").select("event_id", "tag", "zone")
