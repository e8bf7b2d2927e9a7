"""Filters and predicates (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor.operators import filters as f
from logharbor.operators import quality, textindex
from logharbor.plans.catalog.base import DOCS_SQL, THRESHOLDS, Tables, query, slow_docs
from logharbor.plans.search import search_page
from logharbor.sources.landed import spread

EVENT_COLUMNS = "event_id, user_id, event_type, value"


def events(t: Tables):
    return t.events.select("event_id", "user_id", "event_type", "value")


@query("f01_equal", f"SELECT {EVENT_COLUMNS} FROM events WHERE event_type = 'error'")
def f01(t: Tables):
    return f.search(events(t), [f.Condition("kind", "event_type")], {"kind": "error"})


@query("f02_not_equal", f"SELECT {EVENT_COLUMNS} FROM events WHERE event_type <> 'error'")
def f02(t: Tables):
    return f.search(events(t), [f.Condition("kind", "event_type", "<>")], {"kind": "error"})


@query("f03_greater_less", f"SELECT {EVENT_COLUMNS} FROM events WHERE value > 5 AND value < 25")
def f03(t: Tables):
    return f.search(
        events(t), [f.Condition("low", "value", ">"), f.Condition("high", "value", "<")], {"low": 5, "high": 25}
    )


@query(
    "f04_optional_range",
    f"SELECT 'low' AS ends, {EVENT_COLUMNS} FROM events WHERE value >= 15"
    f" UNION ALL SELECT 'high', {EVENT_COLUMNS} FROM events WHERE value <= 3"
    f" UNION ALL SELECT 'both', {EVENT_COLUMNS} FROM events WHERE value BETWEEN 3 AND 15"
    f" UNION ALL SELECT 'none', {EVENT_COLUMNS} FROM events",
)
def f04(t: Tables):
    e, v = events(t), F.col("value")

    def part(name, low, high):
        return e.filter(f.closed_range(v, low, high)).withColumn("ends", F.lit(name))

    return part("low", 15, 0).unionByName(part("high", 0, 3)).unionByName(part("both", 3, 15)).unionByName(
        part("none", 0, None)
    )


@query(
    "f05_required_time_range",
    "SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'",
)
def f05(t: Tables):
    low, high = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
    return t.events.filter(f.required_range(F.col("ts"), low, high)).select("event_id", "event_type")


@query(
    "f06_between",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000",
)
def f06(t: Tables):
    return f.search(
        t.orders.select("o_orderkey", "o_totalprice"), [f.Condition("r", "o_totalprice", "BETWEEN")], {"r": [100000, 200000]}
    )


@query(
    "f07_not_between",
    "SELECT o_orderkey, price FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price"
    " FROM orders) WHERE price NOT BETWEEN 100000 AND 200000",
)
def f07(t: Tables):
    priced = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))
    return f.search(priced, [f.Condition("r", "price", "NOT BETWEEN")], {"r": [100000, 200000]})


@query("f08_like", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%0_1%'")
def f08(t: Tables):
    return t.customer.filter(f.like_contains(F.col("c_name"), "0_1")).select("c_custkey", "c_name")


@query(
    "f09_in_list",
    "SELECT o_orderkey, 'list' AS how FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"
    " UNION ALL SELECT o_orderkey, 'table' FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
)
def f09(t: Tables):
    listed = f.search(t.orders, [f.Condition("p", "o_orderpriority", "IN")], {"p": ["1-URGENT", "5-LOW"]})
    poor = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    looked_up = t.orders.join(poor, "o_custkey", "left_semi")
    return listed.select("o_orderkey", F.lit("list").alias("how")).unionByName(
        looked_up.select("o_orderkey", F.lit("table").alias("how"))
    )


@query(
    "f10_full_text",
    r"SELECT doc_id FROM documents WHERE len(list_intersect(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'),"
    " ['there', 'other', 'eaux', 'that'])) > 0",
)
def f10(t: Tables):
    return spread(t.documents).filter(f.match_any_term(F.col("text"), "There, OTHER eaux that")).select("doc_id")


@query(
    "f10_term_index",
    r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x IN ('there', 'other', 'eaux', 'that'))) AS hit FROM documents)
    SELECT doc_id, cast(len(hit) AS INT) AS hits FROM w WHERE len(hit) > 0""",
)
def f10_index(t: Tables):
    path = t.scratch("terms")
    textindex.build_index(spread(t.documents), path, "doc_id", "text")
    return textindex.search_any(t.spark, path, "There, OTHER eaux that").withColumnRenamed("id", "doc_id")


@query(
    "f10_phrase",
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS words FROM documents),
    spots AS (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w)
    SELECT doc_id, cast(count(*) AS INT) AS times FROM spots WHERE words[i] = 'the' AND words[i + 1] = 'on' GROUP BY doc_id""",
)
def f10_phrase(t: Tables):
    path = t.scratch("terms")
    textindex.build_index(spread(t.documents), path, "doc_id", "text")
    return textindex.search_phrase(t.spark, path, "the ON").withColumnRenamed("id", "doc_id")


DICTIONARY_SQL = (
    "SELECT cast(c_custkey AS BIGINT) AS id, c_mktsegment AS type, c_name AS name, c_acctbal >= 0 AS status FROM customer"
)


def dictionary(t: Tables):
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.col("c_name").alias("name"),
        (F.col("c_acctbal") >= 0).alias("status"),
    )


@query(
    "f11_type_or_id",
    f"SELECT 'default' AS how, id, name FROM ({DICTIONARY_SQL}) WHERE (type = 'BUILDING' OR id = 42) AND status"
    f" UNION ALL SELECT 'off', id, name FROM ({DICTIONARY_SQL}) WHERE (type = 'BUILDING' OR id = 42) AND NOT status",
)
def f11(t: Tables):
    d = dictionary(t)
    on = f.type_or_id(d, "BUILDING", 42).select(F.lit("default").alias("how"), "id", "name")
    off = f.type_or_id(d, "BUILDING", 42, False).select(F.lit("off").alias("how"), "id", "name")
    return on.unionByName(off)


@query(
    "f12_optional_search",
    f"WITH {DOCS_SQL} SELECT event_id, \"indexName\" AS index_name, \"durationMs\" AS duration_ms FROM docs"
    " WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-28 00:00:00.001'"
    " AND \"durationMs\" >= 4 AND \"indexName\" = 'purchase' AND contains(\"queryText\", '\"purchase\"')",
)
def f12(t: Tables):
    docs = slow_docs(t).withColumn("eventTime", F.date_format(F.timestamp_millis("`@timestamp`"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    request = {
        "startTime": "2024-01-03T00:00:00.000Z", "endTime": "2024-01-28T00:00:00.000Z", "minDurationMs": 4,
        "maxDurationMs": 0, "indexName": "purchase", "queryText": "Purchase nothing_else", "level": "",
        "instanceId": None,
    }
    return f.search_slow_logs(docs, request).select(
        "event_id", F.col("indexName").alias("index_name"), F.col("durationMs").alias("duration_ms")
    )


@query(
    "f12_search_page",
    f"""WITH {DOCS_SQL}, hits AS (SELECT * FROM docs WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-28 00:00:00.001'
      AND "durationMs" >= 4 AND "indexName" = 'purchase')
    SELECT event_id, doc_id, "durationMs" AS duration_ms, (SELECT count(*) FROM hits) AS total FROM hits
    ORDER BY "@timestamp" DESC, doc_id LIMIT 25 OFFSET 50""",
)
def f12_page(t: Tables):
    docs = slow_docs(t).withColumn("eventTime", F.date_format(F.timestamp_millis("`@timestamp`"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    request = {
        "startTime": "2024-01-03T00:00:00.000Z", "endTime": "2024-01-28T00:00:00.000Z", "minDurationMs": 4,
        "indexName": "purchase", "page": 3, "pageSize": 25,
    }
    return search_page(docs, request).select("event_id", "doc_id", F.col("durationMs").alias("duration_ms"), "total")


def stamped_orders(t: Tables):
    return t.orders.withColumn(
        "deleted_at", F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate"))
    )


@query(
    "f13_not_deleted",
    "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW'",
)
def f13(t: Tables):
    main = f.not_deleted(stamped_orders(t))
    other = f.not_deleted(t.customer)
    return main.join(other, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query(
    "f14_template_conditions",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority LIKE '%URG%' AND o_totalprice >= 150000"
    " AND o_orderstatus <> 'P'",
)
def f14(t: Tables):
    stored = [
        f.Condition("priority", "o_orderpriority", "LIKE"),
        f.Condition("low", "o_totalprice", ">="),
        f.Condition("not_status", "o_orderstatus", "<>"),
        f.Condition("customer", "o_custkey", "="),
    ]
    request = {"priority": "URG", "low": 150000, "not_status": "P", "customer": ""}
    return f.search(t.orders, stored, request).select("o_orderkey", "o_totalprice")


@query("f15_typed_search", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%AND%' AND p_size > 10")
def f15(t: Tables):
    fields = [
        f.typed_condition("type", "p_type", "enum", "LIKE"),
        f.typed_condition("size", "p_size", "int", ">"),
        f.typed_condition("picture", "p_name", "picture", "="),
    ]
    request = {"type": "AND", "size": 10, "picture": "nothing"}
    return f.search(t.part, [c for c in fields if c], request).select("p_partkey", "p_type")


@query(
    "f16_source_threshold",
    f"WITH {DOCS_SQL} SELECT event_id, brand FROM docs WHERE (brand = 'north' AND \"durationMs\" >= 10)"
    " OR (brand = 'south' AND \"durationMs\" >= 20)",
)
def f16(t: Tables):
    docs = slow_docs(t)
    return docs.filter(f.slow_for_source(F.col("brand"), F.col("durationMs"), THRESHOLDS)).select("event_id", "brand")


@query(
    "f17_data_scope",
    "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
)
def f17(t: Tables):
    scopes = t.nation.select(F.col("n_regionkey").alias("caller"), F.col("n_nationkey").alias("c_nationkey"))
    return f.in_data_scope(t.customer, "c_nationkey", scopes, "caller", 2).select("c_custkey", "c_name", "c_nationkey")


@query(
    "f18_deny_list",
    "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')",
)
def f18(t: Tables):
    denied = t.customer.filter("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("user_id"))
    return f.not_listed(t.events, denied, "user_id").select("event_id", "user_id")


@query(
    "f19_first_match",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 400000"
    " ORDER BY o_orderkey LIMIT 1",
)
def f19(t: Tables):
    wanted = (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_totalprice") > 400000)
    return f.first_match(t.orders, wanted, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice")


RULES = {
    "c_custkey": ["notEmpty"],
    "c_name": ["notEmpty", "ge=18", "regexp=^Customer#[0-9]+$"],
    "c_nationkey": ["lt=20"],
    "c_acctbal": ["ge=0", "le=9000.5"],
    "c_mktsegment": ["ne=9", "le=9"],
}
_CHECKS = [
    ("c_custkey", "notEmpty", "c_custkey <> 0"),
    ("c_name", "notEmpty", "c_name <> ''"),
    ("c_name", "ge=18", "length(c_name) >= 18"),
    ("c_name", "regexp=^Customer#[0-9]+$", "regexp_matches(c_name, '^Customer#[0-9]+$')"),
    ("c_nationkey", "lt=20", "c_nationkey < 20"),
    ("c_acctbal", "ge=0", "c_acctbal >= 0"),
    ("c_acctbal", "le=9000.5", "c_acctbal <= 9000.5"),
    ("c_mktsegment", "ne=9", "length(c_mktsegment) <> 9"),
    ("c_mktsegment", "le=9", "length(c_mktsegment) <= 9"),
]
_FIRST_FIELD = "CASE " + " ".join(f"WHEN NOT ({c}) THEN '{n}'" for n, _, c in _CHECKS) + " END"
_FIRST_RULE = "CASE " + " ".join(f"WHEN NOT ({c}) THEN '{r}'" for _, r, c in _CHECKS) + " END"


@query(
    "f20_rule_violations",
    f"SELECT * FROM (SELECT c_custkey, {_FIRST_FIELD} AS field, {_FIRST_RULE} AS rule FROM customer) WHERE field IS NOT NULL",
)
def f20(t: Tables):
    return quality.violations(t.customer, RULES, ["c_custkey"])


@query(
    "f20_rule_counts",
    " UNION ALL ".join(
        f"SELECT '{n}' AS field, '{r}' AS rule, count(*) FILTER (WHERE NOT ({c})) AS failed FROM customer" for n, r, c in _CHECKS
    ),
)
def f20_counts(t: Tables):
    return quality.violation_counts(t.customer, RULES)


@query(
    "f20_rule_split",
    f"SELECT c_custkey, CASE WHEN {_FIRST_FIELD} IS NULL THEN 'passed' ELSE 'failed' END AS verdict FROM customer",
)
def f20_split(t: Tables):
    passed, failed = quality.split_by_rules(t.customer, RULES)
    return passed.select("c_custkey", F.lit("passed").alias("verdict")).unionByName(
        failed.select("c_custkey", F.lit("failed").alias("verdict"))
    )
