"""Aggregations and per-key picks (A, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor.functions.text import first_segment
from logharbor.operators import aggregates as a
from logharbor.operators.filters import slow_for_source
from logharbor.operators.paging import page_of
from logharbor.plans.catalog.base import DOCS_SQL, REPORT_DAY, THRESHOLDS, Tables, query, slow_docs
from logharbor.plans.catalog.lookups import PATH_SQL
from logharbor.plans.inspection import inspection_report

SLOW_SQL = """slow AS (SELECT * FROM docs WHERE (brand = 'north' AND "durationMs" >= 10) OR (brand = 'south' AND "durationMs" >= 20))"""
CENTS = "round({} * 100) / 100"


def mean_sql(value: str) -> str:
    """The exact mean of the operators in the oracle's dialect."""
    return f"cast(sum(cast({value} AS DECIMAL(28, 6))) AS DOUBLE) / nullif(count({value}), 0)"


MEAN = mean_sql('"durationMs"')


def slow(t: Tables):
    return slow_docs(t).filter(slow_for_source(F.col("brand"), F.col("durationMs"), THRESHOLDS))


@query(
    "a01_fingerprint_buckets",
    f"""WITH {DOCS_SQL}, {SLOW_SQL} SELECT "checkSum" AS check_sum, count(*) AS doc_count,
    {CENTS.format('max("durationMs")')} AS max_duration, {CENTS.format('(' + MEAN + ')')} AS avg_duration
    FROM slow GROUP BY "checkSum" """,
)
def a01(t: Tables):
    return a.rounded(a.fingerprint_buckets(slow(t))).withColumnRenamed("checkSum", "check_sum")


@query(
    "a02_bucket_samples",
    f"""WITH {DOCS_SQL}, {SLOW_SQL} SELECT "checkSum" AS check_sum,
    arg_min("queryText", struct_pack(a := "@timestamp", b := doc_id)) AS sample_text,
    arg_min("instanceId", struct_pack(a := "@timestamp", b := doc_id)) AS sample_instance
    FROM slow GROUP BY "checkSum" """,
)
def a02(t: Tables):
    return a.sampled_buckets(slow(t)).select(
        F.col("checkSum").alias("check_sum"), F.col("sample.queryText").alias("sample_text"),
        F.col("sample.instanceId").alias("sample_instance"),
    )


@query(
    "a03_largest_buckets",
    f"""WITH {DOCS_SQL} SELECT "checkSum" AS check_sum, count(*) AS doc_count FROM docs GROUP BY "checkSum"
    ORDER BY doc_count DESC, check_sum LIMIT 10000""",
)
def a03(t: Tables):
    return a.top_buckets(a.fingerprint_buckets(slow_docs(t))).select(F.col("checkSum").alias("check_sum"), "doc_count")


REPORT_SQL = f"""WITH {DOCS_SQL}, {SLOW_SQL}, b AS (SELECT brand, "checkSum", count(*) AS n,
      max("durationMs") AS mx, {MEAN} AS av,
      arg_min(struct_pack(ts := "@timestamp", inst := "instanceId", idx := "indexName", q := "queryText"),
              struct_pack(a := "@timestamp", b := doc_id)) AS s
    FROM slow GROUP BY brand, "checkSum")
    SELECT brand, s.idx AS "DBName", s.q AS "SQLText", "checkSum" AS sqlhash,
      strftime(make_timestamp(s.ts * 1000), '%Y-%m-%d %H:%M:%S') AS sqltime, '2024-02-02 00:00:00' AS "__time__",
      '' AS "__source__", CASE s.inst WHEN 'es-7' THEN 'orders search' WHEN 'es-8' THEN 'login search'
        ELSE concat('未命名实例-', s.inst) END AS "DBInstanceName",
      round(mx * 100) / 100 AS "MaxExecutionTime", round(av * 100) / 100 AS "AverageExecutionTime",
      n AS "MySQLTotalExecutionCounts" FROM b"""


@query("a04_inspection_report", REPORT_SQL)
def a04(t: Tables):
    return inspection_report(
        slow_docs(t), REPORT_DAY, THRESHOLDS, {"es-7": "orders search", "es-8": "login search"},
        F.lit("2024-02-02 00:00:00"),
    )


@query(
    "a05_empty_reads_zero",
    "SELECT event_type AS check_sum, count(*) AS doc_count, coalesce(max(CASE WHEN event_type <> 'click' THEN value END), 0) AS max_duration,"
    f" round(coalesce({mean_sql("CASE WHEN event_type <> 'click' THEN value END")}, 0) * 100) / 100 AS avg_duration FROM events GROUP BY event_type",
)
def a05(t: Tables):
    measured = t.events.select(
        F.col("event_type").alias("checkSum"), F.when(F.col("event_type") != "click", F.col("value")).alias("durationMs")
    )
    return a.rounded(a.fingerprint_buckets(measured)).withColumnRenamed("checkSum", "check_sum")


@query(
    "a06_page_with_total",
    "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders"
    " WHERE o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 20 OFFSET 40",
)
def a06(t: Tables):
    found = t.orders.filter("o_orderstatus = 'O'")
    page = page_of(found.select("o_orderkey", "o_totalprice"), 3, 20, [F.desc("o_orderkey")])
    return a.with_total(page, found)


@query("a07_child_counts", "SELECT o_custkey, count(*) AS children FROM orders GROUP BY o_custkey")
def a07(t: Tables):
    return a.child_counts(t.orders, "o_custkey")


HOST_SQL = "regexp_extract(url, '^https?://([^/]+)', 1)"


@query(
    "a08_distinct_groups",
    f"SELECT {HOST_SQL} AS host, min(page_id) AS first_id FROM pages GROUP BY 1",
)
def a08(t: Tables):
    return a.distinct_groups(t.pages.withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1)), "host", "page_id")


@query(
    "a08_group_of_segment",
    f"SELECT split_part({PATH_SQL}, '/', 2) AS segment, arg_max({HOST_SQL}, page_id) AS \"group\" FROM pages GROUP BY 1",
)
def a08_segment(t: Tables):
    rows = t.pages.select(
        "page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"),
        F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"),
    )
    return a.group_of_segment(rows, first_segment(F.col("path")), "host", "page_id")


@query(
    "a09_distinct_policies",
    "SELECT DISTINCT l_returnflag AS role, concat('/part/', l_partkey) AS path, l_linestatus AS method FROM lineitem",
)
def a09(t: Tables):
    return a.distinct_policies(
        t.lineitem.select(
            F.col("l_returnflag").alias("role"), F.concat(F.lit("/part/"), F.col("l_partkey")).alias("path"),
            F.col("l_linestatus").alias("method"),
        )
    )


@query(
    "a10_nested_map",
    "SELECT l_orderkey, l_suppkey, cast(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL",
)
def a10(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))
    return a.nested_map(rows, "l_orderkey", "l_suppkey", "q")


@query(
    "a11_run_metrics",
    "SELECT user_id, CASE WHEN event_type = 'error' THEN props END AS reason, count(*) FILTER (WHERE event_type <> 'error') AS succeeded,"
    " count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY ALL",
)
def a11(t: Tables):
    return a.run_metrics(t.events, F.col("event_type") != "error", by="user_id", error=F.col("props"))


@query(
    "a12_children_of",
    "SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_name) - 1 AS position, c_name FROM customer",
)
def a12(t: Tables):
    return a.children_of(t.customer, "c_nationkey", ["c_acctbal", "c_name"]).drop("c_acctbal")


@query(
    "w01_last_writer",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC,"
    " o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
)
def w01(t: Tables):
    return a.latest(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "w02_first_match_per_key",
    "SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn"
    " FROM documents) WHERE rn = 1",
)
def w02(t: Tables):
    return a.earliest(t.documents.select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], ["doc_id"])


@query(
    "w03_top_hits",
    "SELECT event_type, user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id"
    " ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3",
)
def w03(t: Tables):
    return a.top_hits(
        t.events.select("event_type", "user_id", "event_id", "value"), ["event_type", "user_id"],
        [F.desc("value"), F.asc("event_id")], 3,
    )
