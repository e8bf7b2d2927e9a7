"""The query catalog: named Spark queries over the given tables with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.functions.ids import doc_id_a
from logharbor.operators.documents import with_template
from logharbor.session import prepare, scratch
from logharbor.sources.landed import spread

CATALOG: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def scratch(self, name: str) -> str:
        return scratch(self.spark, name)


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its equivalent on the same tables, if SQL can say it."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        CATALOG[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Milliseconds are cut, not rounded, in the records. The oracle's epoch_ms rounds, hence epoch_us // 1000.

# --- events as slow-log documents -----------------------------------------------------------

BRAND = "CASE WHEN event_type IN ('click', 'view') THEN 'north' ELSE 'south' END"
THRESHOLDS = {"north": 10.0, "south": 20.0}
REPORT_DAY = "2024-02-01"

# The query text of an event, in SQL both engines accept.
QUERY_TEXT_SQL = (
    "concat('{\"query\": {\"bool\": {\"filter\": [{\"term\": {\"', event_type, '\": \"u', user_id,"
    " '\"}}, {\"range\": {\"f', regexp_replace(props, '[^0-9]+', '', {all}), '\": {\"gte\": ', value,"
    " '}}}]}}, \"ids\": [', user_id, ', ', event_id, '], \"note\": null, \"size\": 10}')"
)
QUERY_TEXT_SPARK = QUERY_TEXT_SQL.replace(", {all}", "")
QUERY_TEXT_DUCK = QUERY_TEXT_SQL.replace("{all}", "'g'")


def event_millis() -> str:
    """Epoch milliseconds of ts as a SQL expression Spark accepts."""
    return "unix_millis(cast(ts AS timestamp))"


def slow_docs(t: Tables, mode: str = "strict") -> DataFrame:
    """Every event as a slow-log document taken in on REPORT_DAY."""
    docs = spread(t.events).select(
        F.expr(BRAND).alias("brand"),
        F.expr(event_millis()).alias("@timestamp"),
        F.expr(QUERY_TEXT_SPARK).alias("queryText"),
        F.col("value").alias("durationMs"),
        F.col("event_type").alias("indexName"),
        F.format_string("10.0.0.%d", "user_id").alias("nodeIP"),
        F.format_string("es-%d", "user_id").alias("instanceId"),
        F.lit(REPORT_DAY).alias("ingest_date"),
        F.col("event_id"),
    )
    return with_template(docs, mode).withColumn(
        "doc_id",
        doc_id_a(F.col("`@timestamp`"), F.col("nodeIP"), F.col("indexName"), F.col("durationMs"), F.col("instanceId")),
    )


def mask_sql(text: str) -> str:
    """The masking passes in the oracle's dialect."""
    string = r'"(?:[^"\\]|\\.)*"'
    kept = f"regexp_replace({text}, '({string})|\\s+', '\\1', 'g')"
    marked = (
        f"regexp_replace({kept}, '({string}:)|{string}|-?[0-9][0-9.eE+-]*|true|false|null',"
        " '\\1' || chr(1), 'g')"
    )
    tidy = f"replace({marked}, ':' || chr(1), ':')"
    short = f"regexp_replace({tidy}, '\\[' || chr(1) || '(,' || chr(1) || ')*\\]', '[\"?\"]', 'g')"
    return f"replace({short}, chr(1), '\"?\"')"


DOCS_SQL = f"""docs AS (
  SELECT *, md5("queryTemplate") AS "checkSum", md5("queryText") AS "dslHash" FROM (
    SELECT *, {mask_sql('"queryText"')} AS "queryTemplate" FROM (
      SELECT event_id, ts, {BRAND} AS brand, epoch_us(ts) // 1000 AS "@timestamp", {QUERY_TEXT_DUCK} AS "queryText",
        value AS "durationMs", event_type AS "indexName", concat('10.0.0.', user_id) AS "nodeIP",
        concat('es-', user_id) AS "instanceId",
        concat(epoch_us(ts) // 1000, '|', '10_0_0_', user_id, '|', event_type, '|', cast(trunc(value) AS BIGINT), '|es-', user_id) AS doc_id
      FROM events)))"""

# --- region, nation, customer and orders as one tree ----------------------------------------

NODES_SQL = """
  SELECT cast(1 + r_regionkey AS BIGINT) AS id, cast(0 AS BIGINT) AS parent_id, r_name AS name, cast(r_regionkey AS INT) AS sort FROM region
  UNION ALL SELECT cast(100 + n_nationkey AS BIGINT), cast(1 + n_regionkey AS BIGINT), n_name, cast(50 - n_nationkey AS INT) FROM nation
  UNION ALL SELECT cast(1000 + c_custkey AS BIGINT), cast(100 + c_nationkey AS BIGINT), c_name, cast(c_custkey AS INT) FROM customer
  UNION ALL SELECT cast(1000000000000 + o_orderkey AS BIGINT), cast(1000 + o_custkey AS BIGINT), concat('Order#', o_orderkey), cast(o_orderkey AS INT) FROM orders
"""


def nodes(t: Tables) -> DataFrame:
    parts = [
        t.region.selectExpr("cast(1 + r_regionkey AS BIGINT) AS id", "0L AS parent_id", "r_name AS name", "cast(r_regionkey AS INT) AS sort"),
        t.nation.selectExpr("cast(100 + n_nationkey AS BIGINT) AS id", "cast(1 + n_regionkey AS BIGINT) AS parent_id", "n_name AS name", "cast(50 - n_nationkey AS INT) AS sort"),
        t.customer.selectExpr("cast(1000 + c_custkey AS BIGINT) AS id", "cast(100 + c_nationkey AS BIGINT) AS parent_id", "c_name AS name", "cast(c_custkey AS INT) AS sort"),
        t.orders.selectExpr("cast(1000000000000 + o_orderkey AS BIGINT) AS id", "cast(1000 + o_custkey AS BIGINT) AS parent_id", "concat('Order#', o_orderkey) AS name", "cast(o_orderkey AS INT) AS sort"),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


CLOSURE_SQL = f"""RECURSIVE nodes AS ({NODES_SQL}), up AS (
  SELECT id AS descendant, parent_id AS ancestor, 1 AS depth FROM nodes WHERE parent_id <> 0
  UNION ALL SELECT up.descendant, n.parent_id, up.depth + 1 FROM up JOIN nodes n ON n.id = up.ancestor WHERE n.parent_id <> 0)"""
