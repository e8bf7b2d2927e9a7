"""Projections (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor.operators.documents import flatten_a, parse_b
from logharbor.operators.joins import with_instance_name
from logharbor.plans.catalog.base import DOCS_SQL, QUERY_TEXT_DUCK, Tables, mask_sql, query, slow_docs
from logharbor.plans.catalog.landing import vendor_a_rows, vendor_b_line
from logharbor.sources.landed import spread
from logharbor.plans.export import Template, as_text, export_rows


@query(
    "p10_flatten_vendor_a",
    f"""WITH raw AS (SELECT *, {QUERY_TEXT_DUCK} AS full_text FROM events),
    cut AS (SELECT *, CASE WHEN event_type = 'error' THEN substr(full_text, 1, length(full_text) - 12) ELSE full_text END AS q FROM raw)
    SELECT concat(epoch_us(ts) // 1000, '|10_0_0_', user_id, '|', event_type, '|', cast(trunc(value) AS BIGINT), '|es-', user_id) AS doc_id,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS event_time, epoch_us(ts) // 1000 AS stamp, md5(q) AS dsl_hash,
      CASE WHEN event_type = 'error' THEN 'non-json' ELSE 'json' END AS dsl_format, value AS duration_ms,
      event_type AS index_name, concat('10.0.0.', user_id) AS node_ip, concat('es-', user_id) AS instance_id,
      {mask_sql('q')} AS template, md5({mask_sql('q')}) AS check_sum,
      'WARN' AS level, cast(event_id AS DOUBLE) AS search_hits, 'QUERY_THEN_FETCH' AS search_type,
      cast(3 AS BIGINT) AS shard_id, 'SEARCHSLOW' AS slow_search_type, cast(5 AS BIGINT) AS shard_total, 'run-1' AS task_id
    FROM cut""",
)
def p10(t: Tables):
    d = flatten_a(vendor_a_rows(t), task="run-1")
    return d.select(
        "doc_id", F.col("eventTime").alias("event_time"), F.col("`@timestamp`").alias("stamp"),
        F.col("dslHash").alias("dsl_hash"), F.col("dslFormat").alias("dsl_format"),
        F.col("durationMs").alias("duration_ms"), F.col("indexName").alias("index_name"),
        F.col("nodeIP").alias("node_ip"), F.col("instanceId").alias("instance_id"), "level",
        F.col("queryTemplate").alias("template"), F.col("checkSum").alias("check_sum"),
        F.col("searchHits").alias("search_hits"), F.col("searchType").alias("search_type"),
        F.col("shardId").alias("shard_id"), F.col("slowSearchType").alias("slow_search_type"),
        F.col("shardTotal").alias("shard_total"), F.col("taskId").alias("task_id"),
    )


def orders_as_b(t: Tables):
    return spread(t.orders).select(
        vendor_b_line().alias("content"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss,SSS").alias("date"),
        F.lit("WARN").alias("level"),
        F.concat(F.lit("c-"), F.col("o_orderstatus")).alias("cluster"),
    )


@query(
    "p11_parse_vendor_b",
    """WITH q AS (SELECT *, concat('{"o": {"t": "x}], y]", "k": ', o_orderkey, '}, "s_', o_orderstatus, '": [', o_totalprice, ']}') AS q FROM orders)
    SELECT concat(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ'), '|node-', o_custkey, '|', lower(o_orderpriority), '|',
        cast(floor(o_totalprice) AS BIGINT), '|c-', o_orderstatus) AS doc_id,
      epoch_us(o_orderdate) // 1000 AS stamp, q AS query_text,
      concat('{"o":{"t":"?","k":"?"},"s_', o_orderstatus, '":["?"]}') AS template,
      md5(concat('{"o":{"t":"?","k":"?"},"s_', o_orderstatus, '":["?"]}')) AS check_sum, md5(q) AS dsl_hash,
      'json' AS dsl_format, cast(floor(o_totalprice) AS DOUBLE) AS duration_ms, lower(o_orderpriority) AS index_name,
      concat('node-', o_custkey) AS node_name, cast(1 AS BIGINT) AS shard_id, o_orderkey AS search_hits,
      'QUERY_THEN_FETCH' AS search_type, cast(5 AS BIGINT) AS shard_total
    FROM q""",
)
def p11(t: Tables):
    d = parse_b(orders_as_b(t))
    return d.select(
        "doc_id", F.col("`@timestamp`").alias("stamp"), F.col("queryText").alias("query_text"),
        F.col("queryTemplate").alias("template"), F.col("checkSum").alias("check_sum"),
        F.col("dslHash").alias("dsl_hash"), F.col("dslFormat").alias("dsl_format"),
        F.col("durationMs").alias("duration_ms"), F.col("indexName").alias("index_name"),
        F.col("nodeName").alias("node_name"), F.col("shardId").alias("shard_id"),
        F.col("searchHits").alias("search_hits"), F.col("searchType").alias("search_type"),
        F.col("shardTotal").alias("shard_total"),
    )


@query(
    "p12_sample_fields",
    f'WITH {DOCS_SQL} SELECT "@timestamp" AS stamp, "instanceId" AS instance_id, "indexName" AS index_name, "queryText" AS query_text FROM docs',
)
def p12(t: Tables):
    return slow_docs(t).select(
        F.col("`@timestamp`").alias("stamp"), F.col("instanceId").alias("instance_id"),
        F.col("indexName").alias("index_name"), F.col("queryText").alias("query_text"),
    )


@query(
    "p13_template_projection",
    """SELECT cast(o_orderkey AS VARCHAR) AS "Order", o_orderstatus AS "State",
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "Placed", regexp_replace(cast(o_totalprice AS VARCHAR), '[.]0$', '') AS "Total" FROM orders""",
)
def p13(t: Tables):
    info = '{"orders.o_orderkey as id": "Order", "`o_orderstatus`": "State", "o_orderdate": "Placed", "o_totalprice": "Total"}'
    return as_text(export_rows(Template("orders", "orders", info), {"orders": t.orders}, {}))


@query("p14_pluck", "SELECT o_custkey FROM orders")
def p14(t: Tables):
    return t.orders.select("o_custkey")


@query(
    "p15_constant_columns",
    "SELECT event_id, 'run-1' AS task_id, CASE WHEN event_type IN ('click', 'view') THEN 'north' ELSE 'south' END AS brand,"
    " strftime(ts, '%Y-%m-%d') AS created_on FROM events",
)
def p15(t: Tables):
    return slow_docs(t).select(
        "event_id", F.lit("run-1").alias("task_id"), "brand",
        F.date_format(F.timestamp_millis("`@timestamp`"), "yyyy-MM-dd").alias("created_on"),
    )


@query(
    "p16_default_name",
    "SELECT event_id, coalesce(c_name, concat('未命名实例-', user_id)) AS name FROM events LEFT JOIN"
    " (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = user_id",
)
def p16(t: Tables):
    names = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return with_instance_name(t.events.select("event_id", "user_id"), names, "user_id", "name").select("event_id", "name")
