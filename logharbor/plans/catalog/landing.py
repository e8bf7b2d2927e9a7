"""Sources and scans (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor.operators.documents import parse_dump
from logharbor.operators.ranking import rank_within
from logharbor.plans.catalog.base import QUERY_TEXT_SPARK, Tables, event_millis, query
from logharbor.plans.export import Template
from logharbor.sinks.titled import write_titled
from logharbor.sources import imports, landed, paged, tables
from logharbor.streaming import ingest

JANUARY_END = 1706745600000
MONTH_MINUTES = 31 * 24 * 60
DUMP_END = "\u001e"


def vendor_a_rows(t: Tables):
    """Events as vendor A raw rows; texts of error events are cut off as the vendor does."""
    text = F.expr(QUERY_TEXT_SPARK)
    cut = F.when(F.col("event_type") == "error", F.substring(text, F.lit(1), F.length(text) - 12)).otherwise(text)
    ip = F.format_string("10.0.0.%d", "user_id")
    return landed.spread(t.events).select(
        F.struct(
            cut.alias("content"),
            ip.alias("host"),
            F.col("event_type").alias("index_name"),
            F.lit("WARN").alias("level"),
            F.col("value").cast("string").alias("search_time_ms"),
            F.col("event_id").cast("string").alias("search_total_hits"),
            F.lit("QUERY_THEN_FETCH").alias("search_type"),
            F.lit("3").alias("shard_id"),
            F.lit("SEARCHSLOW").alias("slow_search_log_type"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss,SSS").alias("time"),
            F.lit("5").alias("total_shards"),
        ).alias("contentCollection"),
        ip.alias("host"),
        F.format_string("es-%d", "user_id").alias("instanceId"),
        F.expr(event_millis()).alias("timestamp"),
    )


def vendor_b_line():
    """An order as a vendor B text line."""
    return F.concat(
        F.lit("[1998-01-01T00:00:00,000] [node-"), F.col("o_custkey"), F.lit(" ] ["), F.lower("o_orderpriority"),
        F.lit("]["), F.length("o_orderstatus"), F.lit("] took_millis["), F.floor("o_totalprice"),
        F.lit("], total_hits["), F.col("o_orderkey"),
        F.lit(" hits], search_type[QUERY_THEN_FETCH], total_shards[5], source[{\"o\": {\"t\": \"x}], y]\", \"k\": "),
        F.col("o_orderkey"), F.lit("}, \"s_"), F.col("o_orderstatus"), F.lit("\": ["), F.col("o_totalprice"),
        F.lit("]}], id[abc]"),
    )


@query(
    "s01_landed_vendor_a",
    "SELECT concat('es-', user_id) AS instance_id, epoch_us(ts) // 1000 AS stamp, event_type AS index_name,"
    " value AS search_ms FROM events WHERE epoch_us(ts) // 1000 BETWEEN 1704067200000 AND 1706745600000",
)
def s01(t: Tables):
    path = t.scratch("vendor-a")
    vendor_a_rows(t).write.json(path)
    start, end = landed.look_back(JANUARY_END, MONTH_MINUTES)
    return landed.read_vendor_a(t.spark, path, start, end).select(
        F.col("instanceId").alias("instance_id"),
        F.col("timestamp").alias("stamp"),
        F.col("contentCollection.index_name").alias("index_name"),
        F.col("contentCollection.search_time_ms").cast("double").alias("search_ms"),
    )


@query(
    "s02_landed_vendor_b",
    "SELECT source AS cluster, lang AS node, md5(text) AS line_hash FROM documents WHERE n_chars >= 400",
)
def s02(t: Tables):
    path = t.scratch("vendor-b")
    t.documents.select(
        F.col("text").alias("content"),
        F.lit("2025-08-01T10:20:30,123").alias("date"),
        F.when(F.col("n_chars") >= 400, "WARN").otherwise("INFO").alias("level"),
        F.col("source").alias("cluster"),
        F.col("lang").alias("node"),
    ).write.partitionBy("cluster", "node").json(path)
    return landed.read_vendor_b(t.spark, path).select("cluster", "node", F.md5("content").alias("line_hash"))


PAGE = 50


def land_pages(records, keys, order, path, pull, spoilt=None):
    """Write rows as the pages of a pull, PAGE records each, those that ``spoilt`` names cut off, and mark it as landed."""
    ranked = rank_within(records, keys, order, "_rank").withColumn("page", F.floor((F.col("_rank") - 1) / PAGE) + 1)
    # A page is the group, so its records are bounded.
    found = F.sort_array(F.collect_list(F.struct("_rank", F.struct(*records.columns).alias("record"))))
    answers = ranked.groupBy(*keys, "page").agg(F.to_json(F.struct(F.transform(found, lambda r: r["record"]).alias("Result"))).alias("value"))
    if spoilt is not None:
        answers = answers.withColumn("value", F.when(spoilt, F.substring("value", F.lit(1), F.length("value") - 5)).otherwise(F.col("value")))
    # Tasks put their own files in place: the driver would move every page by itself. A pull counts only once it is marked below.
    writer = answers.withColumn("pull", F.lit(pull)).write.mode("append").partitionBy("pull", *keys, "page")
    writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)
    paged.mark_done(path, pull)


@query(
    "s01_paged_vendor_a",
    """SELECT concat('es-', user_id % 50) AS instance_id, epoch_us(ts) // 1000 AS stamp, event_type AS index_name, value AS search_ms, NULL AS broken
    FROM events WHERE user_id % 50 <> 3 AND epoch_us(ts) // 1000 BETWEEN 1704067200000 AND 1706745600000
    UNION ALL SELECT DISTINCT 'es-3', cast(NULL AS BIGINT), NULL, cast(NULL AS DOUBLE), 'page 1' FROM events WHERE user_id % 50 = 3""",
)
def s01_paged(t: Tables):
    path = t.scratch("pages-a")
    name = F.concat(F.lit("es-"), F.regexp_extract("instanceId", "[0-9]+", 0).cast("bigint") % 50)
    rows = vendor_a_rows(t).withColumn("instanceId", name)
    land_pages(rows, ["instanceId"], ["contentCollection.search_total_hits"], path, JANUARY_END, F.expr("instanceId = 'es-3' AND page = 1"))
    start, end = landed.look_back(JANUARY_END, MONTH_MINUTES)
    pulled = paged.register(t.spark).read.format("paged_logs").options(path=path, begin=start, end=end).load()
    return pulled.select(
        F.col("instanceId").alias("instance_id"),
        F.col("timestamp").alias("stamp"),
        F.col("contentCollection.index_name").alias("index_name"),
        F.col("contentCollection.search_time_ms").cast("double").alias("search_ms"),
        F.split("error", ":")[0].alias("broken"),
    )


@query(
    "s02_paged_vendor_b",
    "SELECT source AS cluster, lang AS node, md5(text) AS line_hash FROM documents WHERE n_chars >= 400",
)
def s02_paged(t: Tables):
    path, out = t.scratch("pages-b"), t.scratch("pulled-b")
    keys = ["cluster", "node"]
    lines = t.documents.select(
        "doc_id",
        F.col("text").alias("content"),
        F.when(F.col("n_chars") >= 400, "WARN").otherwise("INFO").alias("level"),
        F.col("source").alias("cluster"),
        F.col("lang").alias("node"),
    )
    schema = f"content STRING, level STRING, cluster STRING, node STRING, {paged.ADDED}"
    # Two pulls; the stream takes up each from where the one before ended.
    for pull in (1, 2):
        land_pages(lines.filter(F.col("doc_id") % 2 == pull - 1), keys, ["doc_id"], path, pull)
        pages = paged.register(t.spark).readStream.format("paged_logs").schema(schema).option("path", path).load()
        ingest.append(pages.filter("level = 'WARN'"), out, f"{out}-checkpoint").awaitTermination()
    return t.spark.read.parquet(out).select("cluster", "node", F.md5("content").alias("line_hash"))


@query(
    "s03_data_nodes",
    "SELECT cast(conv_id AS VARCHAR) AS cluster, concat('node-', turn) AS node FROM conversations WHERE role = 'assistant'",
)
def s03(t: Tables):
    details = t.conversations.select(
        F.col("conv_id").cast("string").alias("id"),
        F.array(
            F.struct(
                F.lit("a").alias("id"),
                F.format_string("node-%d", "turn").alias("name"),
                F.when(F.col("role") == "assistant", "ess").otherwise("ess-master").alias("type"),
            ),
            F.struct(F.lit("b").alias("id"), F.lit(None).cast("string").alias("name"), F.lit("ess").alias("type")),
        ).alias("instances"),
    )
    return landed.data_nodes(details)


@query("s04_thread_dumps", "SELECT source AS instance_id, md5(text) AS dump_hash FROM documents")
def s04(t: Tables):
    path = t.scratch("dumps")
    (
        t.documents.select("text", F.col("source").alias("instanceId"))
        .write.partitionBy("instanceId")
        .text(path, lineSep=DUMP_END)
    )
    instances = t.documents.select(F.col("source").alias("instanceId")).distinct().select(
        "instanceId", F.lit("tag").alias("esTag"), F.lit("500ms").alias("hotInterval"),
        F.lit(3).alias("hotThreads"), F.lit("cpu").alias("hotType"),
    )
    dumps = parse_dump(landed.read_dumps(t.spark, path, DUMP_END), instances, F.lit(0).cast("bigint"))
    return dumps.select(F.col("instanceId").alias("instance_id"), F.md5("rawText").alias("dump_hash"))


@query("s05_named_database", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s05(t: Tables):
    databases = tables.Databases(t.spark, {"main": {"format": "parquet", "path": t.folder}})
    return databases.table("main", "customer")


@query(
    "s06_titled_import",
    "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '2024-05-06' ELSE '2020-01-01' END"
    " AS created_on FROM customer",
)
def s06(t: Tables):
    template = Template("customers", "customer", '{"c_custkey": "Key", "c_name": "Name", "c_acctbal": "Balance"}')
    old = t.customer.filter("c_mktsegment <> 'HOUSEHOLD'").select(
        "c_custkey", "c_name", "c_acctbal", F.lit("2020-01-01").cast("timestamp").alias("created_at")
    )
    path = t.scratch("titled")
    write_titled(
        t.customer.filter("c_mktsegment = 'HOUSEHOLD'").select(
            F.col("c_name").alias(" Name "), F.col("c_custkey").alias("Key"), F.lit("x").alias("Remark"),
            F.col("c_acctbal").alias("Balance "),
        ),
        path,
    )
    out = imports.import_titled(t.spark, path, template, old, F.lit("2024-05-06").cast("timestamp"))
    return out.select("c_custkey", "c_name", "c_acctbal", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"))


NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


_COUNTS_SQL = " UNION ALL ".join(f"SELECT '{name}' AS t, count(*) AS n FROM {name}" for name in NAMES)


@query(
    "s07_catalog_scan",
    f"""WITH c AS ({_COUNTS_SQL})
    SELECT table_name AS "table", column_name AS "column",
      CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
        WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS type,
      '' AS length, '' AS comment, column_name IN ('o_orderkey', 'c_custkey') AS is_key,
      cast(ordinal_position AS INT) AS ordinal, n AS table_rows
    FROM information_schema.columns JOIN c ON t = table_name""",
)
def s07(t: Tables):
    return tables.describe(
        {name: getattr(t, name) for name in NAMES}, {"orders": ["o_orderkey"], "customer": ["c_custkey"]}
    )


@query(
    "s08_option_list",
    "SELECT c_name AS label, c_custkey AS value FROM customer WHERE c_mktsegment <> 'MACHINERY'",
)
def s08(t: Tables):
    stamped = t.customer.withColumn(
        "deleted_at", F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("2024-01-01").cast("timestamp"))
    )
    return tables.option_list(stamped, "c_name", "c_custkey")


@query(
    "s09_record_import",
    "SELECT page_id, url, 'old' AS batch FROM pages UNION ALL SELECT page_id, url, 'new' FROM pages",
)
def s09(t: Tables):
    path = t.scratch("records")
    imports.append_records(t.pages.select("page_id", "url", F.lit("old").alias("batch")), path)
    imports.append_records(t.pages.select("page_id", "url", F.lit("new").alias("batch")), path)
    return t.spark.read.parquet(path)
