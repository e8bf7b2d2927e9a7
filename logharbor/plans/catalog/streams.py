"""Streams, drained with an available-now trigger (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from logharbor.functions import fingerprint, mask_json, usage_percentages
from logharbor.operators.documents import fields_a, with_template
from logharbor.operators.filters import slow_for_source
from logharbor.plans.catalog.base import DOCS_SQL, QUERY_TEXT_DUCK, QUERY_TEXT_SPARK, REPORT_DAY, THRESHOLDS, Tables, mask_sql, query
from logharbor.plans.catalog.landing import DUMP_END, vendor_a_rows
from logharbor.plans.catalog.rollups import MEAN, SLOW_SQL
from logharbor.sources.landed import accepted, stream_dumps
from logharbor.session import rocksdb
from logharbor.streaming import audit, ingest, late, limiter, metrics, report


class StreamTables(Tables):
    """The given tables as file streams."""

    def __getattr__(self, name: str):
        # A pattern, as a table is one file or a folder of files; a stream takes a plain path for a folder.
        schema = self.spark.read.parquet(self.path(name)).schema
        return ingest.file_stream(self.spark, f"{self.folder}/{{{name}.parquet}}", schema)


def streams(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.folder)


@query(
    "t01_incremental_ingest",
    f"""WITH raw AS (SELECT *, {QUERY_TEXT_DUCK} AS full_text FROM events),
    cut AS (SELECT *, CASE WHEN event_type = 'error' THEN substr(full_text, 1, length(full_text) - 12) ELSE full_text END AS q FROM raw)
    SELECT concat(epoch_us(ts) // 1000, '|10_0_0_', user_id, '|', event_type, '|', cast(trunc(value) AS BIGINT), '|es-', user_id) AS doc_id,
      'north' AS task_id, event_type AS index_name, value AS duration_ms, {mask_sql('q')} AS template, md5({mask_sql('q')}) AS check_sum,
      CASE WHEN event_type = 'error' THEN 'non-json' ELSE 'json' END AS dsl_format FROM cut""",
)
def t01(t: Tables):
    path, s = t.scratch("ingested"), streams(t)
    # Two overlapping pulls of the same window.
    pulls = vendor_a_rows(s).unionByName(vendor_a_rows(s))

    def documents(batch):
        return fields_a(batch, task="north").withColumn("ingest_date", F.lit(REPORT_DAY))

    for _ in range(2):
        # The second run starts from the checkpoint and finds nothing new.
        ingest.ingest(pulls, path, f"{path}-checkpoint", documents, finish=with_template).awaitTermination()
    return ingest.current(t.spark, path).select(
        "doc_id", F.col("taskId").alias("task_id"), F.col("indexName").alias("index_name"),
        F.col("durationMs").alias("duration_ms"), F.col("dslFormat").alias("dsl_format"),
        F.col("queryTemplate").alias("template"), F.col("checkSum").alias("check_sum"),
    )


@query("t02_stream_dedup", "SELECT event_id, event_type FROM events")
def t02(t: Tables):
    path, s = t.scratch("deduped"), streams(t)
    pulls = s.events.unionByName(s.events).withColumn("event_time", F.col("ts").cast("timestamp"))
    out = ingest.dedup(pulls, "event_time", 60 * 24 * 40, ["event_id"]).select("event_id", "event_type")
    ingest.append(out, path, f"{path}-checkpoint").awaitTermination()
    return t.spark.read.parquet(path)


@query(
    "t03_inside_look_back",
    "SELECT event_id FROM events WHERE ts >= CASE WHEN ts < TIMESTAMP '2024-01-16' THEN TIMESTAMP '2024-01-14' ELSE TIMESTAMP '2024-01-29' END",
)
def t03(t: Tables):
    # Two pulls, each with a look-back of two days.
    pull = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), F.lit("2024-01-16")).otherwise(F.lit("2024-01-31"))
    return accepted(t.events, "ts", pull.cast("timestamp_ntz"), 2 * 24 * 60).select("event_id")


# Pulls end at these days; every seventh event comes ten days, every eleventh one day late.
PULLS = ("2024-01-11", "2024-01-21", "2099-01-01")
ARRIVED_SQL = "ts + CASE WHEN event_id % 7 = 0 THEN INTERVAL {0} WHEN event_id % 11 = 0 THEN INTERVAL {1} ELSE INTERVAL {2} END"
DELAY_DAYS = 2


@query(
    "t03_late_rows_stream",
    f"""WITH landed AS (SELECT event_id, ts, CASE {" ".join(f"WHEN arrived < TIMESTAMP '{d}' THEN {i}" for i, d in enumerate(PULLS))} END AS batch
      FROM (SELECT *, {ARRIVED_SQL.format("'10 days'", "'1 day'", "'0 days'")} AS arrived FROM events)),
    newest AS (SELECT b.batch, max(a.ts) AS newest FROM (SELECT DISTINCT batch FROM landed) b JOIN landed a ON a.batch < b.batch GROUP BY ALL)
    SELECT event_id, cast(batch AS INT) AS batch, coalesce(ts < newest - INTERVAL '{DELAY_DAYS} days', false) AS late FROM landed LEFT JOIN newest USING (batch)""",
)
def t03_late(t: Tables):
    arrived = F.expr(ARRIVED_SQL.format("10 DAYS", "1 DAY", "0 DAYS"))
    path, source = t.scratch("late"), t.scratch("late-files")
    events, since = t.events.withColumn("arrived", arrived), "1970-01-01"
    for until in PULLS:
        pulled = events.filter((F.col("arrived") >= F.lit(since).cast("timestamp_ntz")) & (F.col("arrived") < F.lit(until).cast("timestamp_ntz")))
        pulled.write.mode("append").parquet(source)
        stream = ingest.file_stream(t.spark, source, pulled.schema)
        late.mark_late(stream, path, f"{path}-checkpoint", "ts", DELAY_DAYS * 24 * 60).awaitTermination()
        since = until
    return late.marked_rows(t.spark, path).select("event_id", F.col("batch").cast("int").alias("batch"), "late")


LIMIT, EXPIRE = 2, 6 * 3600


LIMITER_SQL = f"""WITH RECURSIVE ev AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events),
      st AS (SELECT user_id, min(us) AS us FROM ev GROUP BY user_id
        UNION ALL SELECT st.user_id, min(ev.us) FROM st JOIN ev ON ev.user_id = st.user_id AND ev.us >= st.us + {EXPIRE * 1000000}
        GROUP BY st.user_id, st.us),
      placed AS (SELECT ev.user_id, ev.event_id, ev.us, max(st.us) AS window_start FROM ev JOIN st ON st.user_id = ev.user_id AND st.us <= ev.us
        GROUP BY ALL)
    SELECT event_id, user_id, window_start, row_number() OVER (PARTITION BY user_id, window_start ORDER BY us, event_id) <= {LIMIT} AS accepted
    FROM placed"""


@query("t04_request_limiter", LIMITER_SQL)
def t04(t: Tables):
    requests = t.events.select("event_id", "user_id", F.expr("unix_micros(cast(ts AS timestamp))").alias("at"))
    return limiter.limit_requests(requests, "user_id", F.col("at"), "event_id", LIMIT, EXPIRE).select(
        "event_id", "user_id", "window_start", "accepted"
    )


@query("t04_limiter_stream", LIMITER_SQL)
def t04_stream(t: Tables):
    path, source = t.scratch("verdicts"), t.scratch("requests")
    at = F.expr("unix_micros(cast(ts AS timestamp))")
    requests, since = t.events.select(F.col("user_id").alias("key"), at.alias("at"), F.col("event_id").alias("ident"), "ts"), "1970-01-01"
    with rocksdb(t.spark):
        for until in PULLS:
            day = F.col("ts") >= F.lit(since).cast("timestamp_ntz")
            requests.filter(day & (F.col("ts") < F.lit(until).cast("timestamp_ntz"))).drop("ts").write.mode("append").parquet(source)
            stream = ingest.file_stream(t.spark, source, requests.drop("ts").schema)
            ingest.append(limiter.limit_stream(stream, LIMIT, EXPIRE), path, f"{path}-checkpoint").awaitTermination()
            since = until
    return t.spark.read.parquet(path).select(
        F.col("ident").alias("event_id"), F.col("key").alias("user_id"), "window_start", "accepted"
    )


@query(
    "t05_daily_inspection",
    f"""WITH {DOCS_SQL}, {SLOW_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, "checkSum" AS check_sum, count(*) AS doc_count,
      max("durationMs") AS max_duration, round(({MEAN}) * 100) / 100 AS avg_duration FROM slow GROUP BY ALL""",
)
def t05(t: Tables):
    path = t.scratch("daily-report")
    docs = streams(t).events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("ingest_date"),
        F.expr("CASE WHEN event_type IN ('click', 'view') THEN 'north' ELSE 'south' END").alias("brand"),
        F.col("value").alias("durationMs"),
        mask_json(F.expr(QUERY_TEXT_SPARK)).alias("template"),
    )
    slow = docs.filter(slow_for_source(F.col("brand"), F.col("durationMs"), THRESHOLDS)).withColumn(
        "checkSum", fingerprint(F.col("template"))
    )
    report.write_buckets(slow, path, f"{path}-checkpoint").awaitTermination()
    return report.current_buckets(t.spark, path).select(
        "day", F.col("checkSum").alias("check_sum"), "doc_count", "max_duration",
        (F.round(F.col("avg_duration") * 100) / 100).alias("avg_duration"),
    )


@query(
    "t06_stream_deny_list",
    "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000)",
)
def t06(t: Tables):
    path = t.scratch("denied")
    denied = t.customer.filter("c_acctbal < 2000").select(F.col("c_custkey").alias("user_id"))
    out = ingest.deny(streams(t).events, denied, "user_id").select("event_id", "user_id")
    ingest.append(out, path, f"{path}-checkpoint").awaitTermination()
    return t.spark.read.parquet(path)


@query(
    "t07_thread_dump_ingest",
    "SELECT source AS instance_id, md5(text) AS dump_hash, concat(n_chars, ';', doc_id) AS usages FROM documents",
)
def t07(t: Tables):
    landed, path = t.scratch("dump-files"), t.scratch("dump-table")
    dump = F.concat(
        F.col("n_chars"), F.lit("% (1ms out of 2s) cpu usage by thread x\n"), F.col("doc_id"),
        F.lit("% (1ms out of 2s) block usage by thread y\n--\n"), F.col("text"),
    )
    t.documents.select(dump.alias("value"), F.col("source").alias("instanceId")).write.partitionBy("instanceId").text(
        landed, lineSep=DUMP_END
    )
    dumps = stream_dumps(t.spark, landed, DUMP_END)
    body = F.regexp_replace("rawText", r"(?s)\A.*?\n--\n", "")
    out = dumps.select(
        F.col("instanceId").alias("instance_id"), F.md5(body).alias("dump_hash"),
        usage_percentages(F.col("rawText")).alias("usage"), ingest.now_millis().alias("taken_at"),
    )
    ingest.append(out, path, f"{path}-checkpoint").awaitTermination()
    usages = F.array_join(F.transform("usage", lambda u: u.cast("bigint").cast("string")), ";")
    return t.spark.read.parquet(path).select("instance_id", "dump_hash", usages.alias("usages"))


@query(
    "t08_audit_stream",
    """SELECT page_id, CASE WHEN starts_with(url, 'https') THEN 'GET' ELSE 'POST' END AS method,
      CASE WHEN starts_with(url, 'https') THEN concat('{"id":"', page_id, '","u":"1"}')
        WHEN octet_length(encode(html)) > 1024 THEN '[超出记录长度]' ELSE html END AS body,
      cast(1500000 AS BIGINT) AS latency FROM pages""",
)
def t08(t: Tables):
    path = t.scratch("audit")
    pages = streams(t).pages
    began = F.lit("2024-01-01 00:00:00").cast("timestamp")
    requests = pages.select(
        F.col("page_id").cast("string").alias("ip"),
        F.when(F.startswith("url", F.lit("https")), "GET").otherwise("POST").alias("method"),
        F.col("url").alias("path"),
        F.concat(F.lit("u=1&id=7&id="), F.col("page_id")).alias("query"),
        F.col("html").alias("body"),
        F.lit("text/html").alias("content_type"),
        F.lit(200).alias("status"),
        began.alias("started"),
        (began + F.expr("INTERVAL '0.0015' SECOND")).alias("ended"),
        F.lit("12").alias("user_id"),
    )
    ingest.append(audit.audit_records(requests), path, f"{path}-checkpoint").awaitTermination()
    return t.spark.read.parquet(path).select(F.col("ip").cast("bigint").alias("page_id"), "method", "body", "latency")


@query(
    "a11_ingest_metrics",
    """WITH e AS (SELECT concat('es-', user_id % 50) AS instance, CASE WHEN event_type = 'error' THEN 'cut off'
        WHEN value < 1 THEN 'too short' WHEN user_id % 50 = 3 THEN 'unknown instance' END AS reason,
        CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS batch FROM events)
    SELECT instance, reason, cast(batch AS INT) AS batch, count(*) FILTER (WHERE reason IS NULL) AS succeeded, count(reason) AS failed FROM e GROUP BY ALL""",
)
def a11_stream(t: Tables):
    path, source, since = t.scratch("counted"), t.scratch("counted-files"), "1970-01-01"
    reason = (
        F.when(F.col("event_type") == "error", "cut off")
        .when(F.col("value") < 1, "too short")
        .when(F.col("instance") == "es-3", "unknown instance")
    )

    def named(batch):
        return batch.withColumn("instance", F.concat(F.lit("es-"), F.col("user_id") % 50))

    for until in PULLS:
        day = (F.col("ts") >= F.lit(since).cast("timestamp_ntz")) & (F.col("ts") < F.lit(until).cast("timestamp_ntz"))
        t.events.filter(day).write.mode("append").parquet(source)
        stream = ingest.file_stream(t.spark, source, t.events.schema)
        metrics.ingest_counted(stream, path, f"{path}-checkpoint", "instance", reason, named).awaitTermination()
        since = until
    return metrics.metrics(t.spark, path).select("instance", "reason", "batch", "succeeded", "failed")
