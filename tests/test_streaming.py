"""Streaming jobs over files that arrive in steps."""

import random

from pyspark.sql import functions as F

from logharbor.session import scratch
from logharbor.streaming import ingest, limiter, report

SECOND = 1_000_000


def plain_limit(requests, limit, expire):
    """The rule, request by request."""
    state, out = {}, {}
    for key, at, ident in sorted(requests, key=lambda r: (r[1], r[2])):
        start, taken = state.get(key, (None, 0))
        if start is None or at >= start + expire * SECOND:
            start, taken = at, 0
        out[ident] = (start, taken < limit)
        state[key] = (start, taken + (taken < limit))
    return out


def requests_of(seed, n=600):
    rng = random.Random(seed)
    # One hot key, bursts at one instant, and long silences.
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 20)}"
        at = rng.choice([rng.randint(0, 3000), rng.randint(0, 60), 50_000 + rng.randint(0, 5)]) * SECOND
        out.append((key, at, i))
    return out


def test_limiter_against_sequential_form(spark):
    for seed, limit, expire in ((1, 2, 10), (2, 1, 60), (3, 5, 1)):
        data = requests_of(seed)
        df = spark.createDataFrame(data, "key string, at bigint, ident int")
        got = limiter.limit_requests(df, "key", F.col("at"), "ident", limit, expire)
        assert {r.ident: (r.window_start, r.accepted) for r in got.collect()} == plain_limit(data, limit, expire)


def test_limiter_stream_keeps_state_between_batches(spark):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    try:
        data = sorted(requests_of(4, 200), key=lambda r: (r[1], r[2]))
        source, out = scratch(spark, "requests"), scratch(spark, "verdicts")
        schema = "key string, at bigint, ident int"
        for part in (data[:70], data[70:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            stream = ingest.file_stream(spark, source, schema)
            ingest.append(limiter.limit_stream(stream, 2, 10), out, f"{out}-checkpoint").awaitTermination()
        got = {r.ident: (r.window_start, r.accepted) for r in spark.read.parquet(out).collect()}
        assert got == plain_limit(data, 2, 10)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def write_step(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_ingest_replaces_by_document(spark):
    source, out = scratch(spark, "docs"), scratch(spark, "table")
    schema = "doc_id string, dslHash string, v int, ingest_date string"
    for step in ([("a", "h", 1, "2024-01-01"), ("b", "h", 1, "2024-01-01")], [("a", "h", 2, "2024-01-01"), ("a", "h", 3, "2024-01-02")]):
        write_step(spark, source, step, schema)
        ingest.ingest(ingest.file_stream(spark, source, schema), out, f"{out}-checkpoint").awaitTermination()
    want = [("2024-01-01", "a", 2), ("2024-01-01", "b", 1), ("2024-01-02", "a", 3)]
    got = ingest.current(spark, out).select(F.col("ingest_date").cast("string"), "doc_id", "v")
    assert sorted(map(tuple, got.collect())) == want
    # A replayed batch overwrites its own partition.
    again = spark.createDataFrame([("a", "h", 2, "2024-01-01"), ("a", "h", 3, "2024-01-02")], schema)
    ingest.write_batch(out, ("dslHash",))(again, 1)
    assert sorted(map(tuple, ingest.current(spark, out).select(F.col("ingest_date").cast("string"), "doc_id", "v").collect())) == want
    ingest.compact(spark, out, f"{out}-day", "2024-01-01")
    assert spark.read.parquet(f"{out}-day").count() == 2


def test_dedup_drops_late_rows(spark):
    source, out = scratch(spark, "late"), scratch(spark, "kept")
    schema = "doc_id string, event_time timestamp"
    steps = [
        [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:00:00")],
        [("b", "2024-01-01 12:00:00")],
        # Inside and outside the half hour of look-back; "b" again.
        [("c", "2024-01-01 11:45:00"), ("d", "2024-01-01 10:30:00"), ("b", "2024-01-01 12:00:00")],
    ]
    for step in steps:
        df = spark.createDataFrame(step, "doc_id string, t string").select("doc_id", F.col("t").cast("timestamp").alias("event_time"))
        df.coalesce(1).write.mode("append").parquet(source)
        stream = ingest.file_stream(spark, source, schema)
        ingest.append(ingest.dedup(stream, "event_time", 30, ["doc_id"]), out, f"{out}-checkpoint").awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_report_adds_up_batches_and_late_rows(spark):
    source, out = scratch(spark, "slow"), scratch(spark, "report")
    schema = "ingest_date string, event_time string, checkSum string, durationMs double"
    steps = (
        [("2024-01-02", "2024-01-02 10:00:00", "x", 1.0)],
        # Two days older than the newest event, but taken in on the same day.
        [("2024-01-02", "2023-12-31 11:00:00", "x", 3.0), ("2024-01-03", "2024-01-03 01:00:00", "x", 5.0)],
    )
    for step in steps:
        write_step(spark, source, step, schema)
        report.write_buckets(ingest.file_stream(spark, source, schema), out, f"{out}-checkpoint").awaitTermination()
    got = report.current_buckets(spark, out).select("day", "doc_count", "max_duration", "avg_duration").collect()
    assert sorted(map(tuple, got)) == [("2024-01-02", 2, 3.0, 2.0), ("2024-01-03", 1, 5.0, 5.0)]


def test_current_prunes_days_and_can_join_them(spark):
    path = scratch(spark, "table")
    schema = "doc_id string, v int, text string, ingest_date string"
    ingest.write_batch(path, ("v",))(spark.createDataFrame([("a", 1, "t", "2024-01-01"), ("a", 2, "u", "2024-01-01")], schema), 0)
    ingest.write_batch(path, ("v",))(spark.createDataFrame([("a", 3, "w", "2024-01-02"), ("b", 1, "t", "2024-01-02")], schema), 1)
    one = ingest.current(spark, path, days=["2024-01-01"], columns=["doc_id", "v"])
    assert [tuple(r) for r in one.collect()] == [("a", 2)]
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan or "PartitionFilters: [(ingest_date" in plan or "ingest_date#" in plan.split("PartitionFilters:")[1][:60]
    both = ingest.current(spark, path, columns=["doc_id", "v"], across_days=True)
    assert sorted(map(tuple, both.collect())) == [("a", 3), ("b", 1)]


def test_a_table_that_is_a_folder_of_files_streams(spark, sf, tmp_path):
    from logharbor.plans.catalog import CATALOG

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got, want = (CATALOG["t08_audit_stream"](spark, folder) for folder in (str(tmp_path), sf))
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() == pages.count()
