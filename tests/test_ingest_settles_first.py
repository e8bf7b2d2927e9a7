"""What an ingested batch costs: which rows are finished, how often they are prepared, what readers join."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.operators.aggregates import latest
from logharbor.operators.documents import fields_a, flatten_a, with_template
from logharbor.session import scratch
from logharbor.streaming import ingest

SCHEMA = "doc_id string, dslHash string, v int, ingest_date string"


def counted(spark, column):
    """The column through a function that counts the rows it sees."""
    seen = spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    return F.udf(count, T.IntegerType()).asNondeterministic()(column), seen


def test_rows_are_prepared_once_and_only_the_last_are_finished(spark):
    path = scratch(spark, "table")
    rows = [(f"d{i}", f"h{pull}", i, "2024-01-01") for pull in range(3) for i in range(40)]
    first, prepared = counted(spark, F.col("v"))
    second, finished = counted(spark, F.col("v"))
    write = ingest.write_batch(
        path, ("dslHash",), lambda b: b.withColumn("v", first), finish=lambda kept: kept.withColumn("w", second + 1)
    )
    write(spark.createDataFrame(rows, SCHEMA).coalesce(2), 0)
    assert (prepared.value, finished.value) == (120, 40)
    got = spark.read.parquet(path).select("doc_id", "dslHash", "v", "w").collect()
    assert sorted(map(tuple, got)) == sorted((f"d{i}", "h2", i, i + 1) for i in range(40))


def test_fields_with_templates_are_the_documents(spark, sf):
    from logharbor.plans.catalog.base import Tables
    from logharbor.plans.catalog.landing import vendor_a_rows

    raw = vendor_a_rows(Tables(spark, sf))
    whole = flatten_a(raw, task="north")
    parts = with_template(fields_a(raw, task="north")).select(*[f"`{c}`" for c in whole.columns])
    assert sorted(whole.columns) == sorted(parts.columns)
    assert whole.exceptAll(parts).isEmpty() and parts.exceptAll(whole).isEmpty()


def test_the_last_rows_are_those_of_latest(spark):
    deal = random.Random(7)
    rows = [
        (deal.choice(["a", "b", "c", "", None]), deal.choice(["x", "y", None]), deal.choice([1, 2, 3, None]), deal.choice(["2024-01-01", "2024-01-02"]))
        for _ in range(300)
    ]
    rows += [("hot", "x", i % 50, "2024-01-01") for i in range(5000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for order in ([], ["dslHash"], ["v", "dslHash"]):
        rest = [c for c in docs.columns if c not in order and c not in ingest.KEY]
        tied = docs.withColumn("_tie", F.xxhash64(*rest) if rest else F.lit(0))
        want = latest(tied, ingest.KEY, [*order, "_tie"]).drop("_tie").select(*docs.columns)
        got = ingest._last(docs, ingest.KEY, order).select(*docs.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_days_of_one_batch_are_read_without_a_join(spark):
    path = scratch(spark, "table")
    write = ingest.write_batch(path, ("dslHash",))
    write(spark.createDataFrame([("a", "h", 1, "2024-01-01"), ("a", "h", 1, "2024-01-02"), (None, "h", 1, "2024-01-02")], SCHEMA), 0)

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    def rows(df):
        return sorted(tuple(map(str, r)) for r in df.select("ingest_date", "doc_id", "v").collect())

    got = ingest.current(spark, path)
    assert "Join" not in plan(got)
    assert rows(got) == [("2024-01-01", "a", "1"), ("2024-01-02", "a", "1")]
    write(spark.createDataFrame([("a", "h", 2, "2024-01-02"), ("b", "h", 2, "2024-01-02")], SCHEMA), 1)
    assert rows(ingest.current(spark, path)) == [("2024-01-01", "a", "1"), ("2024-01-02", "a", "2"), ("2024-01-02", "b", "2")]
    assert "Join" not in plan(ingest.current(spark, path, days=["2024-01-01"]))
    assert rows(ingest.current(spark, path, days=["2024-01-02"])) == [("2024-01-02", "a", "2"), ("2024-01-02", "b", "2")]
