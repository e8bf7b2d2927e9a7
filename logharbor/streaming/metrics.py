"""Metrics of an ingest run, written with each batch.

A batch's rows are written once, those that fail a check beside the good ones with the reason of the failure. The write is observed: its
totals come out of the write itself, without another pass. Counts per instance and reason are then taken from two
columns of the files just written, must add up to these totals, and replace the batch's own partition of the metrics table. So a
replayed batch counts once, and counts and rows can't drift apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logharbor.sources.landed import spread


def write_counted(path: str, instance: str, reason: Column, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """A foreachBatch function. ``reason`` tells of a prepared row why it failed, null if it didn't; a failed row keeps its columns."""

    def put(df: DataFrame, to: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(to)

    def write(batch: DataFrame, batch_id: int) -> None:
        docs = prepare(spread(batch)) if prepare else batch
        marked = docs.withColumn("reason", reason)
        marked = marked.withColumns({"failed": F.col("reason").isNotNull(), "batch": F.lit(batch_id)})
        totals = Observation(f"batch-{batch_id}")
        put(marked.observe(totals, F.count(F.lit(1)).alias("rows"), F.count("reason").alias("failed")), f"{path}/rows", "batch", "failed")
        own = batch.sparkSession.read.schema(marked.schema).parquet(f"{path}/rows").filter(F.col("batch") == batch_id)
        counts = own.groupBy(F.col(instance).alias("instance"), "reason", "batch").agg(
            F.count_if(~F.col("failed")).alias("succeeded"), F.count_if(F.col("failed")).alias("failed")
        )
        put(counts, f"{path}/metrics", "batch")
        got = metrics(batch.sparkSession, path).filter(F.col("batch") == batch_id)
        rows, failed = got.agg(F.sum(F.col("succeeded") + F.col("failed")), F.sum("failed")).first()
        if (rows or 0, failed or 0) != (totals.get["rows"], totals.get["failed"]):
            raise ValueError(f"batch {batch_id}: {rows} rows and {failed} failures counted, {totals.get} written")

    return write


def ingest_counted(
    stream: DataFrame, path: str, checkpoint: str, instance: str, reason: Column, prepare: Callable[[DataFrame], DataFrame] | None = None
) -> StreamingQuery:
    """Take in everything that has arrived, with metrics, then stop."""
    return (
        stream.writeStream.foreachBatch(write_counted(path, instance, reason, prepare))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(instance, reason, succeeded, failed, batch): one row for each instance and reason of a batch, reason null for what succeeded."""
    schema = "instance STRING, reason STRING, succeeded BIGINT, failed BIGINT, batch INT"
    return spark.read.schema(schema).parquet(f"{path}/metrics")


def good_rows(spark: SparkSession, path: str) -> DataFrame:
    """What succeeded; files of failed rows are not read."""
    return spark.read.parquet(f"{path}/rows").filter("NOT failed").drop("reason", "failed")
