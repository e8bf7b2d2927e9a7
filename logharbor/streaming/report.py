"""The inspection report as a stream: per ingest day and fingerprint the slow rows so far.

A micro-batch is summed up on its own and written to its own partition; readers add the batches up.
So there is no state to grow, no row is ever late, and a replayed batch overwrites what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logharbor.operators.aggregates import mean_of_parts, mean_parts, merged_parts

KEYS = ("day", "checkSum")


def batch_buckets(slow: DataFrame, day: str = "ingest_date") -> DataFrame:
    """Count, maximum and the parts of the mean of one batch per day of ingest and fingerprint."""
    return slow.groupBy(F.col(day).cast("string").alias("day"), "checkSum").agg(
        F.count("*").alias("doc_count"),
        F.max("durationMs").alias("max_duration"),
        *[c.alias(n) for n, c in mean_parts(F.col("durationMs")).items()],
    )


def write_buckets(slow: DataFrame, path: str, checkpoint: str, day: str = "ingest_date") -> StreamingQuery:
    """Sum up every batch of a stream of slow rows; ``day`` is the column with their day of ingest."""

    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch_buckets(batch, day)
            .withColumn("batch", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(path)
        )

    return (
        slow.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_buckets(spark: SparkSession, path: str) -> DataFrame:
    """day, checkSum, doc_count, max_duration, avg_duration over all batches so far."""
    parts = merged_parts()
    merged = spark.read.parquet(path).groupBy(*KEYS).agg(
        F.sum("doc_count").alias("doc_count"),
        F.max("max_duration").alias("max_duration"),
        *[c.alias(n) for n, c in parts.items()],
    )
    mean = mean_of_parts({n: F.col(n) for n in parts})
    return merged.withColumn("avg_duration", mean).drop(*parts)
