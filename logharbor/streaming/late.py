"""Late rows of a stream, kept apart instead of dropped.

Spark's own watermark drops late rows without a trace. Here each micro-batch writes one partition with all its rows, each marked as
late or not, and the newest event time it has seen; the watermark of a batch is the newest time of the batches before it minus
the delay. All of it is a function of the batch's number and the files of earlier batches, so a replayed batch writes the
same again, and nothing is held as state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _newest(spark: SparkSession, path: str, before: int):
    """The newest event time of the batches before this one; null before the first."""
    if not before:
        return None
    marks = spark.read.schema("newest timestamp, batch bigint").parquet(f"{path}/marks")
    return marks.filter(F.col("batch") < before).agg(F.max("newest")).first()[0]


def write_marked(path: str, event_time: str, minutes: int):
    """A foreachBatch function that writes (batch, late) partitions; a row without a time is late."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _newest(spark, path, batch_id)
        at = F.col(event_time).cast("timestamp")
        bound = F.lit(newest) - F.expr(f"INTERVAL {int(minutes)} MINUTES") if newest is not None else None
        late = at.isNull() if bound is None else at.isNull() | (at < bound)
        marked = batch.withColumns({"watermark": F.lit(bound).cast("timestamp"), "late": late, "batch": F.lit(batch_id)})
        rows = f"{path}/rows"
        put(marked, rows, "batch", "late")
        # Read back from the batch's own files; the scan takes one column.
        own = spark.read.schema(marked.schema).parquet(rows).filter(F.col("batch") == batch_id)
        seen = own.agg(F.max(at).alias("newest")).select(F.coalesce("newest", F.lit(newest).cast("timestamp")).alias("newest"))
        put(seen.withColumn("batch", F.lit(batch_id).cast("bigint")), f"{path}/marks", "batch")

    def put(df: DataFrame, to: str, *by: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(to)

    return write


def mark_late(stream: DataFrame, path: str, checkpoint: str, event_time: str, minutes: int) -> StreamingQuery:
    """Take in everything that has arrived, then stop. Rows more than ``minutes`` older than the newest one of earlier batches are late."""
    return (
        stream.writeStream.foreachBatch(write_marked(path, event_time, minutes))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def marked_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows with ``batch``, ``late`` and the ``watermark`` they were held against; filters on the first two prune files."""
    return spark.read.parquet(f"{path}/rows").withColumn("late", F.col("late").cast("boolean"))
