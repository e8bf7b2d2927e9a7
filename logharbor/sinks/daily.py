"""Daily partitions by ingest date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.operators.tables import upsert


def with_ingest_date(df: DataFrame, when: Column) -> DataFrame:
    """The date a row was taken in, which names its partition."""
    return df.withColumn("ingest_date", F.date_format(when, "yyyy-MM-dd"))


def append_daily(df: DataFrame, path: str) -> None:
    """Append without identity; repeats are allowed."""
    df.write.mode("append").partitionBy("ingest_date").parquet(path)


def overwrite_daily(df: DataFrame, path: str) -> None:
    """Replace the partitions that occur in df and leave the others alone."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_date")
        .parquet(path)
    )


def upsert_daily(
    spark: SparkSession, changes: DataFrame, base_path: str, out_path: str, order: Sequence[str]
) -> list[str]:
    """Upsert by doc_id inside the days that the changes touch, write these days to out_path and return them.

    Among changes of one document on one day the last in ``order`` counts. The same document taken in
    on two days is two documents. Writing beside the base keeps it readable and whole while the job
    runs and if it is retried; days without changes are not read.
    """
    days = [str(r[0]) for r in changes.select("ingest_date").distinct().collect()]  # one row per day
    base = spark.read.parquet(base_path)
    kind = base.schema["ingest_date"].dataType
    base = base.filter(F.col("ingest_date").isin(*[F.lit(d).cast(kind) for d in days]) if days else F.lit(False))
    base = base.withColumn("ingest_date", F.col("ingest_date").cast("string"))
    changes = changes.withColumn("ingest_date", F.col("ingest_date").cast("string"))
    overwrite_daily(upsert(base, changes, ["ingest_date", "doc_id"], order), out_path)
    return sorted(days)
