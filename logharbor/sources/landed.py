"""Landed vendor records. Instances, clusters and nodes are directory partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.schemas import VENDOR_A_RAW, VENDOR_B_RAW


#: Tasks per core that a spread scan is parsed in.
PARTS = 4


def spread(scan: DataFrame) -> DataFrame:
    """Give the rows of a scan with fewer splits than cores to all cores, in some parts each.

    Parsing and masking cost far more than reading, and one large gzip file or
    row group is a single split. A scan with enough splits is left as it is, so
    large inputs are not shuffled. Meant for plain scans: it looks at the number
    of splits, which for a plan with shuffles would run them.
    """
    if scan.isStreaming:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(PARTS * cores) if scan.rdd.getNumPartitions() < cores else scan


def look_back(now_millis: int, minutes: int) -> tuple[int, int]:
    """The pull window [now - minutes, now] in epoch milliseconds."""
    return now_millis - minutes * 60_000, now_millis


def read_vendor_a(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Vendor A JSON lines inside a time window (epoch milliseconds, both ends included)."""
    df = spread(spark.read.schema(VENDOR_A_RAW).json(path))
    if start is not None:
        df = df.filter(F.col("timestamp") >= start)
    if end is not None:
        df = df.filter(F.col("timestamp") <= end)
    return df


def read_vendor_b(spark: SparkSession, path: str, level: str = "WARN") -> DataFrame:
    """Vendor B JSON lines of one level below ``cluster=.../node=...`` directories."""
    scan = spark.read.schema(f"{VENDOR_B_RAW}, cluster STRING, node STRING").json(path)
    return spread(scan).filter(F.col("level") == level)


def data_nodes(details: DataFrame, node_type: str = "ess") -> DataFrame:
    """One row per named data node of a cluster detail (id, instances)."""
    return (
        details.select(F.col("id").alias("cluster"), F.explode("instances").alias("i"))
        .filter((F.col("i.type") == node_type) & F.col("i.name").isNotNull())
        .select("cluster", F.col("i.name").alias("node"))
    )


def read_dumps(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Thread dumps below ``instanceId=...`` directories.

    Each file is one dump, or a run of dumps when they are landed with a
    separator between them, which saves a file per dump.
    """
    reader = spark.read.schema("value STRING, instanceId STRING")
    return _dumps(reader, path, separator)


def stream_dumps(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """read_dumps as a stream."""
    reader = spark.readStream.schema("value STRING, instanceId STRING")
    return _dumps(reader, path, separator)


def _dumps(reader, path: str, separator: str | None) -> DataFrame:
    df = reader.text(path, lineSep=separator) if separator else reader.text(path, wholetext=True)
    return df.withColumnRenamed("value", "rawText")


def accepted(df: DataFrame, event_time: str, pull_time: Column, minutes: int) -> DataFrame:
    """Rows still inside the look-back window of their pull; later rows are lost."""
    return df.filter(F.col(event_time) >= pull_time - F.make_dt_interval(mins=F.lit(minutes)))
