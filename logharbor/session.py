"""Session settings the package relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the expressions and writers need. Each is set per session
# because the session usually exists before this package is imported.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Duplicate object keys are legal JSON text.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Spark joins shuffled pieces until there is one for each core, up to this size, and splits a hot piece of a join beyond the
    # second one. Short rows grow some tenfold from shuffled bytes to a task's sort, so both sizes bound what a task holds.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16m",
    # Documents are long rows: a batch of them is held by the JVM and by a Python worker at once.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings in RUNTIME_CONF to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    A temporary folder is made only on a local master, where driver and
    executors are one process. On a cluster the setting is required.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame) -> str:
    """Write df to a fresh table in the shared folder and return its path."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return path


def load(spark: SparkSession, schema, *paths: str) -> DataFrame:
    """One scan over tables written by save."""
    return spark.read.schema(schema).parquet(*paths)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the files.

    Later plans are short, survive lost executors without recomputing what led
    here, and know the real size of this data when they choose their joins.
    """
    return load(df.sparkSession, df.schema, save(df))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of streams started inside is kept in RocksDB, which stages with timers need; the setting before comes back after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)
