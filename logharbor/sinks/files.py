"""Copy-on-write tables: an upsert rewrites only the data files that hold changed keys.

    <path>/data/<version>-<random>/_day=.../*.parquet   data files, never changed once written
    <path>/manifest/v=<version>/part-*.parquet          one row per live file: day, file, low, high, rows

A version is its manifest. Files are cut by ranges of the key's hash, and a manifest row has the smallest and largest hash of its file.
An upsert finds the files to rewrite in two steps: changed keys meet manifest rows of their day by ranges of hashes (an equality
join on cells of the hash space, then the bounds), and of the files found only the key column is read, with the name of the
file each row comes from. Files without a changed key are named in the next manifest and neither read further nor written.

Two writers who start from one version can't both win: a version is claimed by creating a file that must not exist, which file systems do
as one step, and the later one gets VersionConflict; ``upsert_retrying`` starts again from the version that won. Readers see whole versions,
since a version counts once its manifest has its _SUCCESS file; ``release`` frees the claim of a writer that ended before that. Old files
stay until a job removes what ``expired`` names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logharbor.operators.aggregates import latest
from logharbor.session import cut

#: Cells of the hash space that files and keys meet by.
CELL_BITS = 12
MANIFEST = "day STRING, file STRING, low BIGINT, high BIGINT, `rows` BIGINT"
ATTEMPTS = 3


class VersionConflict(Exception):
    """Another writer has made the version that this one wanted to make."""


def _hash(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"))


def _cell(h: Column) -> Column:
    return F.shiftright(h, 64 - CELL_BITS)


def _place(spark: SparkSession, path: str):
    """A path and the file system that it belongs to."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _entries(spark: SparkSession, path: str) -> list[str]:
    folder, files = _place(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are whole, oldest first."""
    found = [int(n[2:]) for n in _entries(spark, f"{path}/manifest") if re.fullmatch(r"v=\d+", n)]
    return sorted(v for v in found if "_SUCCESS" in _entries(spark, f"{path}/manifest/v={v}"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The live files of a version, of the newest one if none is given."""
    if version is None:
        version = versions(spark, path)[-1]
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v={version}")


def _schema(spark: SparkSession, path: str):
    """The schema of the table's data, as the first version's folder has it."""
    first = next(n for n in sorted(_entries(spark, f"{path}/data")) if n.startswith("0-"))
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/data/{first}").schema


def _scan(spark: SparkSession, path: str, files: Sequence[str], schema=None) -> DataFrame:
    schema = schema or _schema(spark, path)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files)


def _write(rows: DataFrame, path: str, version: int, key: str, day: str, files: int) -> DataFrame:
    """Write rows as the data files of a version; gives their manifest rows. The day stays a column of the files."""
    data = f"{path}/data/{version}-{uuid.uuid4().hex}"
    dealt = rows.withColumn("_h", _hash(key)).repartitionByRange(files, day, "_h").sortWithinPartitions(day, "_h")
    dealt.drop("_h").withColumn("_day", F.col(day)).write.partitionBy("_day").parquet(data)
    spark = rows.sparkSession
    written = spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(data)
    h = _hash(key)
    return written.groupBy(F.col(day).cast("string").alias("day"), F.col("_metadata.file_path").alias("file")).agg(
        F.min(h).alias("low"), F.max(h).alias("high"), F.count("*").alias("rows")
    )


def _publish(entries: DataFrame, path: str, version: int) -> None:
    claim, files = _place(entries.sparkSession, f"{path}/manifest/v={version}.claim")
    if not files.createNewFile(claim):
        raise VersionConflict(f"version {version} is there already")
    entries.write.mode("overwrite").parquet(f"{path}/manifest/v={version}")


def release(spark: SparkSession, path: str, version: int) -> None:
    """Free a version that was claimed by a writer that has ended without making it."""
    if version in versions(spark, path):
        raise ValueError(f"version {version} is whole")
    claim, files = _place(spark, f"{path}/manifest/v={version}.claim")
    files.delete(claim, False)


def create(rows: DataFrame, path: str, key: str, day: str, files: int) -> None:
    """A new table of about ``files`` data files."""
    _publish(_write(rows, path, 0, key, day, files), path, 0)


def read(spark: SparkSession, path: str, version: int | None = None, days: Sequence[str] | None = None) -> DataFrame:
    """The rows of a version; with days only the files of these are opened. The list of files is the one that Spark's own scan holds."""
    live = manifest(spark, path, version)
    if days is not None:
        live = live.filter(F.col("day").isin(list(days)))
    return _scan(spark, path, [r[0] for r in live.select("file").collect()])


def touched(spark: SparkSession, path: str, keys: DataFrame, key: str, day: str, version: int | None = None) -> list[str]:
    """The files that hold any of keys (day, key): by their bounds first, then by what is in them."""
    live = manifest(spark, path, version)
    asked = keys.select(F.col(day).cast("string").alias("day"), F.col(key), _hash(key).alias("_h")).distinct()
    over = live.withColumn("_cell", F.explode(F.sequence(_cell(F.col("low")), _cell(F.col("high")))))
    met = asked.withColumn("_cell", _cell(F.col("_h"))).join(over, ["day", "_cell"])
    maybe = [r[0] for r in met.filter(F.col("_h").between(F.col("low"), F.col("high"))).select("file").distinct().collect()]
    if not maybe:
        return []
    held = _scan(spark, path, maybe).select(F.col(day).cast("string").alias("day"), key, F.col("_metadata.file_path").alias("file"))
    return sorted(r[0] for r in held.join(asked, ["day", key], "left_semi").select("file").distinct().collect())


def upsert(changes: DataFrame, path: str, key: str, day: str, order: Sequence[str], base: int | None = None) -> list[str]:
    """Upsert by (day, key) and return the files that were rewritten. Of several changes of a key the last in ``order`` counts.

    ``base`` is the version that the changes were made for, the newest one if none is given.
    """
    spark = changes.sparkSession
    base = versions(spark, path)[-1] if base is None else base
    schema = _schema(spark, path)
    last = cut(latest(changes, [day, key], order).select(*schema.names))
    replaced = touched(spark, path, last, key, day, base)
    stay = _scan(spark, path, replaced, schema).join(last.select(day, key), [day, key], "left_anti")
    # As many files as are replaced, and one more for each as many new rows as a file has.
    live = manifest(spark, path, base)
    per_file = max(1, live.agg(F.max("rows")).first()[0] or 1)
    files = max(1, len(replaced), -(-last.count() // per_file))
    entries = _write(stay.select(*schema.names).unionByName(last), path, base + 1, key, day, files)
    gone = spark.createDataFrame([(f,) for f in replaced], "file STRING")
    _publish(live.join(gone, "file", "left_anti").select("day", "file", "low", "high", "rows").unionByName(entries), path, base + 1)
    return replaced


def upsert_retrying(changes: DataFrame, path: str, key: str, day: str, order: Sequence[str], attempts: int = ATTEMPTS) -> list[str]:
    """upsert, from the newest version again when another writer was faster."""
    for attempt in range(attempts):
        try:
            return upsert(changes, path, key, day, order)
        except VersionConflict:
            if attempt + 1 == attempts:
                raise
    raise VersionConflict("no attempt")


def expired(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Data files that none of the newest ``keep`` versions names, for a cleaning job to remove."""
    known = versions(spark, path)
    live, old = known[-keep:], known[:-keep]
    if not old:
        return []
    every = spark.read.schema(MANIFEST).parquet(*[f"{path}/manifest/v={v}" for v in old]).select("file").distinct()
    used = spark.read.schema(MANIFEST).parquet(*[f"{path}/manifest/v={v}" for v in live]).select("file")
    return sorted(r[0] for r in every.join(used, "file", "left_anti").collect())
