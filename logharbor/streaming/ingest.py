"""Incremental ingest of documents, idempotent under replay.

A micro-batch writes one partition (ingest_date, batch) and overwrites exactly
that partition when it is replayed. Nothing is read back while writing, so a
batch costs its own size, whatever the day already holds. Readers take the last
batch per document; ``compact`` folds a day into one upserted snapshot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logharbor.operators.joins import keys_of
from logharbor.sources.landed import spread

KEY = ("ingest_date", "doc_id")


def file_stream(
    spark: SparkSession, folder: str, schema, glob: str = "*.parquet", per_trigger: int | None = None
) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def write_batch(
    path: str,
    order: Sequence[str],
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    keys: Sequence[str] = KEY,
    finish: Callable[[DataFrame], DataFrame] | None = None,
):
    """A foreachBatch function that upserts into (ingest_date, batch) partitions.

    ``prepare`` turns the rows of a batch into documents; the batch is spread
    over the cores first when it comes in few splits. ``finish`` adds columns
    that follow from the others, one row to one row; it sees only the rows that
    are kept, so what is dear belongs there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        docs = prepare(spread(batch)) if prepare else batch
        rows = _last(docs, keys, [c for c in order if c in docs.columns])
        rows = (finish(rows) if finish else rows).withColumn("batch", F.lit(batch_id))
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("ingest_date", "batch")
            .parquet(path)
        )

    return write


def _last(docs: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by order, then by a hash of all other columns; docs is read once.

    Rows of a key are first brought near each other in pieces of bounded size; Spark splits larger ones, so a hot key fills several.
    It ranks inside each piece before it moves the rows that lead there by key. Copies end in their piece unless it was split; then
    they move twice. The last ranking sorts a shuffle partition of leading rows, so that setting should grow with the input.
    """
    rest = [c for c in docs.columns if c not in order and c not in keys]
    tie = F.xxhash64(*rest) if rest else F.lit(0)
    # A hash of the keys, as pieces dealt by the keys themselves would have to hold them whole.
    near = docs.withColumns({"_tie": tie, "_near": F.xxhash64(*keys)}).hint("rebalance", "_near")
    rank = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], F.desc("_tie"))
    return near.withColumn("_place", F.row_number().over(rank)).filter("_place = 1").drop("_tie", "_near", "_place")


def ingest(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    order: Sequence[str] = ("pulled_at", "dslHash"),
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Run the ingest over everything that has arrived, then stop.

    ``order`` picks the last of a document's rows inside a batch: by time of the pull first; a hash of
    all other columns breaks ties. Columns of it that the documents lack are left out. ``prepare`` and
    ``finish`` are those of ``write_batch``; ``finish`` has no say in which row is the last.
    """
    return (
        stream.writeStream.foreachBatch(write_batch(path, order, prepare, finish=finish))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current(
    spark: SparkSession,
    path: str,
    days: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    across_days: bool = False,
) -> DataFrame:
    """The documents of a table written by ingest: the last batch per (ingest_date, doc_id).

    Only the given days are read, and only the given columns. Which batch is the last is settled on the
    keys alone; rows are then fetched by a semi join, so texts are neither packed nor sorted. In a day of a
    single batch every row is of the last one, and is read as it is; the names of the partitions tell such days.
    With ``across_days`` a document pulled on two days counts once, as it was on the later one.
    """
    table = spark.read.parquet(path)
    day = F.col("ingest_date")
    if days is not None:
        kind = table.schema["ingest_date"].dataType
        table = table.filter(day.isin(*[F.lit(d).cast(kind) for d in days]))
    wanted = [c for c in table.columns if c != "batch"] if columns is None else list(columns)
    if across_days:
        last = table.groupBy("doc_id").agg(F.max(F.struct("ingest_date", "batch")).alias("_l"))
        last = last.select("doc_id", "_l.ingest_date", "_l.batch")
        return table.join(last, [*KEY, "batch"], "left_semi").select(*wanted)
    # One row per day, from the partitions' names.
    spans = table.groupBy("ingest_date").agg((F.min("batch") == F.max("batch")).alias("single")).collect()
    settled = [r.ingest_date for r in spans if r.single and r.ingest_date is not None]
    # Rows without a key are in no result, as in the join.
    whole = table.filter(day.isin(*settled) & F.col("doc_id").isNotNull()).select(*wanted)
    if len(settled) == len(spans):
        return whole
    open_days = table.filter(~day.isin(*settled))
    last = open_days.groupBy(*KEY).agg(F.max("batch").alias("batch"))
    picked = open_days.join(last, [*KEY, "batch"], "left_semi").select(*wanted)
    return whole.unionByName(picked) if settled else picked


def compact(spark: SparkSession, path: str, out_path: str, day: str) -> None:
    """Write one day of an ingested table as a snapshot without superseded rows."""
    rows = current(spark, path, [day])
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingest_date")
        .parquet(out_path)
    )


def dedup(docs: DataFrame, event_time: str, minutes: int, keys: list[str]) -> DataFrame:
    """Drop documents seen before, with state bounded by the look-back.

    A row older than the newest event minus ``minutes`` is late and lost.
    """
    return docs.withWatermark(event_time, f"{minutes} minutes").dropDuplicatesWithinWatermark(keys)


def append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a table folder over everything that has arrived, then stop."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def deny(stream: DataFrame, denied: DataFrame, on: str) -> DataFrame:
    """Stream rows whose key is not on the static deny list."""
    return stream.join(keys_of(denied, on), on, "left_anti")


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())
