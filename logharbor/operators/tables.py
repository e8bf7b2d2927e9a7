"""Table changes as functions from (table, change) to the new table.

Spark tables on plain files are snapshots, so inserts, updates and deletes are
joins against the change set; the caller writes the result, or the partitions
that changed.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logharbor.operators.aggregates import latest
from logharbor.operators.joins import keys_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def last_changes(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One change per key, the last in ``order``: changes are applied one after the other."""
    if not order:
        raise ValueError("changes need an order, or repeated keys would multiply rows")
    rest = [c for c in changes.columns if c not in keys and c not in order]
    tied = changes.withColumn("_tie", F.xxhash64(*rest) if rest else F.lit(0))
    return latest(tied, keys, [*order, "_tie"]).drop("_tie")


def upsert(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    merge: str = "replace",
) -> DataFrame:
    """Insert or replace rows by key. Among changes with one key the last in ``order`` counts.

    ``order`` names columns of the changes that tell any two changes of one key apart; a hash of
    the other columns breaks further ties. ``merge='coalesce'`` keeps the old value where the change is NULL.
    """
    keys = list(keys)
    changes = last_changes(changes, keys, order)
    changes = changes.select(*base.columns)
    if merge == "replace":
        kept = base.join(keys_of(changes, keys), keys, "left_anti").select(*base.columns)
        return kept.unionByName(changes)
    if merge != "coalesce":
        raise ValueError(f"unknown merge {merge!r}")
    both = base.alias("o").join(changes.alias("n"), keys, "full")
    rest = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in base.columns if c not in keys]
    return both.select(*keys, *rest).select(*base.columns)


def guard_insert(base: DataFrame, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Tag a batch of inserts: ``accepted``, ``exists`` (key in base) or ``duplicate`` (not first in batch)."""
    keys = list(keys)
    first = batch.groupBy(*keys).agg(F.min(order).alias("_first"))
    taken = base.select(*keys).distinct().withColumn("_taken", F.lit(True))
    known = first.join(taken, keys, "left")
    return batch.join(known, keys).select(
        *batch.columns,
        F.when(F.col("_taken"), F.lit("exists"))
        .when(F.col(order) > F.col("_first"), F.lit("duplicate"))
        .otherwise(F.lit("accepted"))
        .alias("status"),
    )


def guard_update(base: DataFrame, changes: DataFrame, ident: str, keys: Sequence[str]) -> DataFrame:
    """Tag key changes: ``accepted`` unless a row with another id holds the new key.

    When several changes claim one free key the smallest id gets it.
    """
    keys = list(keys)
    holders = base.groupBy(*keys).agg(F.min(ident).alias("_low"), F.max(ident).alias("_high"))
    claims = changes.groupBy(*keys).agg(F.min(ident).alias("_claim"))
    known = claims.join(holders, keys, "left")
    held = (F.col("_low") != F.col(ident)) | (F.col("_high") != F.col(ident))
    return changes.join(known, keys).select(
        *changes.columns,
        F.when(F.coalesce(held, F.lit(False)), F.lit("exists"))
        .when(F.col(ident) > F.col("_claim"), F.lit("duplicate"))
        .otherwise(F.lit("accepted"))
        .alias("status"),
    )


def _zero(kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return F.lit(None).cast(kind)


def patch_nonzero(base: DataFrame, changes: DataFrame, ident: str, order: Sequence[str]) -> DataFrame:
    """Overwrite with the fields of a change that are not zero, '' or false.

    Of several changes of one id every field takes the last value in ``order`` that is given.
    """
    fields = [c for c in changes.columns if c != ident and c in base.columns]
    kinds = {f.name: f.dataType for f in base.schema.fields}
    rank = F.struct(*order)
    given = {c: F.nullif(F.col(c), _zero(kinds[c])) for c in fields}
    patch = changes.groupBy(ident).agg(
        *[F.max_by(given[c], F.when(given[c].isNotNull(), rank)).alias(f"_new_{c}") for c in fields]
    )
    joined = base.join(patch, ident, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def patch_columns(
    base: DataFrame, changes: DataFrame, ident: str, order: Sequence[str], stamp: Mapping[str, Column] | None = None
) -> DataFrame:
    """Overwrite the columns a change carries, zeros and NULL included, and stamp the touched rows.

    Of several changes of one id the last in ``order`` counts.
    """
    fields = [c for c in changes.columns if c != ident and c in base.columns]
    patch = last_changes(changes, [ident], order).select(ident, *[F.col(c).alias(f"_new_{c}") for c in fields], F.lit(True).alias("_hit"))
    joined = base.join(patch, ident, "left")
    hit = F.coalesce("_hit", F.lit(False))
    new = {c: F.col(f"_new_{c}") for c in fields} | dict(stamp or {})
    return joined.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in base.columns])


def save_rows(base: DataFrame, rows: DataFrame, ident: str, order: Sequence[str]) -> DataFrame:
    """Replace whole rows by id; unknown ids are inserted."""
    return upsert(base, rows, [ident], order)


def soft_delete(base: DataFrame, ids: DataFrame, ident: str, now: Column, by: Mapping[str, Column] | None = None) -> DataFrame:
    """Stamp ``deleted_at`` on the rows listed in ids that are not yet deleted."""
    marks = ids.select(ident).distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce(F.col("_hit") & F.col("deleted_at").isNull(), F.lit(False))
    new = {"deleted_at": now} | dict(by or {})
    return base.join(marks, ident, "left").select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in base.columns]
    )


def hard_delete(base: DataFrame, ids: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """Remove the rows whose key is listed."""
    return base.join(keys_of(ids, keys), keys, "left_anti")


def cascade_delete(
    tables: Mapping[str, DataFrame], links: Mapping[str, str], ids: DataFrame, ident: str
) -> dict[str, DataFrame]:
    """Remove ids from every table; ``links`` gives the column of each table that holds the id."""
    return {
        name: df.join(keys_of(ids, ident).toDF(links[name]), links[name], "left_anti").select(*df.columns)
        for name, df in tables.items()
    }


def guard_delete(ids: DataFrame, ident: str, references: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Tag ids ``blocked`` when any table still refers to them, else ``deletable``."""
    tagged = ids.withColumn("_blocked", F.lit(False))
    for i, (table, column) in enumerate(references):
        used = table.select(F.col(column).alias(ident)).filter(F.col(ident).isNotNull()).distinct()
        tagged = (
            tagged.join(used.withColumn(f"_used{i}", F.lit(True)), ident, "left")
            .withColumn("_blocked", F.col("_blocked") | F.coalesce(f"_used{i}", F.lit(False)))
            .drop(f"_used{i}")
        )
    return tagged.select(
        *ids.columns, F.when(F.col("_blocked"), F.lit("blocked")).otherwise(F.lit("deletable")).alias("status")
    )


def replace_links(links: DataFrame, owners: DataFrame, new_links: DataFrame, owner: str) -> DataFrame:
    """Drop all links of the owners and insert the new ones; an owner may end up without links."""
    kept = links.join(keys_of(owners, owner), owner, "left_anti").select(*links.columns)
    return kept.unionByName(new_links.select(*links.columns))


def replace_policies(policies: DataFrame, owners: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Replace the policies of roles with the distinct set of the new rows."""
    return replace_links(policies, owners, new_rows.select(*policies.columns).distinct(), "role")


def copy_entity(df: DataFrame, owner: str, old: object, new: object) -> DataFrame:
    """The table with the rows of one owner repeated under a new owner id."""
    kind = df.schema[owner].dataType
    copies = df.filter(F.col(owner) == F.lit(old)).withColumn(owner, F.lit(new).cast(kind))
    return df.unionByName(copies)


def rename_cascade(df: DataFrame, renames: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rewrite a compound key where it is renamed; ``renames`` holds key and new_<key> columns.

    Of several renames of one key the last in ``order`` counts.
    """
    keys = list(keys)
    renames = last_changes(renames, keys, order).select(*keys, *[f"new_{c}" for c in keys])
    joined = df.join(renames.withColumn("_hit", F.lit(True)), keys, "left")
    return joined.select(
        *[F.when(F.col("_hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in keys else F.col(c) for c in df.columns]
    )


def retain_since(df: DataFrame, stamp: str, now: datetime, keep: timedelta) -> DataFrame:
    """Drop rows older than now - keep; a negative age is an error and NULL stamps stay."""
    if keep < timedelta(0):
        raise ValueError("the age to keep must not be negative")
    kind = dict(df.dtypes)[stamp]
    limit = F.lit((now - keep).isoformat(sep=" ")).cast(kind)
    return df.filter((F.col(stamp) >= limit) | F.col(stamp).isNull())


def retain_days(df: DataFrame, partition: str, today: str, days: int) -> DataFrame:
    """Keep the dated partitions of the last days; days <= 0 keeps all. A partition filter only."""
    if days <= 0:
        return df
    return df.filter(F.col(partition).cast("date") >= F.date_sub(F.lit(today).cast("date"), days))


def find_or_create(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Resolve upload requests (file_md5, file_name, chunk_total) against the known files.

    A finished file with the same hash lends its path and the request is
    finished at once (``reused``). Otherwise the open file with the same hash
    and name is continued (``found``), or a new one is opened (``created``).
    """
    requests = wanted.groupBy("file_md5", "file_name").agg(F.max("chunk_total").alias("chunk_total"))
    done = (
        files.filter("is_finish")
        .groupBy("file_md5")
        .agg(F.min_by("file_path", "id").alias("_done_path"), F.lit(True).alias("_done"))
    )
    open_files = files.filter("NOT is_finish").groupBy("file_md5", "file_name").agg(
        F.min("id").alias("_open_id"),
        F.min_by("file_path", "id").alias("_open_path"),
        F.min_by("chunk_total", "id").alias("_open_total"),
    )
    joined = requests.join(done, "file_md5", "left").join(open_files, ["file_md5", "file_name"], "left")
    finished = F.coalesce("_done", F.lit(False))
    return joined.select(
        "file_md5",
        "file_name",
        F.when(finished, F.col("chunk_total")).otherwise(F.coalesce("_open_total", "chunk_total")).alias("chunk_total"),
        F.when(finished, F.col("_done_path")).otherwise(F.col("_open_path")).alias("file_path"),
        finished.alias("is_finish"),
        F.when(finished, F.lit("reused"))
        .when(F.col("_open_id").isNotNull(), F.lit("found"))
        .otherwise(F.lit("created"))
        .alias("outcome"),
    )


def reassemble(chunks: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """Verified chunks (key, chunk_number, content), to be joined in numeric order, with ``complete``.

    A repeated chunk counts once and a chunk whose MD5 differs not at all. A row per chunk whatever
    the size of the file: ordered by (key, chunk_number) the contents are the file. ``complete`` tells
    whether chunks 0..chunk_total-1 are all there.
    """
    good = chunks.filter(F.md5("content") == F.col("chunk_md5"))
    once = good.groupBy(key, "chunk_number").agg(F.min("content").alias("content"))
    files = once.groupBy(key).agg(
        F.count("*").alias("_n"), F.min("chunk_number").alias("_low"), F.max("chunk_number").alias("_high")
    )
    state = totals.select(key, "chunk_total").join(files, key, "left").select(
        key,
        F.coalesce(
            (F.col("_n") == F.col("chunk_total")) & (F.col("_low") == 0) & (F.col("_high") == F.col("chunk_total") - 1),
            F.lit(False),
        ).alias("complete"),
    )
    return once.join(state, key)


def assemble(chunks: DataFrame, totals: DataFrame, key: str, segment_bytes: int = 8 << 20) -> DataFrame:
    """The bytes of every complete file, put together: (key, segment from 0, content, n_bytes, file_md5).

    A file's chunks come to one task in numeric order, Arrow batch by Arrow batch. The task carries the MD5 over them and lets go of a
    segment as soon as it is full, so it holds a batch and a segment of a file, never the file. n_bytes and file_md5, of the
    whole file, are in its last segment. A file without bytes has one empty segment.
    """
    whole = reassemble(chunks, totals, key).filter("complete")
    names = [key, "segment", "content", "n_bytes", "file_md5"]

    def fold(batches):
        file, digest, held, size, segment, length = None, None, [], 0, 0, 0

        def out(last: bool):
            columns = [[file], [segment], [b"".join(held)], [length if last else None], [digest.hexdigest() if last else None]]
            kinds = [kind, pa.int32(), pa.binary(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            kind = batch.schema.field(key).type
            for name, content in zip(batch.column(key).to_pylist(), batch.column("content").cast(pa.binary()).to_pylist(), strict=True):
                if name != file or digest is None:
                    if digest is not None:
                        yield out(last=True)
                    file, digest, held, size, segment, length = name, hashlib.md5(), [], 0, 0, 0
                digest.update(content)
                length += len(content)
                at = 0
                while len(content) - at > segment_bytes - size:
                    cut_at = at + segment_bytes - size
                    held.append(content[at:cut_at])
                    yield out(last=False)
                    at, held, size, segment = cut_at, [], 0, segment + 1
                held.append(content[at:])
                size += len(content) - at
        if digest is not None:
            yield out(last=True)

    ordered = whole.select(key, "chunk_number", "content").repartition(key).sortWithinPartitions(key, "chunk_number")
    ddl = f"{key} {whole.schema[key].dataType.simpleString()}, segment INT, content BINARY, n_bytes BIGINT, file_md5 STRING"
    return ordered.select(key, "content").mapInArrow(fold, ddl)


def leftover_chunks(chunks: DataFrame, assembled: DataFrame, key: str) -> DataFrame:
    """Chunk rows to keep: those of files that are not complete."""
    return chunks.join(assembled.filter("complete").select(key).distinct(), key, "left_anti")
