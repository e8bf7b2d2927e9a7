"""Fingerprint buckets, counts, distinct groups and per-key picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logharbor.functions.ids import round_cents
from logharbor.operators.joins import numbered

SAMPLE_FIELDS = ("@timestamp", "instanceId", "indexName", "queryText")
MAX_BUCKETS = 10_000


def mean_parts(column: Column) -> dict[str, Column]:
    """Aggregates that exact_mean needs; parts of parts add up (``merged_parts``).

    A sum of doubles depends on how rows are split over tasks, and a mean that ends in half a cent
    would then round either way, so values are summed as decimals of ten places. ``mean_odd`` says that
    a value is there which these cannot carry: infinite, NaN, 1e27 and more, or below 1e-10 but not zero.
    """
    exact = column.try_cast("decimal(38,10)")
    odd = exact.isNull() | ((exact == 0) & (column != 0)) | (F.abs(column) >= 1e27)
    return {
        "mean_exact": F.try_sum(F.when(~odd, exact)),
        "mean_plain": F.sum(column.cast("double")),
        "mean_count": F.count(column),
        "mean_odd": F.coalesce(F.bool_or(odd & column.isNotNull()), F.lit(False)),
    }


def merged_parts() -> dict[str, Column]:
    """mean_parts of rows that hold mean_parts."""
    return {
        "mean_exact": F.try_sum("mean_exact"),
        "mean_plain": F.sum("mean_plain"),
        "mean_count": F.sum("mean_count"),
        "mean_odd": F.bool_or("mean_odd"),
    }


def mean_of_parts(parts: dict[str, Column]) -> Column:
    total = F.when(parts["mean_odd"], parts["mean_plain"]).otherwise(
        F.coalesce(parts["mean_exact"].cast("double"), parts["mean_plain"])
    )
    return total / F.nullif(parts["mean_count"], F.lit(0))


def exact_mean(column: Column) -> Column:
    """Mean of doubles that does not depend on the order of the rows; NULL without values.

    Infinite values and NaN decide it as in floating-point sums.
    """
    return mean_of_parts(mean_parts(column))


def fingerprint_buckets(slow: DataFrame, keys: Sequence[str] = ("checkSum",)) -> DataFrame:
    """Count, maximum and mean duration per fingerprint. An empty mean or maximum reads as 0."""
    return slow.groupBy(*keys).agg(
        F.count("*").alias("doc_count"),
        F.coalesce(F.max("durationMs"), F.lit(0.0)).alias("max_duration"),
        F.coalesce(exact_mean(F.col("durationMs")), F.lit(0.0)).alias("avg_duration"),
    )


def sampled_buckets(slow: DataFrame, keys: Sequence[str] = ("checkSum",)) -> DataFrame:
    """fingerprint_buckets with one sample document: the one with the smallest (timestamp, doc_id)."""
    sample = F.struct(*[F.col(f"`{f}`") for f in SAMPLE_FIELDS])
    return slow.groupBy(*keys).agg(
        F.count("*").alias("doc_count"),
        F.coalesce(F.max("durationMs"), F.lit(0.0)).alias("max_duration"),
        F.coalesce(exact_mean(F.col("durationMs")), F.lit(0.0)).alias("avg_duration"),
        F.min_by(sample, F.struct("`@timestamp`", "doc_id")).alias("sample"),
    )


def top_buckets(buckets: DataFrame, limit: int = MAX_BUCKETS) -> DataFrame:
    """The buckets with the largest counts; ties go to the smaller fingerprint."""
    return buckets.orderBy(F.desc("doc_count"), F.asc("checkSum")).limit(limit)


def rounded(buckets: DataFrame) -> DataFrame:
    """Durations with two decimals."""
    return buckets.withColumns(
        {"max_duration": round_cents(F.col("max_duration")), "avg_duration": round_cents(F.col("avg_duration"))}
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last writer per key."""
    return _pick(df, keys, order, F.max)


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key."""
    return _pick(df, keys, order, F.min)


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    """One row per key: the outermost by order, of equal ones by a hash of the other columns; of rows equal in all one.

    The winner is settled on keys, order and hash alone, so a hot key shrinks before the shuffle and wide rows are neither packed into
    an aggregate nor sorted; rows are then fetched by a hash semi join. df is read twice: write it out first if it is dear.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    if any("map<" in kind or kind == "variant" for _, kind in df.dtypes):
        return _pick_packed(df, keys, order, pick)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0).cast("bigint")
    columns = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]
    rank = F.struct(*[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)], tie.alias("_t"))
    won = df.select(*columns, rank.alias("_rank")).groupBy(*[f"_k{i}" for i in range(len(keys))])
    won = won.agg(pick("_rank").alias("_won")).select(*[f"_k{i}" for i in range(len(keys))], "_won.*").hint("shuffle_hash")
    on = tie == F.col("_t")
    for names, mark in ((keys, "k"), (order, "o")):
        for i, c in enumerate(names):
            on = on & F.col(f"`{c}`").eqNullSafe(F.col(f"_{mark}{i}"))
    # Rows equal in all columns win together.
    return df.join(won, on, "left_semi").dropDuplicates()


def _pick_packed(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    """_pick for columns that can't be compared: the rows go through the aggregate."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(f"`{c}`") for c in order])
    by = F.max_by if pick is F.max else F.min_by
    picked = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank).alias("_row"))
    return picked.select(*[F.col(f"_row.`{c}`").alias(c) if c in rest else F.col(f"`{c}`") for c in df.columns])


def top_hits(df: DataFrame, keys: Sequence[str], order: Sequence[Column], hits: int) -> DataFrame:
    """The first hits rows per key. Spark cuts each task's rows to that many before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= hits).drop("_rank")


def child_counts(children: DataFrame, parent: str) -> DataFrame:
    """Number of children per parent key."""
    return children.groupBy(parent).agg(F.count("*").alias("children"))


def distinct_groups(df: DataFrame, group: str, ident: str) -> DataFrame:
    """Groups with the id they were first seen at."""
    return df.groupBy(group).agg(F.min(ident).alias("first_id"))


def group_of_segment(df: DataFrame, segment: Column, group: str, ident: str) -> DataFrame:
    """First path segment to group; the row with the largest id decides."""
    return df.groupBy(segment.alias("segment")).agg(F.max_by(group, ident).alias("group"))


def distinct_policies(policies: DataFrame) -> DataFrame:
    """Policy rows without repeats."""
    return policies.select("role", "path", "method").distinct()


def nested_map(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """outer -> inner -> value as rows, one for each pair of keys. Repeated pairs take the largest value."""
    return df.groupBy(outer, inner).agg(F.max(value).alias(value))


def children_of(df: DataFrame, parent: str, fields: Sequence[str], position: str = "position") -> DataFrame:
    """Children under their parent key, ordered by the fields as given and numbered from 0."""
    return numbered(df, parent, fields, position)


def run_metrics(df: DataFrame, ok: Column, by: str | None = None, error: Column | None = None) -> DataFrame:
    """Success and failure counts, over all rows or per instance, with the failures by reason.

    ``error`` names the reason of a failed row; the result then has one row per
    instance and reason, so no list of errors is collected.
    """
    keys = [k for k in [by] if k]
    if error is not None:
        df = df.withColumn("reason", F.when(~F.coalesce(ok, F.lit(False)), error))
        keys.append("reason")
    good = F.coalesce(ok, F.lit(False))
    return df.groupBy(*keys).agg(F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))


def with_total(page: DataFrame, rows: DataFrame, name: str = "total") -> DataFrame:
    """Add the total number of rows to a page of them, through a scalar subquery."""
    return page.withColumn(name, rows.agg(F.count("*")).scalar())
