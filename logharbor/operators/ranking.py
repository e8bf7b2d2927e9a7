"""Ranks and slices of large ordered data without one task seeing all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logharbor.session import cut

# Up to this many rows Spark's own top-k, which ends in one task, is the better plan; rows are the same.
ONE_TASK_ROWS = 100_000


def _ranged(df: DataFrame, groups: Sequence[str], order: Sequence) -> tuple[DataFrame, DataFrame]:
    """df range-partitioned by (groups, order) with its part number, and the offset of each part per group.

    The parts are written out first, so that counting and ranking see the same ones.
    """
    keys = list(groups) or [F.lit(1)]
    parts = cut(df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy(*groups, "_part").agg(F.count("*").alias("_size"))
    # One row per group and part: a group has no more rows here than there are partitions.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    return parts, offsets


def _ranked(parts: DataFrame, offsets: DataFrame, groups: Sequence[str], order: Sequence, name: str) -> DataFrame:
    local = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    return (
        parts.withColumn("_local", local)
        .join(offsets, [*groups, "_part"])
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_part", "_local", "_size", "_offset")
    )


def rank_within(df: DataFrame, groups: Sequence[str], order: Sequence, name: str = "rank") -> DataFrame:
    """Add the 1-based rank of each row in its group.

    Like row_number, but a hot group is spread over range partitions: a task
    ranks one part, and the sizes of the parts before it give the rest.
    """
    parts, offsets = _ranged(df, groups, order)
    return _ranked(parts, offsets, groups, order, name)


def running_sum(df: DataFrame, groups: Sequence[str], order: Sequence, value: str, name: str) -> DataFrame:
    """Add the sum of value over a group's rows up to and with each one, in a total order; spread like rank_within."""
    parts, _ = _ranged(df, groups, order)
    sums = parts.groupBy(*groups, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*groups, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn("_inside", F.sum(value).over(inside)).join(ahead, [*groups, "_part"])
    return rows.withColumn(name, F.col("_ahead") + F.col("_inside")).drop("_part", "_inside", "_ahead")


def slice_of(df: DataFrame, order: Sequence, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows offset..offset+limit of the ordered data; without a limit all from offset on.

    The order must be total: which rows a slice holds would else depend on the plan.
    """
    if not offset and limit is None:
        return df.orderBy(*order) if order else df
    if not order:
        raise ValueError("a slice needs an order")
    if limit is not None and offset + limit <= ONE_TASK_ROWS:
        ordered = df.orderBy(*order)
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    parts, offsets = _ranged(df, [], order)
    last = F.lit(True) if limit is None else F.col("_offset") < offset + limit
    # Only the parts that overlap the slice are sorted.
    touched = offsets.filter((F.col("_offset") + F.col("_size") > offset) & last)
    ranked = _ranked(parts.join(touched.select("_part"), "_part", "left_semi"), touched, [], order, "_rank")
    inside = F.col("_rank") > offset
    if limit is not None:
        inside = inside & (F.col("_rank") <= offset + limit)
    return ranked.filter(inside).orderBy(*order).select(*df.columns)
