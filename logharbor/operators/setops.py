"""Set operations on tables with compound keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.operators.joins import keys_of


def aligned_union(*frames: DataFrame) -> DataFrame:
    """Concatenate frames by column name; missing columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def table_diff(source: DataFrame, table: DataFrame, ignored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys tagged new (only in source), stale (only in table) or ignored.

    Ignored keys are taken out of the source first, so a table row whose key is
    ignored is stale. Each side is reduced to its distinct keys, then one
    aggregate over the tagged union decides: no join, one shuffle.
    """
    keys = list(keys)

    def tagged(df: DataFrame, side: int) -> DataFrame:
        return df.select(*keys, F.lit(side).alias("_side"))

    sides = tagged(source, 1).unionByName(tagged(table, 2)).unionByName(tagged(ignored, 4))
    seen = sides.groupBy(*keys).agg(F.bit_or("_side").alias("_seen"))
    has_source, has_table, is_ignored = [F.col("_seen").bitwiseAND(b) > 0 for b in (1, 2, 4)]
    states = F.array_compact(
        F.array(
            F.when(has_source & ~is_ignored & ~has_table, F.lit("new")),
            F.when(has_table & (is_ignored | ~has_source), F.lit("stale")),
            F.when(is_ignored, F.lit("ignored")),
        )
    )
    return seen.select(*keys, F.explode(states).alias("state"))


def apply_diff(table: DataFrame, diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert the new keys and delete the stale ones; other columns of new rows are NULL."""
    keys = list(keys)
    kept = table.join(diff.filter("state = 'stale'"), keys, "left_anti")
    return kept.unionByName(diff.filter("state = 'new'").select(*keys), allowMissingColumns=True)


def intersection(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key also occurs in other."""
    return df.join(keys_of(other, keys), list(keys), "left_semi")
