"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import cut


def _nearest(links: DataFrame) -> DataFrame:
    """links (u, v) with the smallest neighbour of u beside each; u itself counts."""
    least = links.groupBy("u").agg(F.min("v").alias("_least")).select("u", F.least("u", "_least").alias("m"))
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that links (u, v) name; root is the smallest node of its component.

    Each round hangs larger neighbours below the smallest one (large star), then smaller ones (small star), and
    writes the links that are left. After about log2(longest path) rounds only stars remain. No node's neighbours
    are gathered: minima are partial aggregates and a star's links are joined row by row, so Spark may split them.
    """
    links = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        small = _nearest(large.distinct())
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        links = cut(small.filter("u > v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
