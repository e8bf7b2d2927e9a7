"""Interval labels of a tree: (enter, leave, depth) of an Euler tour, one row per node.

A node lies below another exactly if its ``enter`` is inside the other's enter..leave, so closures, scope checks and views are
comparisons of numbers and no pair is stored. Tours visit siblings by (sort, id); trees follow each other in that order.

Labels are made by doubling along the parents, as everything in ``tree``: subtree sizes first, then ``enter`` as the sum over all
ancestors of what stands before each of them among its siblings. A tree of depth d takes about log2(d) rounds, whatever its
number of nodes or their fan-out; rounds are written to the shared folder.

A parent that is not a node of its own gets a row with ``present`` false. Ids must be unique, 0 and null mean "no parent".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.operators.joins import keys_of
from logharbor.operators.ranking import running_sum
from logharbor.operators.tree import CYCLE, along_ancestors
from logharbor.session import cut

#: Neighbouring labels that are compared in one task: a cell of the tour.
CELL = 64
LABELS = ("id", "enter", "leave", "depth", "size", "top", "rooted", "is_root", "present")


def _with_parents(nodes: DataFrame, ident: str, parent: str, sort: str) -> DataFrame:
    """(id, up, sort, is_root, present) of every node and of parents that are none."""
    up = F.when(F.col(parent) != 0, F.col(parent))
    own = nodes.select(
        F.col(ident).alias("id"), up.alias("up"), F.col(sort).alias("sort"), (F.coalesce(F.col(parent) == 0, F.lit(False))).alias("is_root"), F.lit(True).alias("present")
    )
    named = own.filter("up IS NOT NULL").select(F.col("up").alias("id")).distinct()
    missing = named.join(own.select("id"), "id", "left_anti")
    kind = nodes.schema[sort].dataType
    missing = missing.select("id", F.lit(None).cast(nodes.schema[parent].dataType).alias("up"), F.lit(None).cast(kind).alias("sort"), F.lit(False).alias("is_root"), F.lit(False).alias("present"))
    return own.unionByName(missing)


def _sized(rows: DataFrame) -> DataFrame:
    """(id, size, depth, top, rooted) of every node: the nodes of its subtree, the steps to the top of its tree, that top, and whether it is a root.

    In round r a node hands the sum it has to the node 2^r above, whose own sum then reaches as much further down.
    """
    steps = F.when(F.col("up").isNull(), 0).otherwise(1)
    state = cut(rows.select("id", "up", F.lit(1).cast("bigint").alias("size"), steps.alias("depth"), F.coalesce("up", "id").alias("top"), F.col("is_root").alias("rooted")))
    count, reach = state.count(), 1
    while True:
        open_ = state.filter("up IS NOT NULL")
        if open_.isEmpty():
            return state.drop("up")
        if reach > count:
            raise ValueError(CYCLE)
        more = open_.groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("_more"))
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("top").alias("_top"), F.col("rooted").alias("_rooted"))
        moved = open_.join(above, "up").select(
            "id", F.col("_up").alias("up"), "size", (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_top").alias("top"), F.col("_rooted").alias("rooted")
        )
        moved = moved.unionByName(state.filter("up IS NULL"))
        size = (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size")
        state = cut(moved.join(more, "id", "left").select("id", "up", size, "depth", "top", "rooted"))
        reach *= 2


def labels(nodes: DataFrame, ident: str, parent: str, sort: str) -> DataFrame:
    """The labels (LABELS) of every node; ``top`` is the top of its tree, ``rooted`` that this is a root, ``is_root`` that the node itself has parent 0. Raises on a cycle."""
    rows = cut(_with_parents(nodes, ident, parent, sort))
    sized = cut(_sized(rows))
    placed = rows.select("id", "up", "sort").join(sized, "id")
    # What stands before a node among its siblings, and the node above itself.
    placed = placed.withColumn("_group", F.coalesce("up", F.lit(0)))
    before = running_sum(placed, ["_group"], [F.col("sort").asc_nulls_first(), "id"], "size", "_to")
    gain = F.col("_to") - F.col("size") + F.when(F.col("up").isNull(), 0).otherwise(1)
    entered = along_ancestors(before.select("id", "up", gain.alias("value")), lambda over, own: over + own)
    return cut(
        entered.select("id", F.col("value").alias("enter"))
        .join(sized, "id")
        .join(rows.select("id", "is_root", "present"), "id")
        .select("id", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"), "depth", "size", "top", "rooted", "is_root", "present")
    )


def below(labelled: DataFrame, seeds: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) of every node with the seeds above it, each seed itself at depth 0.

    seeds is labels of some nodes. Both sides meet by cell of the tour. Labels are the numbers from 0 on without gaps, so a
    cell holds CELL nodes, and a seed is sent to the cells that its interval overlaps.
    """
    at = labelled.select(F.col("id").alias("descendant"), "enter", F.col("depth").alias("_depth"), F.floor(F.col("enter") / CELL).alias("cell"))
    cells = F.sequence(F.floor(F.col("enter") / CELL), F.floor(F.col("leave") / CELL))
    over = seeds.select(F.col("id").alias("ancestor"), F.col("enter").alias("_from"), F.col("leave").alias("_to"), F.col("depth").alias("_above"), F.explode(cells).alias("cell"))
    met = over.join(at, "cell").filter((F.col("enter") >= F.col("_from")) & (F.col("enter") <= F.col("_to")))
    return met.select("ancestor", "descendant", (F.col("_depth") - F.col("_above")).alias("depth"))


def managed_below(labelled: DataFrame, of: Column) -> DataFrame:
    """What the nodes that meet a predicate on labels may manage: all below, and themselves when they are roots."""
    seeds = labelled.filter(of)
    own_root = seeds.filter("is_root").select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("depth"))
    return below(labelled, seeds).filter("depth > 0").unionByName(own_root)


def closure_of(labelled: DataFrame) -> DataFrame:
    """All (ancestor, descendant, depth) with depth >= 1."""
    inner = labelled.filter("size > 1")
    return below(labelled, inner).filter("depth > 0")


def in_scope(requests: DataFrame, labelled: DataFrame) -> DataFrame:
    """Requests (caller, target) whose target the caller may manage: two lookups and a comparison."""
    caller = labelled.select(F.col("id").alias("caller"), F.col("enter").alias("_from"), F.col("leave").alias("_to"), "is_root")
    target = labelled.filter("present").select(F.col("id").alias("target"), F.col("enter").alias("_at"))
    met = requests.join(target, "target").join(caller, "caller")
    inside = (F.col("_at") > F.col("_from")) & (F.col("_at") <= F.col("_to"))
    own = F.col("is_root") & (F.col("_at") == F.col("_from"))
    return met.filter(inside | own).select(*requests.columns)


def visible(nodes: DataFrame, labelled: DataFrame, ident: str, caller: object, strict: bool) -> DataFrame:
    """Nodes a caller sees. Loose mode shows every root with its subtree. Strict mode shows a root caller itself and its
    subtree, and any other caller its children with theirs. The view is a range of labels."""
    if strict:
        view = labelled.filter(F.col("id") == caller).first()
        if view is None:
            return nodes.limit(0)
        first = view["enter"] if view["is_root"] else view["enter"] + 1
        seen = labelled.filter(F.col("enter").between(first, view["leave"]))
    else:
        # Not a join by top: a large tree would be one key.
        seen = labelled.filter("rooted")
    return nodes.join(keys_of(seen.select(F.col("id").alias(ident)), ident), ident, "left_semi")
