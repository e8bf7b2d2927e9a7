"""Hierarchies stored as (id, parent) rows with 0 for "no parent".

Everything grows by doubling: after r rounds a node's ancestors up to 2^r levels above are known, so a
tree of depth d takes about log2(d) rounds, however deep it is. Each round is an equi-join with unique
ids and is written to the shared folder, which keeps plans short and lets lost executors resume from files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.operators.joins import keys_of
from logharbor.session import cut, load, save

CYCLE = "the parent column holds a cycle"


def _edges(nodes: DataFrame, ident: str, parent: str) -> DataFrame:
    return nodes.filter((F.col(parent) != 0) & F.col(parent).isNotNull()).select(
        F.col(ident).alias("descendant"), F.col(parent).alias("ancestor")
    )


def closure(nodes: DataFrame, ident: str, parent: str) -> DataFrame:
    """All (ancestor, descendant, depth) pairs with depth >= 1.

    Raises on a cycle: its nodes become their own ancestors within log2(its length) rounds.
    """
    spark = nodes.sparkSession
    edges = _edges(nodes, ident, parent).withColumn("depth", F.lit(1))
    schema, written = edges.schema, [save(edges)]
    jump, reach = load(spark, schema, written[0]), 1
    found = jump
    while True:
        if not found.filter("ancestor = descendant").isEmpty():
            raise ValueError(CYCLE)
        pairs = load(spark, schema, *written)
        above = pairs.select(F.col("descendant").alias("mid"), "ancestor", F.col("depth").alias("_d"))
        further = save(
            jump.select("descendant", F.col("ancestor").alias("mid"))
            .join(above, "mid")
            .select("descendant", "ancestor", (F.col("_d") + reach).alias("depth"))
        )
        found = load(spark, schema, further)
        if found.isEmpty():
            return pairs
        written.append(further)
        # The pairs of the largest depth in this round are the next jump.
        reach *= 2
        jump = found.filter(F.col("depth") == reach)


def apply_changes(nodes: DataFrame, changes: DataFrame, ident: str, parent: str) -> DataFrame:
    """(ident, parent) of a tree after changes (ident, parent, deleted), one for a node: inserts, moves and deletes."""
    stay = nodes.select(ident, parent).join(changes.select(ident), ident, "left_anti")
    return stay.unionByName(changes.filter("NOT deleted").select(ident, parent))


def closure_delta(
    pairs: DataFrame, nodes: DataFrame, changes: DataFrame, ident: str, parent: str
) -> tuple[DataFrame, DataFrame]:
    """(removed, added) pairs that bring a closure up to date after changes (ident, parent, deleted) to its nodes.

    ``pairs`` is the closure of ``nodes`` as they were. Only nodes at and below a change get other ancestors: theirs are built anew
    by doubling among themselves, and what is above the topmost of them is taken from pairs that stay. So the work goes with
    the subtrees that changed, and the result with the pairs that differ. A change that closes a cycle raises.
    """
    spark = nodes.sparkSession
    triple = ["ancestor", "descendant", "depth"]
    asked = keys_of(changes, ident)
    below = pairs.join(asked.select(F.col(ident).alias("ancestor")), "ancestor", "left_semi").select(F.col("descendant").alias(ident))
    touched = keys_of(below.unionByName(asked), ident)
    touched = load(spark, touched.schema, save(touched))
    now = apply_changes(nodes, changes, ident, parent).join(touched, ident, "left_semi")
    own = closure(now, ident, parent)
    before = pairs.join(touched.select(F.col(ident).alias("descendant")), "descendant", "left_semi").select(*triple)
    # The topmost of an own path may be a node that has not changed; its ancestors come on top.
    tops = own.join(touched.select(F.col(ident).alias("ancestor")), "ancestor", "left_anti")
    above = pairs.select(F.col("ancestor").alias("_up"), F.col("descendant").alias("ancestor"), F.col("depth").alias("_d"))
    further = tops.join(above, "ancestor").select(F.col("_up").alias("ancestor"), "descendant", (F.col("depth") + F.col("_d")).alias("depth"))
    after = own.select(*triple).unionByName(further.select(*triple))
    after = load(spark, after.schema, save(after))
    return before.join(after, triple, "left_anti"), after.join(before, triple, "left_anti")


def updated(pairs: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """A closure with the result of closure_delta applied."""
    triple = ["ancestor", "descendant", "depth"]
    return pairs.select(*triple).join(removed, triple, "left_anti").unionByName(added.select(*triple))


def reach_from(nodes: DataFrame, ident: str, parent: str, seeds: DataFrame, down: bool) -> DataFrame:
    """(seed, node, depth) of all nodes below (``down``) or above the seeds, each seed itself at depth 0.

    ``seeds`` has one column of ids. Only pairs of seeds are built; beside them a round holds one jump per node.
    """
    spark = nodes.sparkSession
    count = nodes.count()
    jump, reach = save(_edges(nodes, ident, parent)), 1
    start = keys_of(seeds, seeds.columns[0]).toDF("seed")
    start = start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    schema, kind, written = start.schema, _edges(nodes, ident, parent).schema, [save(start)]
    while True:
        steps = load(spark, kind, jump)
        if steps.isEmpty():
            return load(spark, schema, *written)
        if reach > count:
            raise ValueError(CYCLE)  # a path cannot have more steps than there are nodes
        near, far = ("ancestor", "descendant") if down else ("descendant", "ancestor")
        moves = steps.select(F.col(near).alias("node"), F.col(far).alias("_to"))
        found = load(spark, schema, *written).join(moves, "node")
        written.append(save(found.select("seed", F.col("_to").alias("node"), (F.col("depth") + reach).alias("depth"))))
        twice = steps.select("descendant", F.col("ancestor").alias("mid")).join(
            steps.select(F.col("descendant").alias("mid"), "ancestor"), "mid"
        )
        jump, reach = save(twice.select("descendant", "ancestor")), reach * 2


def with_self(pairs: DataFrame, nodes: DataFrame, ident: str) -> DataFrame:
    """The closure with every node as its own ancestor at depth 0."""
    own = nodes.select(F.col(ident).alias("ancestor"), F.col(ident).alias("descendant"), F.lit(0).alias("depth"))
    return pairs.select("ancestor", "descendant", "depth").unionByName(own)


def managed_by(nodes: DataFrame, ident: str, parent: str, pairs: DataFrame | None = None) -> DataFrame:
    """What each node may manage: all its descendants, and itself when it is a root."""
    pairs = closure(nodes, ident, parent) if pairs is None else pairs
    roots = nodes.filter(F.col(parent) == 0)
    return with_self(pairs, roots, ident)


def _of_roots(pairs: DataFrame, nodes: DataFrame, ident: str, parent: str) -> DataFrame:
    """Pairs whose depth-0 rows are those of roots only."""
    roots = nodes.filter(F.col(parent) == 0).select(F.col(ident).alias("ancestor")).distinct()
    own = pairs.filter("depth = 0").join(roots, "ancestor", "left_semi")
    return pairs.filter("depth > 0").unionByName(own)


def descendants(nodes: DataFrame, ident: str, parent: str, of: Column) -> DataFrame:
    """managed_by for the nodes that meet a predicate, found by walking down from them."""
    found = reach_from(nodes, ident, parent, nodes.filter(of).select(ident), down=True)
    pairs = found.select(F.col("seed").alias("ancestor"), F.col("node").alias("descendant"), "depth")
    return _of_roots(pairs, nodes, ident, parent)


def along_ancestors(rows: DataFrame, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """(id, value) where value is combined over all nodes from the top down to each one, by doubling.

    rows (id, up, value) holds every ``up``, null at the tops; combine(above, own) is associative. After r rounds a value
    covers 2^r nodes, and nodes whose values have come to the top are only looked up.
    """
    rows = cut(rows.select("id", "up", "value"))
    count, reach = rows.count(), 1
    open_, done = rows.filter("up IS NOT NULL"), rows.filter("up IS NULL")
    while not open_.isEmpty():
        if reach > count:
            raise ValueError(CYCLE)  # a path cannot have more steps than there are nodes
        every = done.unionByName(open_)
        above = every.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("value").alias("_value"))
        value = combine(F.col("_value"), F.col("value")).alias("value")
        further = cut(open_.join(above, "up").select("id", F.col("_up").alias("up"), value))
        done = done.unionByName(further.filter("up IS NULL"))
        open_, reach = further.filter("up IS NOT NULL"), reach * 2
    return done.select("id", "value")


def forest(nodes: DataFrame, ident: str, parent: str, sort: str) -> DataFrame:
    """Each node with its depth, its path from the root, and whether a root reaches it.

    ``path`` is an array of (sort, id) from the root on, put together by doubling, so ordering by it is the depth-first order
    with siblings by (sort, id). A node below a missing parent is kept with reached = false.
    """
    known = keys_of(nodes, ident).select(F.col(ident).alias("_up"))
    step = F.array(F.struct(F.col(sort).alias("sort"), F.col(ident).alias("id")))
    value = F.struct(step.alias("path"), F.coalesce(F.col(parent) == 0, F.lit(False)).alias("reached"))
    rows = nodes.select(F.col(ident).alias("id"), F.col(parent).alias("_parent"), value.alias("value"))
    rows = rows.join(known, F.col("_parent") == F.col("_up"), "left").select("id", F.col("_up").alias("up"), "value")

    def combine(above: Column, own: Column) -> Column:
        return F.struct(F.concat(above["path"], own["path"]).alias("path"), above["reached"].alias("reached"))

    found = along_ancestors(rows, combine).select(
        F.col("id").alias(ident),
        (F.size("value.path") - 1).alias("depth"),
        F.col("value.path").alias("path"),
        F.col("value.reached").alias("reached"),
    )
    return nodes.join(found, ident)


def linked_forest(nodes: DataFrame, links: DataFrame, ident: str, parent: str, sort: str) -> DataFrame:
    """The forest of the linked nodes; a node whose parent is not linked is not reached and left out."""
    # Written out: the nodes are read for their keys, for the steps and for the result, and each time the semi join would run anew.
    kept = cut(nodes.join(keys_of(links, ident), ident, "left_semi"))
    return forest(kept, ident, parent, sort).filter("reached").drop("reached")


def in_scope(requests: DataFrame, nodes: DataFrame, ident: str, parent: str) -> DataFrame:
    """Requests (caller, target) whose target the caller may manage, found by walking up from the targets."""
    above = reach_from(nodes, ident, parent, requests.select("target"), down=False)
    pairs = above.select(F.col("node").alias("ancestor"), F.col("seed").alias("descendant"), "depth")
    allowed = _of_roots(pairs, nodes, ident, parent).select(
        F.col("ancestor").alias("caller"), F.col("descendant").alias("target")
    )
    return requests.join(allowed, ["caller", "target"], "left_semi")


def with_child_flag(nodes: DataFrame, ident: str, parent: str) -> DataFrame:
    """Add has_children."""
    used = nodes.select(F.col(parent).alias(ident)).distinct().withColumn("has_children", F.lit(True))
    return nodes.join(used, ident, "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def with_parent(nodes: DataFrame, ident: str, parent: str, name: str) -> DataFrame:
    """Add the parent's name; NULL for roots."""
    up = nodes.select(F.col(ident).alias(parent), F.col(name).alias(f"parent_{name}"))
    return nodes.join(up, parent, "left").select(*nodes.columns, f"parent_{name}")


def visible(nodes: DataFrame, ident: str, parent: str, caller: object, strict: bool) -> DataFrame:
    """Nodes a caller sees, found by walking down from where the view begins.

    Loose mode shows every root with its subtree. Strict mode shows a root
    caller itself and its subtree, and any other caller its children with theirs.
    """
    start = nodes.filter(F.col(ident) == caller if strict else F.col(parent) == 0)
    found = reach_from(nodes, ident, parent, start.select(ident), down=True)
    pairs = found.select(F.col("seed").alias("ancestor"), F.col("node").alias("descendant"), "depth")
    seen = _of_roots(pairs, nodes, ident, parent).select(F.col("descendant").alias(ident))
    return nodes.join(keys_of(seen, ident), ident, "left_semi")


def landing(owners: DataFrame, default: str, links: DataFrame, owner: str, node: str, missing: str = "404") -> DataFrame:
    """Replace a default node by ``missing`` when the owner has no link to it."""
    has = links.select(owner, F.col(node).alias(default)).distinct().withColumn("_ok", F.lit(True))
    return owners.join(has, [owner, default], "left").select(
        *[
            F.when(F.col("_ok"), F.col(c)).otherwise(F.lit(missing)).alias(c) if c == default else F.col(c)
            for c in owners.columns
        ]
    )
