"""Interval labels against the closure walked in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from logharbor.operators import tree, treelabels
from tests.test_operators import plain_closure, rows, tree_of


def plain_tour(parents):
    """{id: (enter, leave, depth)} by a depth-first walk; siblings by (sort, id), parents that are no nodes first among tops."""
    children, tops = {}, sorted({p for p in parents.values() if p and p not in parents})
    for i, p in parents.items():
        children.setdefault(p, []).append(i)
    found, clock = {}, 0
    stack = [(t, 0) for t in reversed([*tops, *sorted(children.get(0, []), key=lambda i: (i % 3, i))])]
    order = []
    while stack:
        node, depth = stack.pop()
        order.append(node)
        found[node] = [clock, clock, depth]
        clock += 1
        stack.extend((c, depth + 1) for c in reversed(sorted(children.get(node, []), key=lambda i: (i % 3, i))))
    for node in reversed(order):
        up = parents.get(node)
        if up:
            found[up][1] = max(found[up][1], found[node][1])
    return {i: tuple(x) for i, x in found.items()}


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(8)
    parents = {1: 0, 2: 0} | {i: i - 1 for i in range(3, 60)} | {i: 1 for i in range(100, 400)}
    parents |= {i: rng.choice(list(parents)) for i in range(400, 700)} | {900: 888, 901: 900, 902: 888}
    nodes = tree_of(spark, parents)
    return parents, nodes, treelabels.labels(nodes, "id", "parent", "sort")


def test_labels_are_a_tour(mixed):
    parents, _, labelled = mixed
    got = {r.id: (r.enter, r.leave, r.depth) for r in labelled.collect()}
    assert got == plain_tour(parents)
    assert [r.id for r in labelled.filter("NOT present").collect()] == [888]
    assert {r.id for r in labelled.filter("top = 888").collect()} == {888, 900, 901, 902}
    assert {r.id for r in labelled.filter("is_root").collect()} == {1, 2}


def test_closure_scope_and_views_from_labels(spark, mixed):
    parents, nodes, labelled = mixed
    pairs = plain_closure(parents)
    assert set(rows(treelabels.closure_of(labelled), "ancestor", "descendant", "depth")) == pairs
    assert treelabels.closure_of(labelled).count() == len(pairs)
    some = treelabels.managed_below(labelled, F.col("id").isin(1, 40))
    assert set(rows(some, "ancestor", "descendant", "depth")) == {p for p in pairs if p[0] in (1, 40)} | {(1, 1, 0)}
    ids = [*parents, 5000]
    rng = random.Random(2)
    asked = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)] + [(1, 1), (3, 3)]
    reach = {p[:2] for p in pairs} | {(1, 1), (2, 2)}
    got = treelabels.in_scope(spark.createDataFrame(asked, "caller bigint, target bigint"), labelled)
    assert rows(got) == sorted(a for a in asked if a in reach)

    def see(caller, strict):
        return {r.id for r in treelabels.visible(nodes, labelled, "id", caller, strict).collect()}

    below = lambda i: {d for a, d, _ in pairs if a == i}
    assert see(1, True) == {1} | below(1)
    assert see(40, True) == below(40)
    assert see(40, False) == {1, 2} | below(1) | below(2)
    assert see(5000, True) == set()


def test_closure_kept_up_to_date(spark):
    rng = random.Random(12)
    parents = {1: 0, 2: 0} | {i: 1 if i < 200 else rng.choice(range(1, i)) for i in range(3, 500)}
    nodes = tree_of(spark, parents)
    pairs = tree.closure(nodes, "id", "parent").select("ancestor", "descendant", "depth")
    for _ in range(3):
        below = lambda i: {d for a, d, _ in plain_closure(parents) if a == i} | {i}
        changes, after = {}, dict(parents)
        for i in rng.sample(sorted(parents), 12):
            up = rng.choice([0, *sorted(set(after) - below(i))])
            if rng.random() < 0.3:
                changes[i] = (parents[i], True)
                del after[i]
            elif not any(up in below(j) for j in changes):  # several moves at once might close a cycle
                changes[i], after[i] = (up, False), up
        fresh = max(parents) + 1
        changes |= {fresh: (rng.choice(sorted(after)), False), fresh + 1: (fresh, False)}
        after |= {k: p for k, (p, gone) in changes.items() if not gone}
        df = spark.createDataFrame([(i, p, gone) for i, (p, gone) in changes.items()], "id bigint, parent bigint, deleted boolean")
        removed, added = tree.closure_delta(pairs, nodes, df, "id", "parent")
        old, new = plain_closure(parents), plain_closure(after)
        assert set(rows(removed)) == old - new and set(rows(added)) == new - old
        assert removed.count() + added.count() == len(old ^ new)
        pairs, parents, nodes = tree.updated(pairs, removed, added), after, tree_of(spark, after)
        assert set(rows(pairs)) == new
    with pytest.raises(ValueError, match="cycle"):
        chain = tree_of(spark, {1: 0, 2: 1, 3: 2})
        df = spark.createDataFrame([(1, 3, False)], "id bigint, parent bigint, deleted boolean")
        tree.closure_delta(tree.closure(chain, "id", "parent"), chain, df, "id", "parent")


def test_cycles_raise(spark):
    with pytest.raises(ValueError, match="cycle"):
        treelabels.labels(tree_of(spark, {1: 3, 2: 1, 3: 2, 4: 0}), "id", "parent", "sort")


def test_chain_of_a_hundred_thousand(spark):
    n = 100_000
    nodes = spark.range(1, n + 1).select("id", (F.col("id") - 1).alias("parent"), F.lit(0).alias("sort"))
    labelled = treelabels.labels(nodes, "id", "parent", "sort")
    wrong = (F.col("enter") != F.col("id") - 1) | (F.col("leave") != n - 1) | (F.col("depth") != F.col("id") - 1)
    assert labelled.count() == n and labelled.filter(wrong).count() == 0
    asked = spark.createDataFrame([(1, n), (n, 1), (77, 76_543), (5, 5)], "caller bigint, target bigint")
    assert rows(treelabels.in_scope(asked, labelled)) == [(1, n), (77, 76_543)]


def test_empty_tree(spark):
    nodes = tree_of(spark, {1: 0}).limit(0)
    assert treelabels.labels(nodes, "id", "parent", "sort").count() == 0


def test_the_loose_view_needs_no_join_by_top(spark):
    nodes = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 2, 1), (4, 3, 1), (5, 9, 1), (6, 5, 1), (7, None, 1), (8, 0, 1)], "id long, parent long, sort int")
    labelled = treelabels.labels(nodes, "id", "parent", "sort")
    assert {r.id for r in labelled.filter("rooted").collect()} == {1, 2, 3, 4, 8}
    seen = treelabels.visible(nodes, labelled, "id", None, False)
    assert {r.id for r in seen.collect()} == {1, 2, 3, 4, 8}
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 1
