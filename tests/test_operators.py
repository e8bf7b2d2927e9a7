"""Operators against plain Python on small tables, with skewed and odd cases."""

from collections import Counter, defaultdict
from datetime import datetime, timedelta
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from logharbor.operators import aggregates, filters, joins, paging, policy, quality, ranking, setops, tables, tree
from logharbor.operators.documents import flatten_a, parse_b
from logharbor.plans.export import Join, Template, as_text, export, export_rows
from logharbor.plans.inspection import inspection_report
from logharbor.session import scratch
from logharbor.sinks import daily, titled
from logharbor.sources import imports, landed
from logharbor.sources.tables import Databases, describe


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


# --- trees ---------------------------------------------------------------------------------


def tree_of(spark, parents):
    return spark.createDataFrame([(i, p, f"n{i}", i % 3) for i, p in parents.items()], "id bigint, parent bigint, name string, sort int")


def plain_closure(parents):
    out = set()
    for node in parents:
        up, depth = parents[node], 1
        while up:
            out.add((up, node, depth))
            up, depth = parents.get(up, 0), depth + 1
    return out


def test_closure_of_mixed_tree(spark):
    rng = random.Random(5)
    # A deep chain, a hot parent with many children, and random branches.
    parents = {1: 0} | {i: i - 1 for i in range(2, 40)} | {i: 1 for i in range(100, 300)}
    parents |= {i: rng.choice(list(parents)) for i in range(300, 400)}
    got = tree.closure(tree_of(spark, parents), "id", "parent")
    assert set(rows(got, "ancestor", "descendant", "depth")) == plain_closure(parents)
    assert got.count() == len(plain_closure(parents))


def test_closure_reports_cycle(spark):
    with pytest.raises(ValueError, match="cycle"):
        tree.closure(tree_of(spark, {1: 3, 2: 1, 3: 2, 4: 0}), "id", "parent")
    looped = tree_of(spark, {1: 3, 2: 1, 3: 2, 5: 3})
    with pytest.raises(ValueError, match="cycle"):
        tree.reach_from(looped, "id", "parent", looped.filter("id = 3").select("id"), down=True)


def test_deep_chain(spark):
    nodes = tree_of(spark, {i: i - 1 for i in range(1, 2101)})
    found = tree.descendants(nodes, "id", "parent", F.col("id").isin(1, 2050))
    assert found.agg(F.max("depth"), F.count("*")).first() == (2099, 2100 + 50)
    asked = spark.createDataFrame([(1, 2100), (2000, 3), (7, 7), (1, 1)], "caller bigint, target bigint")
    assert rows(tree.in_scope(asked, nodes, "id", "parent")) == [(1, 1), (1, 2100)]


def test_forest_orders_by_any_sort_key(spark):
    table = spark.createDataFrame([(1, 0, -5), (2, 0, -7), (3, 0, 12345678901), (4, 0, 9)], "id bigint, parent bigint, sort bigint")
    got = tree.forest(table, "id", "parent", "sort").orderBy("path").collect()
    assert [r.id for r in got] == [2, 1, 4, 3]


def test_forest_order_and_orphans(spark):
    parents = {1: 0, 2: 1, 3: 1, 4: 2, 9: 77, 10: 9}
    got = {r.id: r for r in tree.forest(tree_of(spark, parents), "id", "parent", "sort").collect()}
    assert [i for i in sorted(got, key=lambda i: got[i].path) if got[i].reached] == [1, 3, 2, 4]
    assert not got[9].reached and not got[10].reached
    assert got[4].depth == 2


def test_visible_modes(spark):
    nodes = tree_of(spark, {1: 0, 2: 1, 3: 2, 4: 0, 5: 77})
    see = lambda caller, strict: [r[0] for r in rows(tree.visible(nodes, "id", "parent", caller, strict), "id")]
    assert see(1, True) == [1, 2, 3]
    assert see(2, True) == [3]
    assert see(2, False) == [1, 2, 3, 4]


def test_linked_forest_drops_cut_branches(spark):
    nodes = tree_of(spark, {1: 0, 2: 1, 3: 2, 4: 1})
    links = spark.createDataFrame([(1,), (3,), (4,)], "id bigint")
    assert [r[0] for r in rows(tree.linked_forest(nodes, links, "id", "parent", "sort"), "id")] == [1, 4]


# --- policies ------------------------------------------------------------------------------


def plain_match(path, pattern):
    import re

    regex = re.sub(r":[^/]+", "[^/]+", pattern.replace("/*", "/.*"))
    return re.search(rf"^{regex}\Z", path) is not None


def test_policies_against_brute_force(spark):
    rng = random.Random(3)
    words = ["user", "api", "a.b", "x", "7", ""]
    paths = {"/" + "/".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(60)}
    patterns = {"/user/:id", "/api/*", "/:a/:b", "/user/:id/x", "/a.b/x", "/*", "/user/*/x", "/api/:id/*", "/x(7)?", "/a+b"}
    patterns |= {p for i, p in enumerate(sorted(paths)) if i % 4 == 0}
    requests = spark.createDataFrame([(r, p, m) for r in "uv" for p in paths for m in ("GET", "PUT")], "role string, path string, method string")
    policies = spark.createDataFrame([("u", p, "GET") for p in patterns] * 2 + [("v", "/api/*", "PUT")], "role string, path string, method string")
    want = sorted(
        (r, p, m, t)
        for r in "uv" for p in paths for m in ("GET", "PUT")
        for t in ({"/api/*"} if (r, m) == ("v", "PUT") else patterns if (r, m) == ("u", "GET") else ())
        if plain_match(p, t)
    )
    assert rows(policy.match_policies(requests, policies), "role", "path", "method", "pattern") == want
    allowed = {(r.role, r.path, r.method) for r in policy.allowed(requests, policies).filter("allowed").collect()}
    assert allowed == {w[:3] for w in want}


def test_irregular_patterns_by_their_ends(spark):
    rng = random.Random(9)
    words = ["a", "b", "ab", "x1", "mid", "", "a.b"]
    paths = {"/" + "/".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(150)} | {"/ab", "/a", "/b/x1"}
    patterns = [
        "/*/b", "/a/*/b", "/a/*/mid/*", "/*/mid/*", "/*/mid/*/*", "/:p/*/x1", "/a/?b", "/a/+b", "/(a/b)?/x1", "/(a/mid/)?b", "/a|/b",
        "/a.b/x1", "/[ab]/:q/*", "/(?=a)a/b", "/a\\/b", "/.*/b", "/*/*", "/a/x1?", "/a*/b", "/a/{0,1}b", "/:p/:q/*/b", "//*/a", "/*/",
    ]
    requests = spark.createDataFrame([("u", p, "GET") for p in sorted(paths)], "role string, path string, method string")
    policies = spark.createDataFrame([("u", p, "GET") for p in patterns], "role string, path string, method string")
    want = sorted((p, t) for p in paths for t in patterns if plain_match(p, t))
    assert rows(policy.match_policies(requests, policies), "path", "pattern") == want and len(want) > 100


def test_many_wildcard_patterns_of_one_role_meet_few_requests(spark):
    n = 10_000
    policies = spark.range(n).select(F.lit("u").alias("role"), F.expr("concat('/x', id, '/*/y', id)").alias("path"), F.lit("GET").alias("method"))
    asked = spark.range(n).select(F.lit("u").alias("role"), F.expr("concat('/x', id, '/p/q/y', id)").alias("path"), F.lit("GET").alias("method"))
    _, irregular = policy._indexed(policies)
    ends, inner, rest = policy._by_ends(irregular)
    assert (ends.count(), inner.count(), rest.count()) == (n, 0, 0)
    met = policy._found_by_ends(asked.withColumn("_seg", F.split("path", "/")), ends)
    assert met.count() == n
    assert policy.match_policies(asked, policies).count() == n


def test_pattern_examples(spark):
    cases = [("/user/7", "/user/:id", True), ("/user/7/x", "/user/:id", False), ("/f/a/b", "/f/*", True), ("/f", "/f/*", False)]
    df = spark.createDataFrame(cases, "path string, pattern string, want boolean")
    assert df.filter(policy.path_matches(F.col("path"), F.col("pattern")) != F.col("want")).count() == 0


def test_dotted_patterns_meet_only_what_they_match(spark):
    names = [("r", f"/en/{k}.html", "GET") for k in range(1000, 1400)]
    odd = [("r", p, "GET") for p in ("/a.b.c", "/.", "/v1.0/x", "/x..y", "/é.ü")]
    policies = spark.createDataFrame(names + odd, "role STRING, path STRING, method STRING")
    paths = ["/axb/c", "//", "/a", "/v1.0/x", "/v1/0/x", "/x\ny", "/x\n\ny", "/xaby", "/é😀ü", "/é..ü", "/en/1000xhtml", "/en/1000/html", "/en/10000.html", ""]
    requests = spark.createDataFrame(names + [("r", p, m) for p in paths for m in ("GET", "PUT")], policies.schema)
    want = requests.alias("a").join(policies.alias("b"), ["role", "method"]).filter(policy.path_matches(F.col("a.path"), F.col("b.path")))
    want = {(r[0], r[1]) for r in want.select("a.path", "b.path").collect()}
    got = policy.match_policies(requests, policies).select("path", "pattern").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 405
    # Not every page of a role with every other one.
    dotted = policies.select("role", "method", F.col("path").alias("pattern"))
    assert policy._found_by_length(requests, dotted).count() < 500


def test_dots_are_looked_up_by_place(spark):
    df = spark.createDataFrame([("/a.b/.c", "/axb/yc"), (".", "z")], "pattern STRING, path STRING")
    got = df.select(policy._masked(F.col("path"), policy._dots(F.col("pattern"))) == F.col("pattern")).collect()
    assert all(r[0] for r in got)


# --- quality -------------------------------------------------------------------------------


def test_first_broken_rule(spark):
    rules = {"Page": ["notEmpty"], "PageSize": ["notEmpty"], "Name": ["notEmpty"]}
    df = spark.createDataFrame(
        [Row(id=1, Info=Row(Page=0, PageSize=0), Name="x"), Row(id=2, Info=Row(Page=1, PageSize=10), Name=""), Row(id=3, Info=Row(Page=1, PageSize=10), Name="x")]
    )
    assert rows(quality.violations(df, rules, ["id"])) == [(1, "Page", "notEmpty"), (2, "Name", "notEmpty")]
    assert rows(quality.all_violations(df, rules, ["id"])) == [(1, "Page", "notEmpty"), (1, "PageSize", "notEmpty"), (2, "Name", "notEmpty")]
    assert rows(quality.violation_counts(df, rules)) == [("Name", "notEmpty", 1), ("Page", "notEmpty", 1), ("PageSize", "notEmpty", 1)]
    passed, failed = quality.split_by_rules(df, rules)
    assert (passed.count(), failed.count()) == (1, 2)


def test_rules_by_type(spark):
    df = spark.createDataFrame([("é" * 3, [1, 2], 5, None, True)], "s string, a array<int>, n int, z string, b boolean")
    broken = lambda **rules: quality.violations(df, rules, []).count()
    assert broken(s=["eq=3"]) == 0 and broken(s=["lt=3"]) == 1
    assert broken(a=["ge=2"]) == 0 and broken(a=["gt=2"]) == 1
    assert broken(n=["ne=5"]) == 1 and broken(n=["le=5"]) == 0
    assert broken(z=["notEmpty"]) == 1 and broken(z=["regexp=.*"]) == 1
    assert broken(b=["notEmpty"]) == 0 and broken(b=["eq=1"]) == 1
    assert broken(s=["regexp=^é+=?$"]) == 0


# --- filters, paging -----------------------------------------------------------------------


def test_match_whole_words_only(spark):
    df = spark.createDataFrame([("the cat.",), ("concatenate",), ("CAT_food",), ("naïve cat",), (None,)], "t string")
    assert [r.t for r in df.filter(filters.match_any_term(F.col("t"), "cat dog")).collect()] == ["the cat.", "naïve cat"]


def test_required_range_needs_both_ends():
    with pytest.raises(ValueError):
        filters.required_range(None, "", "2024")


def test_between_needs_two_values(spark):
    with pytest.raises(ValueError):
        filters.conjunction([filters.Condition("r", "x", "BETWEEN")], {"r": 5})


def test_false_is_a_given_value(spark):
    df = spark.createDataFrame([(True,), (False,)], "x boolean")
    assert filters.search(df, [filters.Condition("k", "x")], {"k": False}).count() == 1
    assert filters.search(df, [filters.Condition("k", "x")], {"k": ""}).count() == 2


def test_page_clamp():
    assert paging.clamp_page(0, 500) == (1, 100)
    assert paging.clamp_page(3, 0) == (3, 10)


def test_order_checks(spark):
    df = spark.range(3)
    for bad in ("nope", "id up", "id desc; drop"):
        with pytest.raises(ValueError):
            paging.checked_order(df, bad)


def test_pages_add_up(spark):
    df = spark.createDataFrame([(i, i % 4) for i in range(23)], "id int, g int")
    order = ["g", "id"]
    pages = [tuple(r) for p in range(1, 6) for r in paging.page_of(df, p, 5, order).collect()]
    assert pages == [tuple(r) for r in df.orderBy(*order).collect()]


def test_large_slices_match_small_ones(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 7) for i in range(500)], "id int, g int").repartition(5)
    order = [F.desc("g"), F.asc("id")]
    whole = [tuple(r) for r in df.orderBy(*order).collect()]
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", 10)
    for offset, limit in ((0, 50), (120, 30), (490, 30), (77, None), (600, 5)):
        want = whole[offset : None if limit is None else offset + limit]
        assert [tuple(r) for r in ranking.slice_of(df, order, offset, limit).collect()] == want


def test_rank_of_hot_group(spark):
    df = spark.createDataFrame([("hot", i * 7 % 400) for i in range(400)] + [("cold", 3), ("cold", 1)], "k string, v int")
    got = ranking.rank_within(df.repartition(6), ["k"], ["v"], "r")
    assert rows(got, "k", "v", "r") == [("cold", 1, 1), ("cold", 3, 2)] + [("hot", i, i + 1) for i in range(400)]


# --- joins with hot keys -------------------------------------------------------------------


def test_hot_parent_keeps_one_form(spark):
    children = spark.createDataFrame([(1, i) for i in range(25_000)] + [(2, 7), (2, 3)], "parent int, child int")
    parents = spark.createDataFrame([(1,), (2,), (3,)], "parent int")
    out = joins.attach_many(parents, children.repartition(5), "parent", "parent", ["child"], "kid").collect()
    by_parent = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.parent, r.position or 0)):
        by_parent[r.parent].append((r.position, r.kid_child))
    assert by_parent[1] == [(i, i) for i in range(25_000)]
    assert by_parent[2] == [(0, 3), (1, 7)] and by_parent[3] == [(None, None)]


def test_copies_of_a_child_are_numbered(spark):
    children = spark.createDataFrame([(1, 7)] * 230 + [(1, 8)] * 3 + [(2, 5)] * 2, "parent int, child int")
    got = rows(aggregates.children_of(children, "parent", ["child"]), "parent", "position", "child")
    assert got == [(1, i, 7 if i < 230 else 8) for i in range(233)] + [(2, 0, 5), (2, 1, 5)]


def test_latest_and_earliest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, seq int, v string")
    assert rows(aggregates.latest(df, ["k"], ["seq"]), "k", "seq") == [("a", 2), ("b", 1)]
    assert rows(aggregates.earliest(df, ["k"], ["seq"]), "k", "v") == [("a", "x"), ("b", "y")]


def test_mean_does_not_depend_on_row_order(spark):
    values = [0.1, 0.2, 0.3, 1e6 + 0.01, 61.4, 5.55] * 50
    means = set()
    for seed in range(4):
        random.Random(seed).shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "durationMs double").repartition(seed + 1)
        means.add(df.agg(aggregates.exact_mean(F.col("durationMs"))).first()[0])
    assert len(means) == 1
    inf = float("inf")
    for values, want in (([1.0, inf, 3.0], inf), ([1e22, 1e22], 1e22), ([1e30, 3e30], 2e30), ([2e-12, 4e-12], 3e-12)):
        df = spark.createDataFrame([(v,) for v in values], "durationMs double")
        assert df.agg(aggregates.exact_mean(F.col("durationMs"))).first()[0] == pytest.approx(want)
    none = spark.createDataFrame([(None,)], "durationMs double")
    assert none.agg(aggregates.exact_mean(F.col("durationMs"))).first()[0] is None


def test_labels_keep_order_and_gaps(spark):
    df = spark.createDataFrame([(1, ["b", "z", "a"]), (2, [])], "id int, codes array<string>")
    labels = spark.createDataFrame([("a", "A"), ("b", "B")], "code string, label string")
    got = {r.id: r.names for r in joins.with_labels(df, "id", "codes", labels, "label", "names").collect()}
    assert got == {1: ["B", None, "A"], 2: []}


def test_chain_join_rejects_unknown_kind(spark):
    with pytest.raises(ValueError):
        joins.chain_join(spark.range(1), "a", [("CROSS JOIN", "b", spark.range(1), "true")])


# --- sets ----------------------------------------------------------------------------------


def test_applied_diff_leaves_no_diff(spark):
    make = lambda items: spark.createDataFrame(items, "path string, method string")
    source, table, ignored = make([("a", "G"), ("b", "G"), ("i", "G")]), make([("b", "G"), ("c", "G"), ("i", "G")]), make([("i", "G")])
    keys = ["path", "method"]
    diff = setops.table_diff(source, table, ignored, keys)
    assert rows(diff) == [("a", "G", "new"), ("c", "G", "stale"), ("i", "G", "ignored"), ("i", "G", "stale")]
    after = setops.apply_diff(table, diff, keys)
    assert rows(after) == [("a", "G"), ("b", "G")]
    assert rows(setops.table_diff(source, after, ignored, keys)) == [("i", "G", "ignored")]


# --- table changes -------------------------------------------------------------------------


def test_upsert_replay_is_a_no_op(spark):
    base = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "id int, v string")
    change = spark.createDataFrame([(3, "new", 2), (3, "old", 1), (11, "x", 1)], "id int, v string, seq int")
    once = tables.upsert(base, change, ["id"], order=["seq"])
    assert rows(once) == rows(tables.upsert(once, change, ["id"], order=["seq"]))
    assert dict(rows(once))[3] == "new" and once.count() == 11


def test_retention(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 5, 1),), (None,)], "created_at timestamp")
    assert tables.retain_since(df, "created_at", datetime(2024, 5, 2), timedelta(days=90)).count() == 2
    with pytest.raises(ValueError):
        tables.retain_since(df, "created_at", datetime(2024, 5, 2), timedelta(days=-1))
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-09",)], "d string")
    assert tables.retain_days(days, "d", "2024-01-10", 0).count() == 2
    assert tables.retain_days(days, "d", "2024-01-10", 3).count() == 1


def test_reassembly_of_any_size(spark):
    sizes = (("big", 3000), ("gap", 5), ("ok", 3))
    chunks = [(f, n, f"{f}{n};") for f, size in sizes for n in range(size) if (f, n) != ("gap", 2)]
    df = spark.createDataFrame(chunks, "f string, chunk_number int, content string").withColumn("chunk_md5", F.md5("content"))
    totals = spark.createDataFrame(sizes, "f string, chunk_total int")
    out = tables.reassemble(df.unionByName(df), totals, "f")
    text = defaultdict(str)
    for r in sorted(out.collect(), key=lambda r: (r.f, r.chunk_number)):
        text[r.f, r.complete] += r.content
    assert text["big", True] == "".join(f"big{n};" for n in range(3000))
    assert text["ok", True] == "ok0;ok1;ok2;" and ("gap", False) in text
    assert rows(tables.leftover_chunks(df, out, "f").select("f").distinct()) == [("gap",)]


def test_repeated_changes_do_not_multiply_rows(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, v string, w int")
    twice = spark.createDataFrame([(1, "x", 0, 1), (1, "y", 7, 2), (3, "n", 1, 1), (3, "m", 2, 2)], "id int, v string, w int, seq int")
    assert rows(tables.patch_columns(base, twice, "id", ["seq"]), "id", "v", "w") == [(1, "y", 7), (2, "b", 6)]
    assert rows(tables.patch_nonzero(base, twice, "id", ["seq"]), "id", "v", "w") == [(1, "y", 7), (2, "b", 6)]
    assert rows(tables.save_rows(base, twice, "id", ["seq"]), "id", "v", "w") == [(1, "y", 7), (2, "b", 6), (3, "m", 2)]
    merged = tables.upsert(base, twice.withColumn("w", F.lit(None).cast("int")), ["id"], ["seq"], merge="coalesce")
    assert rows(merged.fillna(0), "id", "v", "w") == [(1, "y", 5), (2, "b", 6), (3, "m", 0)]
    renames = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "id int, new_id int, seq int")
    assert rows(tables.rename_cascade(base, renames, ["id"], ["seq"]), "id", "v") == [(2, "b"), (11, "a")]
    with pytest.raises(ValueError):
        tables.upsert(base, twice, ["id"], [])


def test_guards(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    batch = spark.createDataFrame([(5, "a"), (6, "c"), (7, "c")], "id int, name string")
    assert rows(tables.guard_insert(base, batch, ["name"], "id"), "id", "status") == [(5, "exists"), (6, "accepted"), (7, "duplicate")]
    change = spark.createDataFrame([(1, "b"), (2, "b"), (3, "z"), (4, "z")], "id int, name string")
    assert rows(tables.guard_update(base, change, "id", ["name"]), "id", "status") == [
        (1, "exists"), (2, "duplicate"), (3, "accepted"), (4, "duplicate"),
    ]


def test_upsert_daily_keeps_days_apart(spark):
    base, out = scratch(spark, "base"), scratch(spark, "out")
    df = spark.createDataFrame([("2024-01-01", "x", 1), ("2024-01-02", "x", 2)], "ingest_date string, doc_id string, v int")
    daily.overwrite_daily(df, base)
    change = spark.createDataFrame([("2024-01-02", "y", 1), ("2024-01-02", "y", 4), ("2024-01-03", "x", 9)], "ingest_date string, doc_id string, v int")
    assert daily.upsert_daily(spark, change, base, out, ["v"]) == ["2024-01-02", "2024-01-03"]
    got = spark.read.parquet(out).select(F.col("ingest_date").cast("string"), "doc_id", "v")
    assert rows(got) == [("2024-01-02", "x", 2), ("2024-01-02", "y", 4), ("2024-01-03", "x", 9)]


# --- documents and report ------------------------------------------------------------------


def test_flatten_a_drops_bad_time(spark):
    inner = dict(content='{"a":1', host="10.0.0.1", index_name="i", level="WARN", search_time_ms="12.9", search_total_hits="x", search_type="Q",
                 shard_id="3", slow_search_log_type="SEARCHSLOW", total_shards="5")
    data = [Row(contentCollection=Row(**inner, time=t), host="h", instanceId="c", timestamp=1) for t in ("2025-08-01T10:20:30,123", "bad")]
    path = scratch(spark, "a")
    spark.createDataFrame(data).write.json(path)
    (doc,) = flatten_a(landed.read_vendor_a(spark, path), task="t").collect()
    assert doc.doc_id == "1|10_0_0_1|i|12|c" and doc.dslFormat == "non-json" and doc.queryTemplate == '{"a":"?"'
    assert (doc.searchHits, doc.shardTotal, doc.eventTime) == (0.0, 5, "2025-08-01T10:20:30.123Z")


def test_parse_b_drops_rows_without_query(spark):
    data = [('[t] [n] [i][2] took_millis[8], source[{"a":1}], x', "2025-08-01T10:20:30,123"), ("no source", "2025-08-01T10:20:30,123"), ('source[{"a":1}]', "bad")]
    df = spark.createDataFrame([(c, d, "WARN", "c1") for c, d in data], "content string, date string, level string, cluster string")
    (doc,) = parse_b(df).collect()
    assert (doc.doc_id, doc.queryTemplate, doc.shardId) == ("2025-08-01T10:20:30.123Z|n|i|8|c1", '{"a":"?"}', 2)


def test_report_cut_and_names(spark):
    data = [("b", "2024-01-01", f"s{i % 3}", float(i), i, f"d{i}", "es-1", "idx", "q") for i in range(12)]
    docs = spark.createDataFrame(data, "brand string, ingest_date string, checkSum string, durationMs double, `@timestamp` bigint, doc_id string, instanceId string, indexName string, queryText string")
    out = inspection_report(docs, "2024-01-01", {"b": 2.0}, {}, F.lit("now"), limit=2).collect()
    assert [(r.sqlhash, r.MySQLTotalExecutionCounts) for r in out] == [("s2", 4), ("s0", 3)]
    assert out[0].DBInstanceName == joins.UNNAMED + "es-1"


# --- export and import ---------------------------------------------------------------------


def test_export_checks_order(spark):
    t = Template("x", "a", '{"id": "Id"}', order="id desc", limit=2)
    frames = {"a": spark.range(5).select("id")}
    assert [r.Id for r in export_rows(t, frames, {}).collect()] == [4, 3]
    assert [r.Id for r in export_rows(t, frames, {"order": "id", "limit": 1, "offset": 1}).collect()] == [1]
    with pytest.raises(ValueError):
        export(t, frames, {"order": "other"})


def test_export_soft_delete_of_joined_tables(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "id int, deleted_at string")
    b = spark.createDataFrame([(1, "n", None)], "aid int, name string, deleted_at string")
    t = Template("x", "a", '{"a.id": "Id", "b.name": "Name"}', joins=(Join("LEFT JOIN", "b", "b.aid = a.id"),))
    assert export(t, {"a": a, "b": b}, {}).count() == 2
    assert rows(export(t, {"a": a, "b": b}, {"filterDeleted": "true"})) == [("1", "n")]


def test_text_round_trip_with_line_breaks(spark):
    path = scratch(spark, "csv")
    df = spark.createDataFrame([("a\nb", 'say "hi", ok')], "one string, two string")
    titled.write_titled(as_text(df), path)
    assert rows(imports.read_titled(spark, path)) == rows(df)


def test_import_needs_rows(spark):
    path = scratch(spark, "empty")
    titled.write_header(spark.range(1).select(F.lit("x").alias("Id")), path)
    t = Template("x", "a", '{"id": "Id"}')
    with pytest.raises(ValueError):
        imports.import_titled(spark, path, t, spark.createDataFrame([], "id string"), F.current_timestamp())


def test_header_only(spark):
    path = scratch(spark, "header")
    titled.write_header(spark.range(4).select(F.col("id").alias("Key"), F.lit(1).alias("Other")), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["Key,Other"]


# --- sources -------------------------------------------------------------------------------


def test_unknown_database(spark):
    with pytest.raises(KeyError):
        Databases(spark, {}).table("nope", "t")


def test_whole_text_dumps(spark):
    path = scratch(spark, "dumps")
    spark.createDataFrame([("es-1", "a\nb"), ("es-2", "c")], "instanceId string, v string").repartition(1).write.partitionBy("instanceId").text(path)
    assert rows(landed.read_dumps(spark, path), "instanceId", "rawText") == [("es-1", "a\nb\n"), ("es-2", "c\n")]


def test_describe(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    assert rows(describe({"t": df}, {"t": ["id"]}), "table", "column", "type", "is_key", "ordinal", "table_rows") == [
        ("t", "id", "int", True, 1, 1), ("t", "name", "string", False, 2, 1),
    ]


def test_run_metrics_without_reason(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("b", None)], "i string, ok boolean")
    assert rows(aggregates.run_metrics(df, F.col("ok"), by="i")) == [("a", 1, 1), ("b", 0, 1)]
    assert Counter(r.failed for r in aggregates.run_metrics(df, F.col("ok")).collect()) == {2: 1}


# --- picks ---------------------------------------------------------------------------------


def test_picks_by_order_and_ties(spark):
    from logharbor.operators.aggregates import earliest, latest

    data = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 3, "u"), (None, 3, "v"), ("c", None, None), ("c", 0, None)]
    df = spark.createDataFrame(data, "k string, at int, text string")
    last = {r.k: (r.at, r.text) for r in latest(df, ["k"], ["at"]).collect()}
    assert latest(df, ["k"], ["at"]).count() == len(last) == 4
    assert last["a"] == (2, "y") and last["b"] == (None, "z") and last["c"] == (0, None) and last[None] in {(3, "u"), (3, "v")}
    first = {r.k: (r.at, r.text) for r in earliest(df, ["k"], ["at"]).collect()}
    assert first["a"] == (1, "x") and first["c"] == (None, None)
    assert latest(df.repartition(5), ["k"], ["at"]).filter("k IS NULL").first().text == last[None][1]
    packed = df.withColumn("m", F.create_map(F.lit("a"), "at"))
    assert {r.k: r.at for r in latest(packed, ["k"], ["at"]).collect()} == {k: v[0] for k, v in last.items()}


def test_picks_do_not_sort_wide_rows(spark):
    from logharbor.operators.aggregates import latest

    df = spark.createDataFrame([("a", 1, "x")], "k string, at int, text string")
    plan = latest(df, ["k"], ["at"])._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Sort [" in line or "SortAggregate" in line]
    assert "ShuffledHashJoin" in plan and not any("text#" in line for line in sorts)
