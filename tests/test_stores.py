"""Pages, file tables, term index, whole files, late rows, metrics and limiter state, on small inputs."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from logharbor.operators import tables, textindex
from logharbor.session import rocksdb, scratch
from logharbor.sinks import files
from logharbor.sources import paged
from logharbor.streaming import ingest, late, limiter, metrics
from tests.test_operators import rows


def local(path):
    return path.removeprefix("file:")


# --- pages ------------------------------------------------------------------------------------

SCHEMA = f"id BIGINT, timestamp BIGINT, tags STRUCT<a: STRING>, node STRING, {paged.ADDED}"


def land(path, pull, node, pages, done=True):
    for n, page in pages.items():
        folder = f"{local(path)}/pull={pull}/node={node}/page={n}"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/a.json", "w") as out:
            out.write(page if isinstance(page, str) else json.dumps({"Result": page}))
    if done:
        paged.mark_done(path, pull)


def records(*ids):
    return [{"id": i, "timestamp": 100 + i, "tags": {"a": f"t{i}"}} for i in ids]


@pytest.fixture
def pages(spark):
    path = scratch(spark, "pages")
    land(path, 1, "whole", {1: records(1, 2), 2: records(3, 4), 3: records(5)})
    land(path, 1, "even", {1: records(6, 7)})  # a full last page without another one
    land(path, 1, "short", {1: records(8), 2: records(9, 10)})  # what comes after a short page is not asked for
    land(path, 1, "empty", {1: []})
    land(path, 1, "gap", {1: records(11, 12), 3: records(13)})
    land(path, 1, "torn", {1: records(14, 15), 2: '{"Result": [{"id": 16'})
    land(path, 1, "odd", {1: [{"id": "no number"}]})
    land(path, 2, "whole", {1: records(20, 21)})
    land(path, 3, "whole", {1: records(30)}, done=False)
    return path


def read(spark, path, **options):
    return paged.register(spark).read.format("paged_logs").schema(SCHEMA).options(path=path, pageSize=2, **options).load()


def test_pages_and_broken_instances(spark, pages):
    got = read(spark, pages)
    good = got.filter("error IS NULL")
    assert rows(good, "node", "id", "page", "pull") == [
        ("even", 6, 1, 1), ("even", 7, 1, 1), ("short", 8, 1, 1), ("whole", 1, 1, 1), ("whole", 2, 1, 1), ("whole", 3, 2, 1),
        ("whole", 4, 2, 1), ("whole", 5, 3, 1), ("whole", 20, 1, 2), ("whole", 21, 1, 2),
    ]
    assert good.filter("tags.a <> concat('t', id)").count() == 0
    bad = {r.node: r.error for r in got.filter("error IS NOT NULL").collect()}
    assert {k: v.split(":")[0] for k, v in bad.items()} == {"gap": "page 2", "torn": "page 2", "odd": "page 1"}
    assert "missing" in bad["gap"]


def test_window_option_and_filters(spark, pages):
    got = read(spark, pages, begin=102, end=104)
    assert rows(got.filter("error IS NULL"), "id") == [(2,), (3,), (4,)]
    assert got.filter("error IS NOT NULL").count() == 3
    assert rows(read(spark, pages).filter("timestamp > 104 AND timestamp <= 107"), "id") == [(5,), (6,), (7,)]


def test_stream_goes_on_after_the_last_pull(spark, pages):
    out = scratch(spark, "pulled")

    def drain():
        stream = paged.register(spark).readStream.format("paged_logs").schema(SCHEMA).options(path=pages, pageSize=2).load()
        ingest.append(stream, out, f"{out}-checkpoint").awaitTermination()
        return spark.read.parquet(out)

    assert drain().filter("error IS NULL").count() == 10
    assert drain().count() == 13
    paged.mark_done(pages, 3)
    assert drain().count() == 14


# --- file tables ------------------------------------------------------------------------------


def test_upsert_rewrites_only_files_with_changed_keys(spark):
    path = scratch(spark, "table")
    base = spark.range(20_000).select(
        F.lit("2024-01-01").alias("day"), F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v")
    ).unionByName(spark.range(10).select(F.lit("2024-01-02").alias("day"), F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("v")))
    files.create(base, path, "key", "day", 200)
    before = {r.file: r.rows for r in files.manifest(spark, path).collect()}
    assert len(before) >= 200
    ids = random.Random(1).sample(range(20_000), 10)
    changes = spark.createDataFrame([("2024-01-01", f"k{i}", -i, s) for i in ids for s in (1, 2)] + [("2024-01-01", "new", 7, 1)], "day string, key string, v bigint, seq int")
    holding = {r[0] for r in files.read(spark, path).filter(F.col("key").isin([f"k{i}" for i in ids]) & (F.col("day") == "2024-01-01")).select("_metadata.file_path").collect()}
    replaced = files.upsert(changes.withColumn("v", F.when(F.col("seq") == 1, 0).otherwise(F.col("v"))), path, "key", "day", ["seq"])
    assert set(replaced) == holding and len(replaced) <= 10
    after = {r.file for r in files.manifest(spark, path).collect()}
    assert before.keys() - after == holding
    got = {(r.day, r.key): r.v for r in files.read(spark, path).collect()}
    want = {("2024-01-01", f"k{i}"): -i if i in set(ids) else i for i in range(20_000)} | {("2024-01-02", f"k{i}"): i for i in range(10)}
    want[("2024-01-01", "new")] = 0
    assert got == want
    # The version before is as it was, and its replaced files are free once it is given up.
    assert files.read(spark, path, version=0, days=["2024-01-01"]).agg(F.sum("v")).first()[0] == sum(range(20_000))
    assert set(files.expired(spark, path, keep=1)) == holding and files.expired(spark, path, keep=2) == []


def test_second_writer_of_a_version_is_told(spark):
    path = scratch(spark, "table")
    kinds = "day string, key string, v bigint, seq int"
    files.create(spark.createDataFrame([("d", "a", 1, 0), ("d", "b", 1, 0)], kinds).drop("seq"), path, "key", "day", 1)
    one, two = (spark.createDataFrame([("d", k, 2, 1)], kinds) for k in "ab")
    files.upsert(one, path, "key", "day", ["seq"], base=0)
    with pytest.raises(files.VersionConflict):
        files.upsert(two, path, "key", "day", ["seq"], base=0)
    files.upsert_retrying(two, path, "key", "day", ["seq"])
    assert rows(files.read(spark, path)) == [("d", "a", 2), ("d", "b", 2)]
    # Replayed changes leave the rows as they are.
    files.upsert(two, path, "key", "day", ["seq"])
    assert rows(files.read(spark, path)) == [("d", "a", 2), ("d", "b", 2)] and files.versions(spark, path) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        files.release(spark, path, 3)
    # A writer that ended between claim and manifest.
    place, system = files._place(spark, f"{path}/manifest/v=4.claim")
    assert system.createNewFile(place)
    with pytest.raises(files.VersionConflict):
        files.upsert(two, path, "key", "day", ["seq"])
    files.release(spark, path, 4)
    files.upsert(two, path, "key", "day", ["seq"])
    assert files.versions(spark, path)[-1] == 4


# --- term index -------------------------------------------------------------------------------


def test_postings_need_no_shuffle_and_texts_are_read_once(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "id int, text string")
    found = textindex.postings(texts, "id", "text")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "term", "id", "deltas") == [("a", 1, [1, 2]), ("b", 1, [2]), ("b", 3, [1])]


def test_index_reads_only_the_asked_buckets(spark):
    path = scratch(spark, "index")
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["red", "Red.", "blue", "x_1", "été", "the", "the the"]) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(200, None), (201, "")]
    textindex.build_index(spark.createDataFrame(texts, "id int, text string"), path, "id", "text", buckets=16)

    def words(text):
        out = "".join(c if c.isalnum() or c == "_" else " " for c in (text or "").lower()).split()
        return out

    want = sorted((i, len({"red", "été"} & set(words(t)))) for i, t in texts if {"red", "été"} & set(words(t)))
    found = textindex.search_any(spark, path, "RED, été absent")
    assert rows(found, "id", "hits") == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters") :]
    assert "bucket#" in scan[: scan.index("]")] and "PushedFilters: [In(term" in plan or "Or(EqualTo" in plan or "In(term" in plan
    phrase = ["the", "red", "the"]
    times = {i: sum(words(t)[k : k + 3] == phrase for k in range(len(words(t)))) for i, t in texts}
    assert rows(textindex.search_phrase(spark, path, "The RED the"), "id", "times") == sorted((i, n) for i, n in times.items() if n)
    assert textindex.search_any(spark, path, " .,").count() == textindex.search_phrase(spark, path, "").count() == 0
    held = textindex.with_positions(spark.read.parquet(path))
    assert {(r.id, r.term): r.at for r in held.collect()} == {
        (i, w): [k for k, x in enumerate(words(t)) if x == w] for i, t in texts for w in set(words(t))
    }


# --- whole files ------------------------------------------------------------------------------


def test_files_are_put_together_in_segments(spark):
    rng = random.Random(6)
    bodies = {i: [bytes(rng.choice(b"abc\xc3\xa9"[:3]) for _ in range(rng.choice([0, 1, 50, 700]))).decode() for _ in range(n)] for i, n in enumerate([1, 3, 40, 25_000])}
    chunks = [(i, k, c, hashlib.md5(c.encode()).hexdigest()) for i, cs in bodies.items() for k, c in enumerate(cs if i < 3 else ["é"] * 25_000)]
    bodies[3] = ["é"] * 25_000
    chunks += [(9, 0, "x", "wrong"), (9, 1, "y", hashlib.md5(b"y").hexdigest()), (10, 0, "", hashlib.md5(b"").hexdigest())]
    bodies[10] = [""]
    df = spark.createDataFrame(rng.sample(chunks, len(chunks)), "f int, chunk_number int, content string, chunk_md5 string")
    totals = spark.createDataFrame([(i, len(b)) for i, b in bodies.items()] + [(9, 2)], "f int, chunk_total bigint")
    got = tables.assemble(df, totals, "f", 300).orderBy("f", "segment").collect()
    for i, parts in bodies.items():
        body, own = "".join(parts).encode(), [r for r in got if r.f == i]
        assert b"".join(r.content for r in own) == body and [r.segment for r in own] == list(range(max(1, -(-len(body) // 300))))
        assert all(len(r.content) == 300 for r in own[:-1])
        assert (own[-1].n_bytes, own[-1].file_md5) == (len(body), hashlib.md5(body).hexdigest()) and all(r.file_md5 is None for r in own[:-1])
    assert {r.f for r in got} == set(bodies)


# --- streams ----------------------------------------------------------------------------------


def steps(spark, source, parts, schema, run):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        run(ingest.file_stream(spark, source, schema)).awaitTermination()


def test_late_rows_are_kept_apart(spark):
    source, out = scratch(spark, "arrived"), scratch(spark, "late")
    stamp = lambda t: spark.sql(f"SELECT timestamp'2024-01-01 {t}'").first()[0]
    parts = [
        [(1, stamp("10:00:00")), (2, stamp("12:00:00")), (3, None)],
        [(4, stamp("11:30:00")), (5, stamp("11:29:59")), (6, stamp("09:00:00"))],
        [(7, stamp("11:30:00")), (8, stamp("15:00:00"))],
        [(9, stamp("14:00:00"))],
    ]
    steps(spark, source, parts, "id int, at timestamp", lambda s: late.mark_late(s, out, f"{out}-checkpoint", "at", 30))
    want = [(1, 0, False), (2, 0, False), (3, 0, True), (4, 1, False), (5, 1, True), (6, 1, True), (7, 2, False), (8, 2, False), (9, 3, True)]
    assert rows(late.marked_rows(spark, out), "id", "batch", "late") == want
    # A replayed batch is held against the same watermark and replaces itself.
    late.write_marked(out, "at", 30)(spark.createDataFrame(parts[1], "id int, at timestamp"), 1)
    assert rows(late.marked_rows(spark, out), "id", "batch", "late") == want


def test_metrics_count_a_replayed_batch_once(spark):
    source, out = scratch(spark, "arrived"), scratch(spark, "counted")
    schema = "instance string, v int"
    parts = [[("a", 1), ("a", -1), ("b", 2)], [("a", None), ("c", 5)]]
    reason = F.when(F.col("v").isNull(), "no value").when(F.col("v") < 0, "negative")
    steps(spark, source, parts, schema, lambda s: metrics.ingest_counted(s, out, f"{out}-checkpoint", "instance", reason))
    metrics.write_counted(out, "instance", reason)(spark.createDataFrame(parts[0], schema), 0)
    got = metrics.metrics(spark, out).select("batch", "instance", F.coalesce("reason", F.lit("")).alias("reason"), "succeeded", "failed")
    assert rows(got) == [(0, "a", "", 1, 0), (0, "a", "negative", 0, 1), (0, "b", "", 1, 0), (1, "a", "no value", 0, 1), (1, "c", "", 1, 0)]
    assert rows(metrics.good_rows(spark, out), "instance", "v") == [("a", 1), ("b", 2), ("c", 5)]


def state_rows(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_limiter_state_goes_with_the_watermark(spark):
    source, out, schema = scratch(spark, "requests"), scratch(spark, "verdicts"), "key string, at bigint, ident int"
    second, left = 1_000_000, []
    parts = [
        [(f"k{i}", (1000 + i) * second, i) for i in range(50)],
        [("k0", 1055 * second, 50), ("k0", 1060 * second, 51), ("k1", 1048 * second, 52)],  # inside, behind, and too late
        [("last", 10_000 * second, 53)],
    ]

    def run(stream):
        query = ingest.append(limiter.limit_stream(stream, 1, 60), out, f"{out}-checkpoint")
        query.awaitTermination()
        left.append(state_rows(query))
        return query

    with rocksdb(spark):
        steps(spark, source, parts, schema, run)
    assert left == [50, 50, 1]
    got = {r.ident: r.accepted for r in spark.read.parquet(out).collect()}
    assert got == {i: True for i in range(50)} | {50: False, 51: True, 53: True}


def test_pages_are_read_once_and_instances_found_without_listing_them(spark, tmp_path, monkeypatch):
    for node, pages in (("a", (1, 2, 3)), ("b", (2,))):
        for page in pages:
            folder = tmp_path / "pull=5" / f"node={node}" / f"page={page}"
            folder.mkdir(parents=True)
            (folder / "x").write_text(json.dumps({"Result": [{"id": page, "timestamp": page}, {"id": page, "timestamp": page}]}))
    paged.mark_done(str(tmp_path), 5)
    kind = spark.createDataFrame([], SCHEMA).schema
    pages, asked = paged.Pages(kind, {"path": str(tmp_path), "pagesize": "2", "begin": "2"}), []
    found = pages.instances(pages.pulls())
    assert [i.keys for i in found] == [{"node": "a"}, {"node": "b"}]
    answer = paged.Pages._answer
    monkeypatch.setattr(paged.Pages, "_answer", lambda self, files, folder: asked.append(folder) or answer(self, files, folder))
    assert [r["id"] for batch in pages.rows(found[0]) for r in batch.to_pylist()] == [2, 2, 3, 3]
    assert len(asked) == 3
    assert [r["error"] for batch in pages.rows(found[1]) for r in batch.to_pylist()] == ["page 1: missing"]
