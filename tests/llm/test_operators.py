"""The operators on small tables: against brute force, and on odd rows."""

import hashlib
import json
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logharbor.llm import (
    components,
    decontaminate,
    lengths,
    licenses,
    nearcopies,
    pii,
    piecebpe,
    quality,
    reshard,
    simhash,
    simple8b,
    tokenfile,
    winnowing,
)

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = "the onthe ratin " * 20_000
COLUMNS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, h bigint, key string,"
    " label int, size int, shard string, block int, ids string, hashes int, further int, n int"
)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), 1, 2, "k", 3, 4, "x", 5, "y", 6, 7, 8)


ODD = [
    row(1, None),
    row(2, ""),
    row(3, "   \n\t "),
    row(4, "word"),
    row(5, "a  b c d é 日本 <|endoftext|> end "),
    row(6, LONG, None, None),
    row(7, LONG, None, None),
    row(8, "mail a.b@c.org or +1 (555) 123-4567, 4111 1111 1111 1111 at 10.0.0.1"),
    row(8, "mail a.b@c.org or +1 (555) 123-4567, 4111 1111 1111 1111 at 10.0.0.1"),
    row(9, "x" * 50_000),
    row(None, "nobody knows this one"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def given(docs):
    return {r.doc_id: r.text for r in docs.collect()}


# --- 1 SentencePiece --------------------------------------------------------------------------


def test_pieces_equal_the_library():
    with open(PIECES, "rb") as file:
        model = file.read()
    own, library = piecebpe.PieceBpe(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(5)
    alphabet = " abcdeéñ▁\n\t1230日本🙂thingeronat.,--==##_{"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "a  b", "▁▁a▁", "aaaa" * 300, "<s></s><unk><0x41>", "日本語テキスト" * 40]
    for text in texts:
        ids, joined = own.encode(text)
        assert ids == library.encode(text), text
        assert joined == ",".join(map(str, ids))


def test_backtracking_without_word_cuts_is_the_same():
    with open(PIECES, "rb") as file:
        own = piecebpe.PieceBpe(file.read())
    for text in ("▁hello▁world", "▁unbelievable▁▁things", "▁thethethethe"):
        pieces = own.pieces(text)
        assert "".join(pieces) == text
        assert pieces == own.merge(text)


def test_round_trip(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = Counter(tuple(r) for r in piecebpe.round_trip(odd, PIECES).collect())
    want = Counter()
    for r in ODD:
        ids = library.encode(r[1] or "")
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids)))
        want[(r[0], len(ids), *digests)] += 1
    assert got == want
    assert piecebpe.round_trip(none, PIECES).count() == 0
    kept = piecebpe.encode_documents(odd, PIECES)
    assert set(odd.columns) <= set(kept.columns) and kept.count() == len(ODD)


# --- 2 quality --------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, sf):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.learn(docs, labels)
    positives = labels.agg(F.avg("quality")).first()[0]
    assert abs(model.prior - positives) < 0.05
    scored = quality.score(docs, model).join(labels, "doc_id").filter(quality.held_out())
    right = scored.agg(F.avg(((F.col("score") >= quality.THRESHOLD).cast("int") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.93
    assert quality.learn(docs, labels).scores(np.zeros((1, quality.FEATURES))) == model.scores(np.zeros((1, quality.FEATURES)))


def test_quality_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (6, 1), (9, 0), (None, 1), (8, None)], "doc_id bigint, quality int")
    model = quality.learn(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.learn(odd, labels.limit(0)) is None
    assert {r.score for r in quality.score(odd, None).collect()} == {1.0}
    assert quality.keep_good(none, labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_risk_never_falls_below_zero_and_prior_is_found():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(2, 1, (900, 3)), rng.normal(-2, 1, (300, 3))
    model = quality.fit(pos, np.concatenate([pos, neg]))
    assert abs(model.prior - 0.75) < 0.03
    assert model.scores(pos).mean() > 0.9 > 0.2 > model.scores(neg).mean()


# --- 3 SimHash --------------------------------------------------------------------------------


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(ids, fps, radius):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, f in zip(ids, fps, strict=True):
        for j, g in zip(ids, fps, strict=True):
            if (f ^ g).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_near_duplicates(docs, given):
    ids = sorted(given)
    fps = [plain_fingerprint(given[i]) for i in ids]
    want = plain_components(ids, fps, 4)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f, want[i]) for i, f in zip(ids, fps, strict=True)}


@pytest.mark.parametrize("total", [10, 50_000, 10**9])
def test_every_pair_within_radius_is_probed(total):
    rng = np.random.default_rng(2)
    widths = simhash.part_widths(total)
    blocks = simhash.block_widths(widths)
    counts = [rng.integers(0, 5, 1 << w) for part in blocks for w in part]
    shares = [simhash.near_shares(c, w, 4) for c, w in zip(counts, [w for p in blocks for w in p], strict=True)]
    values = rng.integers(0, 1 << 64, 200, dtype=np.uint64, endpoint=False)
    radii = simhash.allocate(values, blocks, shares, total, 4)
    assert ((radii + 1).sum(axis=1) == 5).all()
    for v, r in zip(values.tolist(), radii.tolist(), strict=True):
        for _ in range(20):
            near = v
            for bit in rng.choice(64, 4, replace=False).tolist():
                near ^= 1 << bit
            fields = [simhash._fields(np.array([x], np.uint64), widths) for x in (v, near)]
            assert any(
                (int(a[0]) ^ int(b[0])).bit_count() <= k for a, b, k in zip(*fields, r, strict=True)
            )


def test_heavy_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 3)
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = [base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)] + [rng.getrandbits(64) for _ in range(60)]
    fps = sorted(set(fps))
    classes = spark.createDataFrame([((f ^ (1 << 63)) - (1 << 63),) for f in fps], "fp bigint")
    arranged, links = simhash.near_links(classes)
    x_of = {r.x: r.fp % 2**64 for r in arranged.collect()}
    roots = {x_of[r.node]: x_of[r.root] for r in components.components(links).collect()}
    want = plain_components(fps, fps, 4)
    groups = defaultdict(set)
    for f in fps:
        groups[roots.get(f, f)].add(f)
    wanted = defaultdict(set)
    for f in fps:
        wanted[want[f]].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_near_duplicates_on_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r.component_id for r in rows}
    assert got[1] == got[2] == got[3] == 1 and got[7] == 6
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 8, 9]
    assert simhash.keep_one(none).count() == 0


def plain_sets(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    sets, parent = {i: plain_sets(t or "") for i, t in rows}, {i: i for i, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in sets:
        for j in sets:
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("batch", [300, 1 << 20])
def test_edited_copies_are_found_as_by_brute_force(spark, monkeypatch, batch):
    monkeypatch.setattr(nearcopies, "BATCH", batch)
    rng = random.Random(12)
    word = lambda: rng.choice("abcdefgh") + rng.choice("stuv") + rng.choice("xyz")
    rows = []
    for base in range(30):
        words = [word() for _ in range(rng.choice([3, 8, 40, 90, 200]))]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy[: -rng.randint(1, 4)] or copy
            rows.append((len(rows), " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    want = plain_groups(rows)
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(table).collect()} == want
    assert {r.doc_id for r in simhash.keep_one(table).collect()} == set(want.values())
    # The bits of the op3 query are too few for most of these copies.
    assert len({r.component_id for r in simhash.near_duplicates(table).collect()}) > len(set(want.values())) + 20


def test_near_copies_of_the_given_documents(docs, given):
    want = plain_groups(sorted(given.items()))
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs).collect()} == want


def test_texts_that_share_a_passage_do_not_meet(spark):
    rng = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(80))

    def meetings(n):
        rows = [(i, passage + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(15 + i % 9))) for i in range(n)]
        marked = nearcopies.cut(nearcopies._marked(spark.createDataFrame(rows, "doc_id bigint, text string")))
        assert marked.count() == n
        shared = nearcopies.cut(nearcopies._shared(marked)).withColumn("root", F.col("h"))
        return nearcopies._meetings(shared).count()

    assert meetings(300) == 0


def test_order_of_shingles_does_not_matter(spark, monkeypatch):
    """Batches of any size, and texts near the bound, give what comparing all pairs gives."""
    rng = random.Random(22)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = base[: rng.randint(30, 60)] if i % 2 else [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            if words:
                words[rng.randrange(len(words))] = f"x{rng.randrange(4)}"
        rows.append((i, " ".join(words)))
    want = plain_groups(rows)
    for batch in (1, 500, 1 << 20):
        monkeypatch.setattr(nearcopies, "BATCH", batch)
        table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        assert {r.doc_id: r.component_id for r in nearcopies.near_copies(table).collect()} == want


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components.components(links).collect()} == {0}
    assert components.components(links.limit(0)).count() == 0


# --- 4 resharding -----------------------------------------------------------------------------


def test_flow_moves_least():
    supply, capacity = {0: 50, 1: 30, 5: 20}, {0: 25, 1: 25, 2: 25, 3: 25}
    flow = reshard.min_cost_flow(supply, capacity)
    assert {s: sum(v for (a, _), v in flow.items() if a == s) for s in supply} == supply
    assert all(sum(v for (_, t), v in flow.items() if t == c) <= capacity[c] for c in capacity)
    assert sum(v for (s, t), v in flow.items() if s != t) == 25 + 5 + 20
    with pytest.raises(ValueError):
        reshard.min_cost_flow({0: 5}, {0: 4})


def test_flow_takes_back_what_stays_only_if_it_must():
    rng = random.Random(3)
    for _ in range(50):
        supply = {s: rng.randint(0, 40) for s in range(rng.randint(1, 5))}
        capacity = reshard.even_capacities(sum(supply.values()) + 3, rng.randint(1, 6))
        flow = reshard.min_cost_flow(dict(supply), capacity)
        stay = sum(v for (s, t), v in flow.items() if s == t)
        assert stay == sum(min(v, capacity.get(s, 0)) for s, v in supply.items())


def test_reshard(spark, docs, given):
    rows = reshard.reshard_documents(docs, F.pmod(F.xxhash64("source"), F.lit(5)), 7).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in given.items()
    }
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert set(slots) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < max(r.size for r in rows)


def test_reshard_leaves_full_shards_alone(spark):
    from logharbor.session import scratch

    rows = spark.createDataFrame([(i, "t" * 92) for i in range(40)], "doc_id bigint, text string")
    old, new = scratch(spark, "old"), scratch(spark, "new")
    reshard.write_layout(rows, old, F.when(F.col("doc_id") < 10, 0).when(F.col("doc_id") < 20, 1).otherwise(2))
    layout, flow = reshard.reshard(spark, old, new, 4)
    assert flow[0, 0] == flow[1, 1] == 1000 and flow[2, 3] == 1000
    assert sorted(p.shard for p in spark.read.parquet(new).select("shard").distinct().collect()) == [2, 3]
    assert sorted(r["count"] for r in layout.groupBy("shard").count().collect()) == [10] * 4


def test_reshard_odd_rows(odd, none):
    rows = reshard.reshard_documents(odd, F.lit(0), 3).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], len((r[1] or "").encode()) + 8) for r in ODD)
    assert reshard.reshard_documents(none, F.lit(0), 3).count() == 0


# --- 5 decontamination ------------------------------------------------------------------------


def plain_shingles(text):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", (text or "").lower())
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def plain_leaks(docs, items):
    out = {}
    for d, text in docs:
        own = plain_shingles(text)
        for i, item in items:
            other = Counter(plain_shingles(item))
            n = sum(other.values())
            if not n or not own or not other.keys() & set(own):
                continue
            best = max(
                sum((Counter(own[a : a + n]) & other).values()) / sum((Counter(own[a : a + n]) | other).values())
                for a in range(max(1, len(own) - n + 1))
            )
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_leaks(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefgh") + rng.choice("stuv") + rng.choice("xyz")
    items = [(i, " ".join(word() for _ in range(rng.randint(50, 110)))) for i in range(25)]
    items += [(90, "one two"), (91, ""), (92, None), (93, "ha " * 30), (5, items[5][1])]
    docs = []
    for d in range(120):
        words = [word() for _ in range(rng.randint(0, 120))]
        if d % 3:
            part = (items[d % 25][1]).split()
            for _ in range(d % 4):
                part[rng.randrange(len(part))] = word()
            words[len(words) // 2 : len(words) // 2] = part[d % 2 :]
        docs.append((d, " ".join(words)))
    docs += [(200, "One  two"), (201, None), (202, ""), (203, "ha " * 45), (5, docs[5][1]), (204, items[3][1].upper())]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("h", F.lit(1))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(table, bench).collect()}
    want = plain_leaks(docs, items)
    assert got == want and len(want) > 40 and (200, 90) in want and (203, 93) in want
    kept = {r.doc_id for r in decontaminate.drop_leaking(table, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_by_shuffled_join_and_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(decontaminate, "SENT_ROWS", 0)
    bench = spark.createDataFrame([(1, "mail a.b@c.org or +1 (555) 123-4567,"), (2, None)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, bench).collect()} == {(8, 1)}
    assert decontaminate.leaks(none, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.drop_leaking(odd, bench).columns == odd.columns


def test_native_simhash_and_similarity(spark):
    rng = random.Random(6)
    rows = [([rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(1, 60))] * rng.randint(1, 2),) for _ in range(20)]
    table = spark.createDataFrame(rows, "a array<bigint>")
    for r in table.select("a", decontaminate.simhash(F.col("a")).alias("f")).collect():
        hashes = [x % 2**64 for x in r.a]
        assert r.f % 2**64 == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    pair = spark.createDataFrame([([1, 1, 2, 3], [1, 2, 2, 9])], "a array<bigint>, b array<bigint>")
    sets = [decontaminate.as_set(F.col(c)) for c in "ab"]
    assert pair.select(decontaminate.similarity(*sets)).first()[0] == pytest.approx(2 / 6)


# --- 6 personal data --------------------------------------------------------------------------

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            luhn = sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
            if (
                (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")))
                or (kind == "card" and not (16 <= len(digits) <= 19 and luhn))
                or (kind == "phone" and not 8 <= len(digits) <= 15)
            ):
                continue
            out.append((kind, *m.span()))
    return out


def test_fixed_spans():
    rng = random.Random(2)
    alphabet = "ab@@..123456 -+()é%%_9 "
    seeds = ["", "4111 1111 1111 1111", "+1 (555) 123-4567", "1.2.3.4.5.6.7.8", "300.1.1.1", "a.b@c.d.e@f.g"]
    for _ in range(8000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) + rng.choice(seeds)
        found = pii.fixed_spans(text)
        assert [(k, a, b) for k in pii.KINDS for a, b in found[k]] == plain_spans(text)


def test_contexts_find_unseen_identifiers(spark):
    known = [(i, f"reach desk at a{i}@x{i}.org today or later") for i in range(40)]
    unseen = [(100, "reach desk at someone@intranet today or later"), (101, "order 55512345 is not one of them")]
    table = spark.createDataFrame(known + unseen, "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in pii.detect(table).select("doc_id", pii.spelled("spans").alias("spans")).collect()}
    assert found[100] == "email:14:30" and found[101] == "" and found[0] == "email:14:23"
    masked = {r.doc_id: r.text for r in pii.mask(table).collect()}
    assert masked[100] == "reach desk at <EMAIL> today or later" and masked[101] == unseen[1][1]


def test_several_unseen_identifiers_of_a_context_are_found(spark):
    rows = [(i, f"please call +1 555 010 1{i:03} today or later") for i in range(8)]
    unseen = [(100 + i, f"please call 0049-30-77{i:03} today or later") for i in range(6)]
    # A context of two kinds, and one of far more unknown numbers than seeds, say nothing.
    rows += [(200 + i, f"sent from {x} at noon") for i in range(8) for x in (f"b{i}@y{i}.org", f"10.1.2.{i}")]
    rows += [(300 + i, f"number is +1 555 020 2{i:03} so far") for i in range(6)]
    other = [(400, "sent from someone@intranet at noon")] + [(500 + i, f"number is 990{i:03} so far") for i in range(60)]
    table = spark.createDataFrame(rows + unseen + other, "doc_id bigint, text string")
    found = {r.doc_id: r.spans for r in pii.detect(table).select("doc_id", pii.spelled("spans").alias("spans")).collect()}
    assert {found[i] for i, _ in unseen} == {"phone:12:25"}
    assert {found[i] for i, _ in other} == {""}
    masked = {r.doc_id: r.text for r in pii.mask(table).collect()}
    assert {masked[i] for i, _ in unseen} == {"please call <PHONE> today or later"}


def test_detect_and_mask_odd_rows(odd, none):
    rows = pii.detect(odd).select("doc_id", "counts", pii.spelled("base").alias("base")).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: (r.counts, r.base) for r in rows}
    want = plain_spans(ODD[7][1])
    assert got[8] == ([1, 1, 1, 1], ",".join(f"{k}:{a}:{b}" for k, a, b in want))
    assert got[1] == ([0, 0, 0, 0], "")
    masked = pii.mask(odd)
    assert masked.columns == odd.columns and masked.count() == len(ODD)
    text = masked.filter("doc_id = 8").first()
    assert text.text == "mail <EMAIL> or <PHONE>, <CARD> at <IP>" and text.n_chars == len(text.text)
    assert masked.filter("doc_id = 1").first().text is None
    assert pii.detect(none).count() == pii.mask(none).count() == 0


# --- 7 winnowing ------------------------------------------------------------------------------


def test_winnowing_rule(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokens = table.select("doc_id", winnowing.words(F.col("text")).alias("w"))
    grams = tokens.select(
        "doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.slice("w", i, 5)))
    ).select("doc_id", (F.col("pos") + 1).alias("at"), F.shiftrightunsigned(F.xxhash64("col"), 31).alias("hash"))
    hashes = defaultdict(dict)
    for r in grams.collect():
        hashes[r.doc_id][r.at] = r.hash
    want = set()
    for d, own in hashes.items():
        for a in range(1, max(1, len(own) - 7) + 1):
            window = [(own[i], -i) for i in range(a, min(a + 8, len(own) + 1))]
            h, at = min(window)
            want.add((d, h, -at))
    assert {tuple(r) for r in winnowing.fingerprints(table).collect()} == want


def test_edited_documents(docs, given):
    ids = sorted(given)
    rows = {r.doc_id: r for r in winnowing.edited_documents(docs).collect()}
    assert sorted(rows) == ids
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        quarter = len(given[i]) // 4
        assert rows[i].edited == given[i][: len(given[i]) - quarter] + given[after][:quarter]
        assert rows[i].n_chars == len(given[i])
        own = [{c >> 30 for c in codes or []} for codes in (rows[i].codes, rows[i].edited_codes, rows[after].codes)]
        like = [len(own[0] & o) / len(own[0] | o) if own[0] | o else 1.0 for o in own[1:]]
        assert [rows[i].near_edited, rows[i].near_next] == pytest.approx(like)


def test_edited_odd_rows(odd, none):
    rows = winnowing.edited_documents(odd).collect()
    assert len(rows) == len(ODD)
    first = next(r for r in rows if r.doc_id is None)
    assert first.edited.startswith("nobody knows") and first.n_chars == 21
    last = next(r for r in rows if r.doc_id == 9)
    assert last.edited.endswith("nobody knows this one") and last.near_next == 0
    assert next(r for r in rows if r.doc_id == 1).near_edited == 1.0
    assert winnowing.edited_documents(none).count() == 0


# --- 8 lengths --------------------------------------------------------------------------------


def test_lengths(spark, odd, none):
    library = Tokenizer.from_file(BYTES)
    counts = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in ODD]
    sums = lengths.suffix_sums(lengths.histogram(lengths.token_lengths(odd, BYTES))).cache()
    for r in sums.collect():
        n = r.n_tokens
        assert r.docs == counts.count(n)
        assert r.docs_from == sum(c >= n for c in counts) and r.docs_to == sum(c <= n for c in counts)
        assert r.tokens_from == sum(c for c in counts if c >= n) and r.truncated == sum(min(c, n) for c in counts)
    limits = [0, 1, 7, 100, 5000, 10**9]
    for r in lengths.at_limits(sums, limits).collect():
        assert r.truncated == sum(min(c, r.limit) for c in counts) and r.docs_cut == sum(c > r.limit for c in counts)
    ordered = sorted(counts)
    for r in lengths.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == ordered[int(np.ceil(r.share * len(counts))) - 1]
    empty = lengths.suffix_sums(lengths.histogram(lengths.token_lengths(none, BYTES)))
    assert empty.count() == 0 and lengths.at_limits(empty, [5]).first().truncated == 0


# --- 9 licenses -------------------------------------------------------------------------------


def test_licenses(spark, odd, none):
    mit = licenses.TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "FREE of any charge").replace("publish, ", "")
    texts = [
        (1, "é first.\nReleased under the MIT License. And\nLicensed  under the Apache License, Version 2.0."),
        (2, "Intro words. " + edited + " more"),
        (3, "The work is under a general public house, all rights are gone."),
        (4, " ".join(mit.split()[:20])),
        (5, "All rights reserved. " * 3),
    ]
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = defaultdict(list)
    for r in licenses.scan(table).orderBy("doc_id", "start").collect():
        assert dict(texts)[r.doc_id][r.start : r.end] == r.passage
        rows[r.doc_id].append((r.license, round(r.coverage, 2)))
    assert rows[1] == [("MIT line", 1.0), ("Apache-2.0 line", 1.0)]
    assert [x for x, _ in rows[2]] == ["MIT"] and 0.9 < rows[2][0][1] < 1
    assert 3 not in rows and 4 not in rows
    assert rows[5] == [("All rights reserved", 1.0)] * 3
    assert licenses.scan(odd).count() == licenses.scan(none).count() == 0


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0", "GPL", "BSD"])
@pytest.mark.parametrize("columns, margin", [(60, " " * 18), (40, " " * 14), (72, " " * 40), (60, "    // "), (50, " * "), (60, "\t# ")])
def test_indented_and_commented_licenses(name, columns, margin):
    whole = {"break_long_words": False, "break_on_hyphens": False}
    notice = textwrap.fill(licenses.TEMPLATES[name], columns, initial_indent=margin, subsequent_indent=margin, **whole)
    text = ("Some words é.\n" + notice + "\nMore words.").encode()
    found = {k: (c, text[a:b]) for k, c, a, b in licenses.Index(licenses.TEMPLATES).matches(text)}
    coverage, passage = found[name]
    words = [w for w, _, _ in licenses.words(licenses.TEMPLATES[name].lower().encode())]
    assert coverage == 1 and [w for w, _, _ in licenses.words(licenses.folded(passage)[0])] == words


def test_winnowed_grams_meet_every_shared_passage():
    rng = random.Random(1)
    text = bytes(rng.choice(b"abc ") for _ in range(400))
    kept = set(licenses.winnow(licenses.grams(text)).tolist())
    for at in range(400 - 12):
        assert any(p in kept for p in range(at, at + licenses.WINDOW))


# --- 10 token files ---------------------------------------------------------------------------


def test_simple8b():
    rng = random.Random(3)
    runs = [
        [],
        [0] * 1000,
        [2**64 - 1, 2**60 - 1, 2**60 - 2, 5, 0, 2**63, 2**64 - 1, 2**64 - 1, 1] * 7,
        [rng.randrange(2 ** rng.randint(0, 64)) for _ in range(5000)],
        [rng.randrange(2 ** rng.randint(0, 16)) for _ in range(5000)],
    ]
    for values in runs:
        words = simple8b.pack(np.array(values, np.uint64))
        assert simple8b.unpack(words, len(values)).tolist() == values
    assert len(simple8b.pack(np.zeros(240, np.uint64))) == 1
    assert len(simple8b.pack(np.full(60, 1, np.uint64))) == 1


def test_words_are_encoded_as_whole_texts():
    with open(BYTES, "rb") as file:
        encoder = tokenfile.WordEncoder(file.read())
    library, rng = Tokenizer.from_file(BYTES), random.Random(1)
    alphabet = " ab'st\n\t é1,.<>|\0　\x1c\x85z"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "x" * 9000, "don't. stop, now.", "naïve, é. 1,000."]
    for _ in range(2):
        got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)]
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_files(spark, odd, none, docs, given, monkeypatch):
    from logharbor.session import scratch

    library = Tokenizer.from_file(BYTES)
    path = scratch(spark, "tokens")
    tokenfile.write_tokens(docs, path, BYTES)
    read = {r.doc_id: r.ids for r in tokenfile.read_tokens(spark, path).collect()}
    assert read == {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in given.items()}
    start = 0
    rows = {r.doc_id: r for r in tokenfile.describe(spark, path).collect()}
    for i in sorted(given):
        ids = np.array(read[i], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    again = tokenfile.token_index(odd, BYTES).orderBy("start").collect()
    assert [r.doc_id for r in again] == sorted((r[0] for r in ODD), key=lambda d: d or 0)
    assert tokenfile.token_index(none, BYTES).count() == 0


def test_segments_are_cut_between_documents():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (0, 3, 70_000, 1)]
    doc_ids, counts, stream = tokenfile.from_segment(tokenfile.to_segment([None, 5, -7, 9], ids))
    assert doc_ids == [None, 5, -7, 9] and counts.tolist() == [0, 3, 70_000, 1]
    assert stream.tobytes() == b"".join(ids)
    with pytest.raises(ValueError):
        tokenfile.from_segment(json.dumps({}).encode().ljust(64))


def test_near_copies_begin_with_simhash_components(docs, given, monkeypatch):
    asked = []
    monkeypatch.setattr(simhash, "near_copies", lambda docs, near: asked.append(near) or nearcopies.near_copies(docs, near))
    want = plain_groups(sorted(given.items()))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(want.values())
    assert {"doc_id", "component_id"} <= set(asked[0].columns)
    # Components that are no copies link nothing.
    wrong = docs.select("doc_id", F.lit(min(given)).cast("bigint").alias("component_id"))
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, wrong).collect()} == want
