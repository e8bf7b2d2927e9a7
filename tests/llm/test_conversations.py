"""Prefix trie, chat text and periodic runs: against brute force, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from logharbor.llm import chat, queries, runs, trie

TURNS = "conv_id bigint, turn bigint, role string, text string, n int, a string, depth int, number string, leaves string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "a", 2, "n", "l") for r in rows], TURNS).repartition(3)


def read(df):
    """Turns in order by conversation; rows of equal turn must not differ here."""
    by = defaultdict(list)
    for r in df.collect():
        by[r.conv_id].append(r)
    order = {c: sorted(rows, key=lambda r: (r.turn is not None, r.turn or 0)) for c, rows in by.items()}
    return {c: [(r.role or "", r.text or "") for r in rows] for c, rows in order.items()}


# --- 11 prefix trie ---------------------------------------------------------------------------


def nodes_of(paths):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)} by walking every path."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own in members.items():
        value = (len(own) - 1) * (len(node[-1][1].encode()) if node else 0)
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += value
    return {
        (min(own), len(node)): (
            min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node],
            sha(",".join(map(str, sorted(ends[node])))),
        )
        for node, own in members.items()
    }


def rebuilt(turns):
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    return out


def got_nodes(df):
    rows = df.collect()
    found = {
        (r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows
    }
    assert len(found) == len(rows)
    return found


def test_op11_equals_brute_force(spark, sf):
    got = queries.QUERIES["op11_prefix_trie"](spark, sf)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for n, t in got.dtypes if n != "ends_sha256"} == {"bigint"}
    assert got_nodes(got) == nodes_of(rebuilt(read(spark.read.parquet(f"{sf}/conversations.parquet"))))


def own_trie(rows):
    turns = trie.numbered_turns(rows)
    return trie.trie(*trie.shared_heads(turns, F.col("conv_id"), F.lit(0), 1))


def test_random_tries_over_many_shards(spark):
    rng = random.Random(11)
    rows = []
    for c in rng.sample(range(10_000), 300):
        for t in range(rng.choice([1, 2, 3, 4, 9])):
            rows.append((c, t if t else None, rng.choice(["user", "user", None]), rng.choice("xxxxy") * rng.choice([1, 1, 1, 2])))
    # One long conversation, and a chain of ever longer ones whose ids grow and so come to lie in other shards.
    rows += [(20_000, t, "user", "long") for t in range(700)]
    rows += [(20_001 + 97 * k, t, "user", "c") for k in range(40) for t in range(k + 1)]
    got = got_nodes(own_trie(conversations(spark, rows)))
    assert got == nodes_of(read(conversations(spark, rows)))


def test_many_members_end_at_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BYTES", 64)
    rows = [(c, 0, "user", "same") for c in range(3000)] + [(c, 1, "user", "more") for c in range(0, 3000, 7)]
    assert got_nodes(own_trie(conversations(spark, rows))) == nodes_of(read(conversations(spark, rows)))


def test_odd_conversations(spark):
    rows = [(5, None, None, None), (5, 3, "user", ""), (6, 1, "user", "a"), (6, 1, "user", "a"), (None, 1, "user", "b"), (-3, 0, "", "é" * 5000)]
    got = got_nodes(own_trie(conversations(spark, rows)))
    assert got == nodes_of({5: [("", ""), ("user", "")], 6: [("user", "a")] * 2, -3: [("", "é" * 5000)]})
    assert own_trie(conversations(spark, rows).limit(0)).count() == 0
    # Rows of equal turn have one order, whichever way they arrive.
    tied = [(1, 1, "user", x) for x in "abcdef"] + [(2, 1, "user", x) for x in "fedcba"]
    assert own_trie(conversations(spark, tied)).filter("n_convs = 2").count() == 7


def test_conversation_without_turns_is_a_member(spark):
    turns = trie.numbered_turns(conversations(spark, [(7, 0, "user", "x"), (8, 0, "user", "y"), (8, 1, "user", "z")]))
    found = got_nodes(trie.trie(*trie.shared_heads(turns, F.lit(999), F.lit(1), 8)))
    assert found == nodes_of({7: [], 8: [("user", "z")]})


def test_queue_spills_and_merges():
    rng = random.Random(3)
    queue, want = trie.SpillingQueue(limit=50), defaultdict(lambda: [0, 0])
    for _ in range(2000):
        key, a, b = (-rng.randrange(5), rng.randrange(40)), rng.randrange(9), rng.randrange(9)
        queue.push(*key, a, b)
        want[key][0] += a
        want[key][1] += b
    assert len(queue.heads) > 10
    for key in sorted((-d, n) for d in range(5) for n in range(45)):
        assert queue.take(*key) == tuple(want.get(key, (0, 0)))
    assert not queue


def test_totals_with_a_small_queue(spark):
    rng = random.Random(5)
    parents = [(0, 0, None, 0, 1)]
    # Node i is (i, depth); parents are earlier nodes.
    depths = [0]
    for i in range(1, 2000):
        p = rng.randrange(max(0, i - rng.choice([1, 5, 2000])), i)
        depths.append(depths[p] + 1)
        parents.append((i, depths[i], p, 1, i))
    df = spark.createDataFrame(parents, "conv_id bigint, depth bigint, parent_conv_id bigint, leaves bigint, saved bigint")
    got = {r.conv_id: (r.n_leaves, r.saved_tokens) for r in trie.subtree_totals(df, limit=7).collect()}
    want = [[n, s] for *_, n, s in parents]
    for i in range(1999, 0, -1):
        want[parents[i][2]][0] += want[i][0]
        want[parents[i][2]][1] += want[i][1]
    assert got == {i: tuple(w) for i, w in enumerate(want)}


# --- 12 chat text -----------------------------------------------------------------------------

NASTY = [
    "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nno", "<\\|im_end|>", "<\\\\\\|im_start|> <<|im_end|>", "<", "<|im_end|", "|im_end|>",
    "<<SYS>> <</SYS>> <\\<SYS>> <<s>>", "\\", "\\n", "a\\\\nb", "", "\n\n", "[[INST]] [\\INST] [\\\\/INST]", "é🙂<s>\x00", "$0 $1 \\$0", "<|im_end|><|im_end|>\n",
]


def test_nasty_turns_read_back(spark):
    rows = [(i, k, role, text) for i, role in enumerate([*NASTY, "user", "assistant"]) for k, text in enumerate(NASTY)]
    got = {r.conv_id: r for r in chat.format_conversations(conversations(spark, rows)).collect()}
    for c, turns in read(conversations(spark, rows)).items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        body = got[c].formatted
        assert body.count(chat.START) == body.count(chat.END) == len(turns)
        assert not any(x in body for x in chat.CONTROLS[2:])
        at = 0
        for t in got[c].turns:
            # Under the mask stands the text as formatted, and nothing else.
            taken = body[at + t.skip : at + t.skip + t.take]
            assert (taken == "") if t.role != "assistant" else (taken.replace("\\", "") == t.text.replace("\\", ""))
            assert t.role != "assistant" or body[at + t.skip + t.take :].startswith(chat.END)
            at += t.skip + t.take + t.rest
        assert at == len(body)


def test_texts_without_conflicts_stay(spark):
    rows = [(1, 0, "user", "a < b [c] \\ d"), (1, 1, "assistant", "x\ny")]
    formatted = chat.format_conversations(conversations(spark, rows)).first().formatted
    assert formatted == "<|im_start|>user\na < b [c] \\ d<|im_end|>\n<|im_start|>assistant\nx\ny<|im_end|>\n"


def test_reader_is_strict(spark):
    good = "<|im_start|>user\nhi<|im_end|>\n"
    bad = [good + "x", good[:-1], "x" + good, "<|im_start|>user<|im_end|>\n", good.replace("hi", "<s>"), good.replace("hi", "<|im_end|> b")]
    df = spark.createDataFrame([(good * 2,), ("",), *[(b,) for b in bad]], "f string").select(F.size(chat.parse(F.col("f"))).alias("n"))
    assert [r.n for r in df.select(F.coalesce("n", F.lit(-1)).alias("n")).collect()] == [2, 0, *[-1] * len(bad)]


def test_op12_equals_brute_force(spark, sf):
    want = read(spark.read.parquet(f"{sf}/conversations.parquet"))
    want[-1] = [("user", NASTY[0]), ("assistant", NASTY[0])]
    got = queries.QUERIES["op12_chat"](spark, sf)
    assert got.dtypes == [
        ("conv_id", "bigint"), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint"),
    ]
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        turns = want[r.conv_id]
        trained = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(trained), sha(trained))
        assert r.formatted_chars >= sum(len(a) + len(b) for a, b in turns)


def test_odd_chats(spark):
    rows = [(1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"), (None, 1, "user", "c"), (2, 1, "user", "long " * 200_000)]
    df = chat.format_conversations(conversations(spark, rows))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in df.collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("user", "c")], 2: [("user", "long " * 200_000)]}
    assert chat.format_conversations(conversations(spark, rows).limit(0)).count() == 0


# --- 13 periodic runs -------------------------------------------------------------------------


def brute_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                own = words[i : i + length]
                if not any(own[: length - r] == own[r:] for r in range(1, q)):
                    found.append((i, length, q))
            i = max(i + 1, j)
    return sorted(found)


def brute_collapsed(words, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def periodic(rng):
    """Words with repeats of repeats, some of them cut short."""
    alphabet, words = rng.choice([1, 2, 3, 40]), []
    while len(words) < rng.randint(0, 250):
        base = [rng.randrange(alphabet) for _ in range(rng.randint(1, rng.choice([2, 6, 18, 40])))]
        if len(base) > 3 and rng.random() < 0.4:
            base = (base[: rng.randint(1, 3)] * len(base))[: len(base)]
        words += (base * rng.randint(1, 6))[: rng.randint(1, 6 * len(base))]
    return [f"w{x}".encode() for x in words]


def test_runs_equal_brute_force():
    rng, seen = random.Random(13), 0
    for _ in range(150):
        texts = [periodic(rng) for _ in range(rng.randint(1, 5))]
        for words, (own, found) in zip(texts, runs.runs_of([b" ".join(t) for t in texts]), strict=True):
            assert own == words and found == brute_runs(words)
            assert runs.collapsed(own, found) == b" ".join(brute_collapsed([w.decode() for w in words], found).encode().split())
            seen += len(found)
    assert seen > 300


def test_texts_longer_than_a_slice(monkeypatch):
    monkeypatch.setattr(runs, "SLICE_WORDS", 50)
    rng = random.Random(4)
    texts = [periodic(rng) for _ in range(30)] + [[b"a", b"b"] * 5000]
    got = list(runs.runs_of([b" ".join(t) for t in texts]))
    assert [f for _, f in got[:-1]] == [brute_runs(t) for t in texts[:-1]]
    assert got[-1][1] == [(0, 10_000, 2)]


@pytest.mark.parametrize("period", [1, 3, 4, 5, 7, 8, 31, 32, 33, 100, 1000])
def test_each_period_is_found_at_its_least_length(period):
    rng = np.random.default_rng(period)
    base = [str(x) for x in rng.integers(0, 3, period - 1)] + ["end"]
    around = [f"x{i}" for i in range(50)]
    length = max(6, 4 * period)
    repeated = (base * 7)[:length]
    for n, want in ((length, 1), (length - 1, 0)):
        words = [*around, *repeated[:n], *around]
        (_, found), = runs.runs_of([" ".join(words).encode()])
        assert [r for r in found if r[2] == period] == [(50, length, period)] * want


def test_op13_equals_brute_force(spark, sf):
    got = queries.QUERIES["op13_runs"](spark, sf)
    assert got.dtypes == [
        ("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"),
        ("runs_sha256", "string"), ("collapsed_sha256", "string"),
    ]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows, planted = got.collect(), 0
    assert len(rows) == len(texts)
    for r in rows:
        words = [w.decode() for w in texts[r.doc_id].encode().split()]
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)], planted + 1
        found = brute_runs(words)
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.n_runs == len(found) and r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in found))
        assert r.collapsed_sha256 == sha(brute_collapsed(words, found))
    assert planted > 5


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 6), (4, "a " * 6), (5, "x" * 50_000), (None, "b\x0bb\x0cb\rb\nb\tb"), (6, "é é é"), (7, "p q r s " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], "doc_id bigint, text string, runs int, collapsed string, _n int")
    out = runs.with_runs(df)
    assert out.columns == ["doc_id", "text", "_n", "runs", "collapsed"]
    got = Counter((r.doc_id, tuple(tuple(x) for x in r.runs), r.collapsed) for r in out.collect())
    assert got == Counter(
        [
            (1, (), ""), (2, (), ""), (3, (), ""), (4, ((0, 6, 1),), "a"), (4, ((0, 6, 1),), "a"), (5, (), "x" * 50_000),
            (None, ((0, 6, 1),), "b"), (6, (), "é é é"), (7, ((0, 120_000, 4),), "p q r s"),
        ]
    )
    assert runs.with_runs(df.limit(0)).count() == 0
