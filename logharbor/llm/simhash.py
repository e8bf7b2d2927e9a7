"""SimHash near-duplicates: fingerprints of word shingles, linked by a generalised pigeonhole search.

Two fingerprints within RADIUS bits must agree to within r_i bits in some part i of the bits whenever the r_i + 1 add
up to RADIUS + 1 (a part with r_i = -1 is not looked at). So

1. bits that go together are put into one part, which leaves the parts as independent as can be and their values
   spread out (counts of all pairs of bits over all distinct fingerprints);
2. for each fingerprint dynamic programming shares RADIUS + 1 among the parts, by what each radius would cost there:
   the keys to probe and the candidates they are estimated to meet (histograms of blocks of bits over all distinct
   fingerprints);
3. every fingerprint is in the index under its parts' values and probes the values within its radii; candidates are
   verified on all bits.

Documents of one fingerprint are one class throughout. A key that holds very many fingerprints is not joined row by
row: its two sides are dealt out in blocks, and each pair of blocks returns a spanning forest of its links.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import cut, extended, small_slices, texts
from logharbor.llm.components import components
from logharbor.llm.nearcopies import near_copies

WORDS, SEED, CHUNK = 4, 42, 1 << 16
RADIUS, BITS = 4, 64
#: Numbers of parts to choose from, widest block of bits that gets a histogram, bits of a part's value in a key.
PARTS, BLOCK, SHIFT = (2, 3, 4, 5), 11, 40
#: A key with more fingerprints than this is compared in blocks of as many.
HEAVY = 2048


def fingerprint(text: bytes) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text.

    Words are runs between ASCII white space, with A-Z lowered; shingles are WORDS words joined by spaces, repeats
    included, or all words where there are fewer; a text without words has fingerprint zero. A bit is one where more
    than half of the shingles' XXH64 have it set.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - WORDS + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[len(words) - n :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        pairs = zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)
        some = b"".join([digest(joined[a:b], SEED) for a, b in pairs])
        ones += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp as a signed long. A null text reads as empty."""

    def run(batches):
        for batch in small_slices(batches):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t) for t in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id bigint, fp bigint")


def _bits(fps: np.ndarray) -> np.ndarray:
    """One row of bits for each value, highest first."""
    return np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _values(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _pair_counts(classes: DataFrame) -> np.ndarray:
    """How many fingerprints have both of two bits, for all pairs; a task sends one row for each pair at most."""

    def run(batches):
        both = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = _bits(_values(batch.column(0))).astype(np.float32)
            both += np.rint(bits.T @ bits).astype(np.int64)
        keys = np.arange(BITS * BITS, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(both.ravel())], names=["k", "n"])

    counted = classes.select("fp").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    both = np.zeros(BITS * BITS, np.int64)
    for row in counted.collect():  # BITS * BITS rows
        both[row["k"]] = row["n"]
    return both.reshape(BITS, BITS)


def group_bits(both: np.ndarray, total: int, widths: list[int]) -> list[int]:
    """Bit numbers in the order of the parts: each part starts with the bit most tied to the others that are left,
    and takes in turn the bit most tied to those it has."""
    p = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    left, order = list(range(BITS)), []
    for width in widths:
        part = [max(left, key=lambda b: tie[b, left].sum())]
        left.remove(part[0])
        while len(part) < width:
            nearest = max(left, key=lambda b: tie[b, part].sum())
            part.append(nearest)
            left.remove(nearest)
        order += part
    return order


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1)) if radius >= 0 else 0


def part_widths(total: int, radius: int = RADIUS) -> list[int]:
    """Widths of the parts, as many as cost least for evenly spread fingerprints."""

    def cost(m: int) -> float:
        width, shares = BITS / m, [(radius + 1) // m + (i < (radius + 1) % m) for i in range(m)]
        return sum(_ball(int(width), s - 1) * (1 + total / 2**width) for s in shares)

    m = min((m for m in PARTS if m <= radius + 1), key=cost)
    return [BITS // m + (i < BITS % m) for i in range(m)]


def block_widths(widths: list[int]) -> list[list[int]]:
    """Each part cut into blocks of at most BLOCK bits."""
    out = []
    for width in widths:
        k = -(-width // BLOCK)
        out.append([width // k + (i < width % k) for i in range(k)])
    return out


def _fields(values: np.ndarray, widths: list[int]) -> list[np.ndarray]:
    """The values' bits as fields of these widths, from the highest bit on."""
    out, shift = [], BITS
    for width in widths:
        shift -= width
        out.append((values >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def _histograms(arranged: DataFrame, blocks: list[int]) -> list[np.ndarray]:
    """How often each value of each block occurs, over all classes; at most 2 ** BLOCK rows for a block."""

    def run(batches):
        counts = [np.zeros(1 << w, np.int64) for w in blocks]
        for batch in batches:
            for k, field in enumerate(_fields(_values(batch.column(0)), blocks)):
                counts[k] += np.bincount(field.astype(np.int64), minlength=len(counts[k]))
        for k, c in enumerate(counts):
            some = np.flatnonzero(c)
            columns = [np.full(len(some), k, np.int64), some.astype(np.int64), c[some]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["k", "v", "n"])

    counted = arranged.select("x").mapInArrow(run, "k bigint, v bigint, n bigint")
    out = [np.zeros(1 << w, np.int64) for w in blocks]
    for row in counted.groupBy("k", "v").agg(F.sum("n").alias("n")).collect():  # bounded by the sizes of the blocks
        out[row["k"]][row["v"]] = row["n"]
    return out


def near_shares(counts: np.ndarray, width: int, radius: int) -> np.ndarray:
    """For each value of a block the share of fingerprints at distance 0, 1, ... radius from it."""
    share, values = counts / max(counts.sum(), 1), np.arange(1 << width)
    out = np.zeros((radius + 1, 1 << width))
    for r in range(min(radius, width) + 1):
        for flips in combinations(range(width), r):
            out[r] += share[values ^ sum(1 << f for f in flips)]
    return out.T


def allocate(values: np.ndarray, blocks: list[list[int]], shares: list[np.ndarray], total: int, radius: int) -> np.ndarray:
    """Radii of the parts for each value (-1: not looked at), by dynamic programming on the estimated cost."""
    n, m = len(values), len(blocks)
    fields = _fields(values, [w for part in blocks for w in part])
    at, best = 0, np.full((n, radius + 2), np.inf)
    best[:, 0] = 0
    choice = np.zeros((m, n, radius + 2), np.int8)
    for i, part in enumerate(blocks):
        # Distances over a part's blocks add up; their shares are taken as independent.
        exact = np.zeros((n, radius + 1))
        exact[:, 0] = 1
        for _ in part:
            own, mixed = shares[at][fields[at].astype(np.int64)], np.zeros((n, radius + 1))
            for a in range(radius + 1):
                mixed[:, a:] += exact[:, a : a + 1] * own[:, : radius + 1 - a]
            exact, at = mixed, at + 1
        cost = np.zeros((n, radius + 2))
        cost[:, 1:] = np.cumsum(exact, axis=1) * total + [_ball(sum(part), r) for r in range(radius + 1)]
        after = np.full((n, radius + 2), np.inf)
        for have in range(radius + 2):
            for add in range(radius + 2 - have):
                new = best[:, have] + cost[:, add]
                better = new < after[:, have + add]
                after[better, have + add] = new[better]
                choice[i, better, have + add] = add
        best = after
    left, out, rows = np.full(n, radius + 1), np.zeros((n, m), np.int8), np.arange(n)
    for i in range(m - 1, -1, -1):
        out[:, i] = choice[i, rows, left]
        left = left - out[:, i]
    return out - 1


def _masks(width: int, radius: int) -> np.ndarray:
    flips = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return np.array(flips, np.uint64)


def forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (left, right) that connect all that pairs within radius connect."""
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
    out, open_left, open_right = [], near.any(axis=1), np.ones(len(right), bool)
    while open_left.any():
        front = [int(np.flatnonzero(open_left)[0])]
        open_left[front[0]] = False
        while front:
            next_front = []
            for i in front:
                for j in np.flatnonzero(near[i] & open_right).tolist():
                    open_right[j] = False
                    out.append((i, j))
                    for k in np.flatnonzero(near[:, j] & open_left).tolist():
                        open_left[k] = False
                        out.append((k, j))
                        next_front.append(k)
            front = next_front
    return [(int(left[i]), int(right[j])) for i, j in out]


def _heavy_links(index: DataFrame, probes: DataFrame, heavy: DataFrame, radius: int) -> DataFrame:
    """Links among the members of heavy keys, compared block by block."""
    rows = F.col("_n") / HEAVY
    seen = probes.join(heavy, "key", "left_semi").groupBy("key").agg(F.ceil(F.count("*") / HEAVY).cast("int").alias("q_blocks"))
    sizes = heavy.select("key", F.ceil(rows).cast("int").alias("x_blocks")).join(seen, "key")

    def dealt(df: DataFrame, side: str, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("v"), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        df = df.join(sizes, "key").select("key", "v", block.alias(own), each.alias(other), F.lit(side).alias("side"))
        return df.select("key", "v", "x_blocks", "q_blocks", "side")

    both = dealt(index.withColumnRenamed("x", "v"), "x", "x_blocks", "q_blocks").unionByName(
        dealt(probes.withColumnRenamed("q", "v"), "q", "q_blocks", "x_blocks")
    )

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        v, is_x = rows["v"].to_numpy().view(np.uint64), (rows["side"] == "x").to_numpy()
        pairs = np.array(forest(v[is_x], v[~is_x], radius), np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})

    return both.groupBy("key", "x_blocks", "q_blocks").applyInPandas(link, "u bigint, v bigint")


def near_links(classes: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """classes (fp, ...) with ``x``, the fingerprint with its bits rearranged, and links (u, v) between such x that
    connect all fingerprints within radius."""
    total = classes.count()
    widths = part_widths(total, radius)
    blocks = block_widths(widths)
    order = group_bits(_pair_counts(classes), total, widths)

    def arrange(batches):
        for batch in batches:
            bits = np.packbits(_bits(_values(batch.column("fp")))[:, order], axis=1)
            x = np.ascontiguousarray(bits).view(">u8").astype(np.uint64).ravel()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(x.view(np.int64))], names=[*batch.schema.names, "x"]
            )

    arranged = cut(classes.mapInArrow(arrange, extended(classes.schema, "x bigint")))
    flat = [w for part in blocks for w in part]
    shares = [near_shares(c, w, radius) for c, w in zip(_histograms(arranged, flat), flat, strict=True)]

    def probe(batches):
        for batch in small_slices(batches):
            values = _values(batch.column(0))
            radii = allocate(values, blocks, shares, total, radius)
            for i, (field, width) in enumerate(zip(_fields(values, widths), widths, strict=True)):
                for r in range(radius + 1):
                    rows = np.flatnonzero(radii[:, i] == r)
                    if not len(rows):
                        continue
                    masks = _masks(width, r)
                    keys = (field[rows][:, None] ^ masks[None, :]).ravel() | np.uint64(i << SHIFT)
                    q = np.repeat(values[rows], len(masks))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(q.view(np.int64))], names=["key", "q"]
                    )

    probes = arranged.select("x").mapInArrow(probe, "key bigint, q bigint")
    keys, shift = [], BITS
    for i, width in enumerate(widths):
        shift -= width
        field = F.shiftrightunsigned("x", shift).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(field.bitwiseOR(F.lit(i << SHIFT)))
    index = arranged.select(F.explode(F.array(*keys)).alias("key"), "x")
    heavy = cut(index.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > HEAVY))
    within = F.bit_count(F.col("q").bitwiseXOR(F.col("x"))) <= radius
    if heavy.isEmpty():
        pairs = probes.join(index, "key")
        more = None
    else:
        pairs = probes.join(index.join(heavy, "key", "left_anti"), "key")
        more = _heavy_links(index, probes, heavy, radius)
    # Each of a pair probes for the other, so links from the larger one are enough.
    links = pairs.filter((F.col("x") < F.col("q")) & within).select(F.col("q").alias("u"), F.col("x").alias("v"))
    return arranged, links if more is None else links.unionByName(more)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    component_id is the smallest doc_id among all documents that links of at most radius differing bits reach, the
    document itself included. Equal fingerprints are linked, those of texts without words too. A row without a doc_id
    takes part; it gets the smallest doc_id of its component, or null if none there has one.
    """
    marked = cut(fingerprints(docs))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    arranged, links = near_links(classes, radius)
    roots = cut(components(links))
    linked = arranged.join(roots, arranged.x == roots.node)
    labels = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.select("fp", "root").join(labels, "root").select("fp", "component_id")
    # Written out, so that the last join has plain exchanges below it and a fingerprint of very many copies is split.
    found = cut(
        classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    )
    return marked.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each component the document with the smallest doc_id stays. Components of near_duplicates are
    compared exactly, and ``nearcopies`` adds the pairs that are farther apart than RADIUS bits.

    Of several rows with that doc_id the one with the smallest text stays. Rows without a doc_id cannot be told apart
    and stay as they are. All columns are kept.
    """
    groups = near_copies(docs, near_duplicates(docs))
    stay = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi")
    # Repeated rows are rare: only the ids that occur more than once are put through a choice.
    again = cut(groups.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"))
    lone = docs.filter(F.col("doc_id").isNull())
    single = kept.join(again, "doc_id", "left_anti")
    chosen = (
        kept.join(again, "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("_row"))
        .select("_row.*")
    )
    return single.unionByName(chosen).unionByName(lone).select(*docs.columns)
