"""Benchmark items inside documents, in DataFrame functions only.

An item of n words is looked for in windows of n words. Shingles are GRAM words; a window's or item's weight for a
shingle is how often it has it, and the similarity is weighted Jaccard: the sum of the lesser weights over the sum of
the greater ones. Windows of SIMILARITY and more are reported.

1. Every shingle of every text is looked up among the benchmark's. A window can only reach SIMILARITY with an item of
   its size if that share of its shingles occurs in items of that size, so windows below it are left out: an exact
   bound, nothing that could match is lost by it.
2. The windows that are left get a SimHash of their weighted shingles. 64 bits are cut into BLOCKS blocks; two
   fingerprints within RADIUS bits agree to within BLOCK_RADIUS in some block, so an index of all item fingerprints
   under every value that near in each block meets all items within RADIUS.
3. Whatever is met within RADIUS is compared exactly.

Copies of one text are looked up once: everything is keyed by the text's hash and joined back to documents at the end.

Results: texts and items are lowered and split at ASCII white space; one of fewer than GRAM words is a single shingle
of all its words, and such an item only matches a text that is exactly it; null and empty texts and items match
nothing; repeated rows of either table are reported once per doc_id and item_id.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import cut, texts
from logharbor.llm.winnowing import words

GRAM, SIMILARITY = 5, 0.8
BLOCKS, BLOCK_RADIUS = 8, 2
BLOCK_BITS = 64 // BLOCKS
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Rows of (long, int) up to which the benchmark's shingles are sent to every task; beyond it they are joined.
SENT_ROWS = 1 << 20


def shingles(text: Column) -> Column:
    """Hashes of the text's shingles in order; null without words."""
    one = F.transform(
        F.array(words(text)),
        lambda w: F.when(
            w.isNotNull(),
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(w) - (GRAM - 1), F.lit(1))),
                lambda i: F.xxhash64(F.slice(w, i, GRAM)),
            ),
        ),
    )
    return F.element_at(one, 1)


def _count_bits(k: int):
    return lambda total, h: total + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(0x0000000100000001))


def simhash(hashes: Column) -> Column:
    """Bits set in more than half of the hashes, each as often as it occurs.

    Bits k and k + 32 are counted in the two halves of one long.
    """
    out = F.lit(0).cast("bigint")
    n = F.size(hashes).cast("bigint")
    for k in range(32):
        both = F.aggregate(hashes, F.lit(0).cast("bigint"), _count_bits(k))
        low = F.when(both.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > n, F.lit(1 << k)).otherwise(F.lit(0))
        high = F.when(F.shiftrightunsigned(both, 32) * 2 > n, F.shiftleft(F.lit(1).cast("bigint"), k + 32)).otherwise(
            F.lit(0).cast("bigint")
        )
        out = out.bitwiseOR(low.cast("bigint")).bitwiseOR(high)
    return out


def as_set(hashes: Column) -> Column:
    """The multiset as a set: the second, third and further of equal hashes become hashes of their own."""
    one = F.transform(
        F.array(F.array_sort(hashes)),
        lambda s: F.transform(s, lambda h, i: F.xxhash64(h, i + 1 - F.array_position(s, h))),
    )
    return F.element_at(one, 1)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two multisets given as sets."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, hashes) of the items that have words; n counts shingles."""
    rows = benchmark.select(F.col("item_id"), shingles(F.coalesce(F.col("text"), F.lit(""))).alias("hashes"))
    return rows.filter(F.col("hashes").isNotNull()).distinct().withColumn("n", F.size("hashes"))


def _hits(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """(h, size, n, at): the positions of each text's shingles that items of n shingles have; size: all its shingles."""
    own = keyed.select("h", shingles(F.col("text")).alias("hashes")).filter(F.col("hashes").isNotNull())
    each = own.select("h", F.size("hashes").alias("size"), F.posexplode("hashes").alias("at", "hash"))
    if known.count() <= SENT_ROWS:
        known = F.broadcast(known)
    return each.join(known, "hash").select("h", "size", "n", (F.col("at") + 1).alias("at")).distinct()


def _windows(hits: DataFrame) -> DataFrame:
    """(h, n, start): windows of n shingles with enough hits of that class.

    Each window is found from its first hit: it begins there or as many places before as may be no hits, but after the
    hit before. At the ends of a text windows are moved inside it.
    """
    spots = hits.groupBy("h", "size", "n").agg(F.array_sort(F.collect_list("at")).alias("at"))
    # As many hits of n must lie inside; the comparison of similarities allows for rounding, so this does too.
    spots = spots.withColumn("need", F.ceil(F.col("n") * SIMILARITY - 1e-9).cast("int"))
    spots = spots.filter(F.size("at") >= F.col("need"))

    def begins(at: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(F.col("at"), k - 1)).otherwise(F.lit(-(1 << 30)))
        low = F.greatest(before + 1, at - (F.col("n") - F.col("need")))
        last = F.get(F.col("at"), k + F.col("need") - 1)
        starts = F.sequence(low, at)
        fits = F.filter(starts, lambda s: last <= s + F.col("n") - 1)
        return F.when(last.isNotNull(), F.transform(fits, _inside)).otherwise(F.array().cast("array<int>"))

    def _inside(start: Column) -> Column:
        return F.greatest(F.lit(1), F.least(start, F.col("size") - F.col("n") + 1))

    starts = F.array_distinct(F.flatten(F.transform("at", begins)))
    return spots.select("h", "n", F.explode(starts).alias("start"))


def _near_block(fp: Column, block: int) -> Column:
    return F.shiftrightunsigned(fp, block * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _index(items: DataFrame) -> DataFrame:
    """(n, key, item_id, item_fp, item_set): each item under every value within BLOCK_RADIUS in each block."""
    flips = [
        sum(1 << b for b in c) for r in range(BLOCK_RADIUS + 1) for c in combinations(range(BLOCK_BITS), r)
    ]
    marked = items.withColumn("item_fp", simhash(F.col("hashes"))).withColumn("item_set", as_set(F.col("hashes")))
    keys = F.array(
        *[_near_block(F.col("item_fp"), b).bitwiseXOR(F.lit(m)) + (b << BLOCK_BITS) for b in range(BLOCKS) for m in flips]
    )
    return marked.select("item_id", "item_fp", "item_set", "n", F.explode(keys).alias("key"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start) for every document and item with a window of SIMILARITY and more.

    start is the 1-based word at which the best window begins, the first of equals.
    """
    keyed = texts(docs).withColumn("h", F.xxhash64("text"))
    items = cut(_items(benchmark))
    known = cut(items.select("n", F.explode("hashes").alias("hash")).distinct())
    windows = cut(_windows(cut(_hits(keyed, known))))
    # The texts that have windows, each once, however many copies it has.
    chosen = keyed.join(windows.select("h").distinct(), "h", "left_semi").select("h", shingles(F.col("text")).alias("hashes"))
    chosen = cut(chosen.dropDuplicates(["h"]))
    own = chosen.join(windows, "h").select("h", "n", "start", F.slice("hashes", F.col("start"), F.col("n")).alias("part"))
    marked = cut(
        own.select("h", "n", "start", simhash(F.col("part")).alias("fp"), as_set(F.col("part")).alias("part_set"))
    )
    keys = F.array(*[_near_block(F.col("fp"), b) + (b << BLOCK_BITS) for b in range(BLOCKS)])
    probes = marked.select("h", "n", "start", "fp", F.explode(keys).alias("key"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    index = cut(_index(items))
    met = probes.join(index.drop("item_set"), ["n", "key"]).filter(near).select("h", "n", "start", "item_id").distinct()
    sets = index.select("item_id", "n", "item_set").distinct()
    compared = met.join(marked, ["h", "n", "start"]).join(sets, ["item_id", "n"])
    compared = compared.withColumn("similarity", similarity(F.col("part_set"), F.col("item_set")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("_at")))
    found = cut(
        compared.filter(F.col("similarity") >= SIMILARITY).groupBy("h", "item_id").agg(best.alias("_best")).select(
            "h", "item_id", F.col("_best.similarity").alias("similarity"), (-F.col("_best._at")).alias("start")
        )
    )
    rows = keyed.select("doc_id", "h").join(found, "h").drop("h")
    return rows.groupBy("doc_id", "item_id").agg(
        F.max("similarity").alias("similarity"), F.min_by("start", -F.col("similarity")).alias("start")
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item, with all their columns.

    Rows without a doc_id stay if their ids cannot be named; all others are kept or dropped by doc_id.
    """
    named = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(named, "doc_id", "left_anti").select(*docs.columns)
