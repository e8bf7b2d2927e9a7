"""Periodic runs of words: stretches that repeat a period at least POWER times, found by string synchronising sets.

The words of a text are runs between ASCII white space, numbered from 0. A run is a stretch with smallest period q of at
least max(LEAST, POWER * q) words that no neighbouring word extends. All runs are found, exactly:

1. Periods below SMALL are detected by themselves: stretches of words equal to the ones q before.
2. For w = SMALL, 2 SMALL, 4 SMALL, ...: periods from w to 2w - 1. Every 2w words are a context. Positions whose context lies in a run
   of a period of at most w / 2 are left out (their small periods are known from before). Of the others, those are selected whose
   context's hash is the smallest of some w neighbouring positions: equal surroundings select equally.
3. In a run of period q, w <= q < 2w, contexts at distance q are equal and those nearer are not, any w positions hold one that
   isn't left out, and 4q words hold both a selected position and the one q further on. So two neighbours of equal context among
   the selected, w to 2w - 1 apart, propose their distance as a period, and no run goes unproposed.
4. Proposals of a period that overlap are one stretch, extended by comparing words; it is a run if it is long enough and
   its period is not a multiple of a smaller one.

Contexts left out have no period of w / 2 or less, so equal ones are further apart than that and a scale selects some 2 / w of all
positions. Texts are handled together, SLICE_WORDS words at a time, a longer text alone; they can't run into each other.

Results: null, empty and blank texts have no words and no runs; repeated rows are handled as any; columns are kept, but for older
ones of the names runs and collapsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharbor.llm.common import extended, small_slices

#: How often a period is repeated at least, and words of a run at least; POWER may not be below 4.
POWER, LEAST = 4, 6
#: Periods below are compared directly; a power of two.
SMALL = 4
SLICE_WORDS = 1 << 18
SPACES = " \t\n\x0b\f\r"
NONE = np.uint64((1 << 64) - 1)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every ``width`` neighbours, a power of two."""
    step = 1
    while step < width:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of true begin and end (exclusive)."""
    edges = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _primitive(words: np.ndarray, start: int, period: int) -> bool:
    """Whether the first period of a run has no smaller one that divides it."""
    left, factor = period, 2
    while left > 1:
        if factor * factor > left:
            factor = left
        if left % factor == 0:
            smaller = words[start : start + period].reshape(factor, period // factor)
            if (smaller == smaller[0]).all():
                return False
            while left % factor == 0:
                left //= factor
        factor += 1
    return True


def _reach(words: np.ndarray, at: int, period: int, step: int) -> int:
    """The first position from ``at`` on, going by ``step``, where a word differs from the one ``period`` further on."""
    size, end = 64, len(words) - period
    while 0 <= at < end:
        if step > 0:
            stop = min(end, at + size)
            differ = np.flatnonzero(words[at:stop] != words[at + period : stop + period])
            if len(differ):
                return at + int(differ[0])
        else:
            stop = max(-1, at - size)
            differ = np.flatnonzero(words[stop + 1 : at + 1] != words[stop + 1 + period : at + 1 + period])
            if len(differ):
                return stop + 1 + int(differ[-1])
        at, size = stop, size * 2
    return at


def _proposals(words: np.ndarray, context: np.ndarray, omitted: np.ndarray, w: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, period): stretches where words equal the ones a period further on, from pairs of equal context."""
    hashes = np.where(omitted, NONE, np.minimum(context, NONE - np.uint64(1)))
    least = _sliding(hashes, w, np.minimum)
    # A position is selected if one of the w windows that hold it has its hash as minimum.
    around = np.concatenate((np.zeros(w - 1, np.uint64), np.where(least == NONE, np.uint64(0), least), np.zeros(w - 1, np.uint64)))
    chosen = np.flatnonzero((_sliding(around, w, np.maximum) == hashes) & ~omitted)
    order = np.argsort(hashes[chosen], kind="stable")
    at = chosen[order]
    gap = at[1:] - at[:-1]
    pair = (hashes[at[1:]] == hashes[at[:-1]]) & (gap >= w) & (gap < 2 * w)
    first, period = at[:-1][pair], gap[pair]
    order = np.lexsort((first, period))
    held = None
    for i, q in zip(first[order].tolist(), period[order].tolist(), strict=True):
        if held and held[2] == q and i <= held[1]:
            held = (held[0], i + 2 * w, q)
        else:
            if held:
                yield held
            held = (i, i + 2 * w, q)
    if held:
        yield held


def find_runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, no run longer than ``longest``; in no order."""
    n, found = len(words), set()
    # Where a run of a period of at most some bound begins and ends, per period.
    regions: list[tuple[int, int, int]] = []

    def keep(start: int, end: int, period: int) -> None:
        """words[start:end] equal the ones a period further on."""
        length = end - start + period
        if length >= max(LEAST, POWER * period) and (start, length, period) not in found and _primitive(words, start, period):
            found.add((start, length, period))
            regions.append((start, length, period))

    for q in range(1, min(SMALL, n)):
        for start, end in zip(*(x.tolist() for x in _stretches(words[:-q] == words[q:])), strict=True):
            keep(start, end, q)
    w, hashes, wide = SMALL, _mixed(words.astype(np.uint64), np.uint64(1)), 1
    while POWER * w <= longest:
        while wide < 2 * w:
            hashes = _mixed(hashes[:-wide], hashes[wide:])
            wide *= 2
        omitted = np.zeros(len(hashes) + 1, np.int32)
        for start, length, period in regions:
            if period <= w // 2 and length >= 2 * w:
                omitted[start] += 1
                omitted[start + length - 2 * w + 1] -= 1
        omitted = np.cumsum(omitted)[:-1] > 0
        for first, last, q in _proposals(words, hashes, omitted, w):
            if (words[first:last] != words[first + q : last + q]).any():
                continue  # two contexts of one hash
            keep(_reach(words, first - 1, q, -1) + 1, _reach(words, last, q, 1), q)
        w *= 2
    return list(found)


def _numbered(texts: list[bytes]) -> Iterator[tuple[int, list[list[bytes]], np.ndarray, list[int]]]:
    """Slices of texts: the first one's number, their words, all words as numbers, and where each text begins. Texts are
    set apart by numbers that occur once."""
    at = 0
    while at < len(texts):
        begin, words, total = at, [], 0
        while at < len(texts) and (not words or total < SLICE_WORDS):
            words.append((texts[at] or b"").split())
            total += len(words[-1])
            at += 1
        numbers: dict[bytes, int] = {}
        flat = np.empty(total + len(words), np.int64)
        starts, end = [], 0
        for i, own in enumerate(words):
            starts.append(end)
            flat[end : end + len(own)] = [numbers.setdefault(x, len(numbers)) for x in own]
            end += len(own)
            flat[end] = -1 - i
            end += 1
        yield begin, words, flat, starts


def runs_of(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """The words of each text and its runs (start, length, period), by start and period."""
    for _, words, flat, starts in _numbered(texts):
        own: list[list[tuple[int, int, int]]] = [[] for _ in words]
        for start, length, period in find_runs(flat, max(map(len, words))):
            k = int(np.searchsorted(starts, start, "right")) - 1
            own[k].append((start - starts[k], length, period))
        for w, r in zip(words, own, strict=True):
            yield w, sorted(r)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()])


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``runs`` (array of start, length, period, by start and period) and ``collapsed``, the text without repeats."""
    docs = docs.drop("runs", "collapsed")
    names = [*docs.columns, "runs", "collapsed"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in small_slices(batches):
            column = batch.column(text)
            found, kept = [], []
            for words, runs in runs_of(column.cast(pa.binary()).to_pylist()):
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept.append(collapsed(words, runs).decode())
            columns = [*batch.columns, pa.array(found, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = extended(docs.schema, "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return docs.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period; of equal ones the one that starts first, then the shorter period. Null without runs."""

    def better(best: Column, r: Column) -> Column:
        # Runs come by start and period, so of equal ones the first stays.
        more = best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
        return F.when(more, r).otherwise(best)

    kind = "struct<start:bigint,length:bigint,period:bigint>"
    return F.aggregate(runs, F.lit(None).cast(kind), better)


def spelled(runs: Column) -> Column:
    """Every run as start,length,period and a line break."""
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.array_join(line, "")


def with_planted_period(docs: DataFrame, when: Column, start: Column, period: Column) -> DataFrame:
    """docs whose text has, where ``when`` holds, each word i >= start replaced by word start + (i - start) % period. start and
    period are expressions of ``_n``, the number of words, and are looked at where the text has words."""
    trimmed = F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES))
    words = F.when(trimmed != "", F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))
    rows = docs.withColumn("_when", F.coalesce(when, F.lit(False)) & (trimmed != ""))
    rows = rows.withColumn("_words", F.when(F.col("_when"), words)).withColumn("_n", F.size("_words"))
    rows = rows.withColumn("_a", start).withColumn("_p", period)
    i = F.sequence(F.lit(1).cast("bigint"), F.col("_n").cast("bigint"))
    planted = F.transform(
        i, lambda i: F.element_at("_words", F.when(i <= F.col("_a"), i).otherwise(F.col("_a") + F.pmod(i - 1 - F.col("_a"), F.col("_p")) + 1).cast("int"))
    )
    text = F.when(F.col("_when"), F.array_join(planted, " ")).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*docs.columns)
