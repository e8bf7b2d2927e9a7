"""Token ids in binary segments of Simple-8b words, in document order.

A segment holds whole documents, about SEGMENT_IDS ids of them (more only if one document has more), as one byte string:

=========  ==========================================================================================
header     "S8BT", then as little-endian int64 the numbers of documents, ids, blocks and words
documents  doc_id (int64), whether it is null (uint8) and n_tokens (int64) of each, as three arrays
blocks     first word of each block of BLOCK_IDS ids (int64), so a reader can begin at any block
words      the Simple-8b words (uint64) of one block after the other
=========  ==========================================================================================

Segments are rows (part, segment, n_ids, data) of a Parquet table: Spark's writer commits them as a whole, a lost
executor's rows are written again, and any store that Spark reaches will do.

Results: null and empty texts give only the end id; rows of one doc_id keep the order of their texts; a null doc_id
comes first; an empty table gives a table without segments.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logharbor.llm.common import WordCache, kept, read_bytes, scratch, small_slices, texts
from logharbor.llm.simple8b import pack, unpack

MAGIC, SEGMENT_IDS, BLOCK_IDS = b"S8BT", 1 << 20, 1 << 16
CACHE_WORDS, CACHE_CHARS = 1_400_000, 48
#: How a byte-level vocabulary spells a space.
SPACE = "\u0120"
#: Marks that the pattern takes apart from a letter before them.
ENDS = ",."
SEGMENTS = "part int, segment int, n_ids bigint, data binary"


class WordEncoder:
    """Ids of texts by a tokenizers file, with the ids of words remembered.

    A byte-level pattern never joins a space to the character before it, so a text may be cut before every single
    space, and each piece has the same ids wherever it stands. Other tokenizers, texts with runs of white space at a
    cut, and texts that hold an added token are encoded whole.
    """

    def __init__(self, source: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(source)
        spec = json.loads(source)
        before = spec.get("pre_tokenizer") or {}
        self.by_word = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not spec.get("normalizer")
            and spec["model"].get("dropout") is None
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        # Whether an id's bytes begin with a space; no other byte of a word is one.
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith(SPACE)
        self.ends = dict(zip(ENDS, self._whole(list(ENDS)), strict=True)) if self.by_word else {}
        # Words that begin a text, and words after a space.
        self.first, self.words = WordCache(CACHE_WORDS // 8), WordCache(CACHE_WORDS)

    def _whole(self, texts: list[str]) -> list[bytes]:
        coded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in coded]

    def _learn(self, missing: dict[str, bytes | None]) -> None:
        """Ids of words after a space: the library encodes them in one text, and each begins with its space."""
        joined = " " + " ".join(missing)
        ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = [*(np.flatnonzero(self.opens[ids]) * 4).tolist(), len(ids) * 4]
        raw, put = ids.tobytes(), self.words.put
        if len(ends) != len(missing) + 1:
            raise ValueError("words could not be told apart")
        for word, a, b in zip(missing, ends, ends[1:], strict=False):
            missing[word] = coded = raw[a:b]
            if len(word) <= CACHE_CHARS:
                put(word, coded)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        if not self.by_word:
            return self._whole(texts)
        out, whole, cut, missing, firsts = [b""] * len(texts), [], [], {}, {}
        new, old = self.words.new.get, self.words.old.get
        for i, text in enumerate(texts):
            if not text:
                continue
            words = text.split(" ")
            found = list(map(new, words))
            holes = [k for k, f in enumerate(found) if f is None and k]
            # White space before a space may be joined with it, so such texts are not cut; no cache holds such words.
            if text[0].isspace() or words[0][-1:].isspace() or any(not words[k] or words[k][-1].isspace() for k in holes):
                whole.append(i)
                continue
            if any(a in text for a in self.added):
                whole.append(i)
                continue
            found[0] = self.first.get(words[0])
            if found[0] is None:
                firsts[words[0]] = None
                holes.append(0)
            for k in holes:
                if not k:
                    continue
                word = words[k]
                known = old(word)
                if known is None and word[-1] in ENDS and word[-2:-1].isalpha():
                    # The word without its mark is met more often than with it.
                    end, core = self.ends[word[-1]], word[:-1]
                    known = new(core) or old(core)
                    if known is None:
                        missing[core] = None
                        continue
                    known += end
                if known is None:
                    missing[word] = None
                else:
                    found[k] = known
                    self.words.put(word, known)
            cut.append((i, words, found, holes))
        if firsts:
            for word, ids in zip(firsts, self._whole(list(firsts)), strict=True):
                firsts[word] = ids
                if len(word) <= CACHE_CHARS:
                    self.first.put(word, ids)
        if missing:
            self._learn(missing)
        for i, words, found, holes in cut:
            for k in holes:
                if found[k] is None:
                    word = words[k]
                    found[k] = firsts[word] if not k else missing.get(word) or missing[word[:-1]] + self.ends[word[-1]]
            out[i] = b"".join(found)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True) if whole else ():
            out[i] = ids
        return out


def to_segment(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One segment of whole documents; ids as little-endian uint32."""
    stream = np.frombuffer(b"".join(ids), "<u4")
    blocks = [pack(stream[at : at + BLOCK_IDS]) for at in range(0, len(stream), BLOCK_IDS)]
    firsts = np.cumsum([0, *map(len, blocks)])[:-1]
    counts = (len(doc_ids), len(stream), len(blocks), sum(map(len, blocks)))
    return b"".join(
        [
            MAGIC,
            np.array(counts, "<i8").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            np.array([len(b) // 4 for b in ids], "<i8").tobytes(),
            firsts.astype("<i8").tobytes(),
            *(b.astype("<u8").tobytes() for b in blocks),
        ]
    )


def from_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, tokens per document, and all ids of a segment."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, n, blocks, words = np.frombuffer(data, "<i8", 4, 4).tolist()
    at = 36
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, "u1", docs, at + 8 * docs)
    counts = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    firsts = [*np.frombuffer(data, "<i8", blocks, at).tolist(), words]
    body = np.frombuffer(data, "<u8", words, at + 8 * blocks)
    parts = [unpack(body[firsts[k] : firsts[k + 1]], min(BLOCK_IDS, n - k * BLOCK_IDS)) for k in range(blocks)]
    ids = np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")
    return [None if m else d for d, m in zip(doc_ids.tolist(), null.tolist(), strict=True)], counts, ids


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 0) -> None:
    """Encode every text and write the ids at path as segments, in ascending doc_id order."""
    source = docs.sparkSession.sparkContext.broadcast(read_bytes(tokenizer_path))
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        key = ("tokenfile", hashlib.sha256(source.value).digest())
        encoder = kept(key, lambda: WordEncoder(source.value))
        part, segment, doc_ids, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array([held], pa.int64()),
                    pa.array([to_segment(doc_ids, ids)], pa.binary()),
                ],
                names=["part", "segment", "n_ids", "data"],
            )

        for batch in small_slices(batches):
            for d, coded in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                doc_ids.append(d)
                ids.append(coded + end)
                held += len(ids[-1]) // 4
                if held >= SEGMENT_IDS:
                    yield row()
                    segment, doc_ids, ids, held = segment + 1, [], [], 0
        if doc_ids:
            yield row()

    # Only ids and texts are dealt by ranges of doc_id; encoding comes after, so sampling the ranges does not pay for it.
    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SEGMENTS).write.mode("overwrite").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document written at path."""

    def run(batches):
        for batch in batches:
            for data in batch.column("data"):
                doc_ids, counts, ids = from_segment(data.as_py())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), lists], names=["doc_id", "ids"])

    return read_segments(spark, path).select("data").mapInArrow(run, "doc_id bigint, ids array<int>")


def describe(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from its decoded ids: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for part, segment, data in zip(*(batch.column(c) for c in ("part", "segment", "data")), strict=True):
                doc_ids, counts, ids = from_segment(data.as_py())
                ends = np.cumsum(counts)
                starts = ends - counts
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * n, pa.int32()),
                        pa.array([segment.as_py()] * n, pa.int32()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["part", "segment", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    segments = read_segments(spark, path)
    rows = segments.mapInArrow(
        run, "part int, segment int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # Offsets in two levels: parts are as many as partitions, and the segments of one part are ranked on their own.
    sizes = segments.select("part", "segment", "n_ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part_start")
    )
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(parts, "part").select(
        "part", "segment", (F.col("_part_start") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("_start")
    )
    return rows.join(offsets, ["part", "segment"]).select(
        "doc_id", (F.col("_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_index(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0) -> DataFrame:
    """Write the tokens of docs to a fresh table in the shared folder and describe them from what was written."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end_id)
    return describe(docs.sparkSession, path)
