"""SentencePiece BPE, encoded exactly by backtracking instead of by a merge queue.

A sequence of pieces is the encoding of a text exactly if every two neighbours are compatible, that is, if merging the
two pieces' own text gives these two pieces again: a merge across a boundary would have to be the best merge inside the
two pieces around it at that moment. So a text is encoded from left to right:

* an Aho-Corasick automaton over the reachable pieces gives the longest piece that starts at each position;
* a piece is accepted if it is compatible with the one before; otherwise the next shorter piece is tried;
* when none is left the last accepted piece is taken back, and its end is marked in a bit field of positions that no
  encoding passes through, so every position fails once at most.

Text that no piece covers falls back to bytes. Where no piece of the vocabulary holds a word mark after another
character, texts are cut before word marks and the encodings of words are remembered in a bounded cache.

Results: null and empty texts give no ids and an empty decoded text; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain
from operator import itemgetter

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from logharbor.llm.common import WordCache, extended, kept, read_bytes, small_slices, texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Words remembered per worker, and half as many pairs whose compatibility is remembered; beyond it they are computed again.
CACHE_WORDS, CACHE_CHARS = 600_000, 48
#: Words remembered by ``encode_documents``: its workers stay beside a heap that other stages have filled, and beside those stages when these run again.
STAGE_WORDS = 150_000
#: Runs of Latin letters and runs of anything else, each with the marks before it.
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
RUNS = re.compile(f"{MARK}*(?:[{LETTER}]+|[^{LETTER}{MARK}]+)|{MARK}+")
IDS, JOINED = itemgetter(0), itemgetter(1)


class PieceBpe:
    """Encoder and decoder of one BPE model with byte fallback."""

    def __init__(self, model: bytes, remembered: int = CACHE_WORDS):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a BPE model of normal pieces is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.plain = proto.normalizer_spec.name == "identity" and not proto.normalizer_spec.remove_extra_whitespaces
        self.prefix = MARK if proto.normalizer_spec.add_dummy_prefix else ""
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {piece: -proto.pieces[i].score for piece, i in normal.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        # A piece that merging its own text does not give can never be in an encoding.
        self.ids = {piece: i for piece, i in normal.items() if self.merge(piece) == [piece]}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        if self.ids:
            self.automaton.make_automaton()
        self.shorter = {piece: self._prefix_of(piece) for piece in self.ids}
        self.by_word = not any(MARK in piece.lstrip(MARK) for piece in normal)
        self.pairs: dict[tuple[str, str], bool] = {}
        # No piece joins characters of two kinds, so no merge crosses from one run to the next.
        self.by_run = self.by_word and all(len(RUNS.findall(piece)) == 1 for piece in normal)
        self.words, self.runs, self.most_pairs = WordCache(remembered), WordCache(remembered // 2), remembered // 2

    def _prefix_of(self, piece: str) -> str | None:
        return next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), None)

    def merge(self, text: str) -> list[str]:
        """The plain merge loop, for short texts: best score first, leftmost among equals."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                found = score(parts[i] + parts[i + 1])
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.merge(left + right) == [left, right]
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def pieces(self, text: str) -> list[str]:
        """The pieces of normalised text; a character outside the vocabulary is a piece of its own."""
        longest: list[str | None] = [None] * len(text)
        # Matches come by ascending end, so the last one for a start is the longest.
        if self.ids:
            for end, piece in self.automaton.iter(text):
                longest[end - len(piece) + 1] = piece
        failed, out, at, n, known = bytearray((len(text) >> 3) + 1), [], 0, len(text), self.pairs.get
        candidate = longest[0] or text[0] if n else ""
        while at < n:
            end = at + len(candidate)
            if not failed[end >> 3] >> (end & 7) & 1 and (
                not out or known((out[-1], candidate)) or self.compatible(out[-1], candidate)
            ):
                out.append(candidate)
                at = end
                if at < n:
                    candidate = longest[at] or text[at]
                continue
            while True:
                shorter = self.shorter.get(candidate)
                if shorter is not None:
                    candidate = shorter
                    break
                failed[at >> 3] |= 1 << (at & 7)
                candidate = out.pop()
                at -= len(candidate)
        return out

    def _ids_of(self, text: str) -> tuple[int, ...]:
        ids: list[int] = []
        for piece in self.pieces(text):
            i = self.ids.get(piece)
            if i is not None:
                ids.append(i)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in piece.encode())
            else:
                ids.append(self.unknown)
        return tuple(ids)

    def word(self, word: str) -> tuple[tuple[int, ...], str]:
        """Ids of one word, which starts with its mark if it has one."""
        found = self.words.get(word)
        if found is None:
            runs = RUNS.findall(word) if self.by_run else [word]
            if len(runs) == 1:
                ids = self._ids_of(word)
            else:
                ids = tuple(chain.from_iterable(map(self._run, runs)))
            found = ids, ",".join(map(str, ids))
            if len(word) <= CACHE_CHARS:
                self.words.put(word, found)
        return found

    def _run(self, run: str) -> tuple[int, ...]:
        ids = self.runs.get(run)
        if ids is None:
            ids = self._ids_of(run)
            if len(run) <= CACHE_CHARS:
                self.runs.put(run, ids)
        return ids

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        return self.prefix + text.replace(" ", MARK) if self.plain else self.library.normalize(text)

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids of a text, and the same joined by commas."""
        if not text:
            return [], ""
        if self.by_word and self.plain and self.prefix and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            words = text.replace(" ", f" {MARK}").split(" ")
            words[0] = MARK + words[0]
        elif self.by_word:
            words = re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", self.normalised(text))
        else:
            words = [self.normalised(text)]
        found = list(map(self.words.new.get, words))
        if None in found:
            word = self.word
            found = [f or word(w) for f, w in zip(found, words, strict=True)]
        return list(chain.from_iterable(map(IDS, found))), ",".join(map(JOINED, found))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


def _codec(model, remembered: int = CACHE_WORDS) -> PieceBpe:
    return kept(("piecebpe", remembered, hashlib.sha256(model.value).digest()), lambda: PieceBpe(model.value, remembered))


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """docs with ``ids`` (array of int) and ``decoded`` (the text those ids stand for).

    All columns of docs are kept, except that columns of these two names are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_bytes(model_path))
    rest = docs.drop("ids", "decoded")

    def run(batches):
        codec = _codec(model, STAGE_WORDS)
        for batch in small_slices(batches):
            coded = [codec.encode(t or "")[0] for t in batch.column("text").to_pylist()]
            columns = [*batch.columns, pa.array(coded, pa.list_(pa.int32())), pa.array(codec.decode(coded), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "ids", "decoded"])

    return rest.mapInArrow(run, extended(rest.schema, "ids array<int>, decoded string"))


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode every text, decode the ids, and return counts and digests of both.

    Columns: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_bytes(model_path))

    def run(batches):
        codec, sha = _codec(model), hashlib.sha256
        for batch in small_slices(batches):
            coded = [codec.encode(t) for t in batch.column("text").to_pylist()]
            decoded = codec.decode([ids for ids, _ in coded])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(ids) for ids, _ in coded], pa.int64()),
                    pa.array([sha(joined.encode()).hexdigest() for _, joined in coded]),
                    pa.array([sha(t.encode()).hexdigest() for t in decoded]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
