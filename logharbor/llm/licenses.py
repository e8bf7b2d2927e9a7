"""License notices in documents: fingerprints pick candidates, alignment says how much of a notice is there.

1. Templates and texts are lowered (ASCII), and each run of white space, with comment marks that stand alone in it, is
   made one blank, so that indented and commented notices read as others do; spans are of the text as given. The hashes of a template's
   GRAM-byte grams are winnowed: of every WINDOW neighbours the smallest is kept, the rightmost of equals. An inverted
   index leads from a kept hash to (template, offset). Any WINDOW + GRAM - 1 bytes that a text shares with a template
   hold a kept gram, so looking up every gram of a text finds every such passage.
2. Hits of one template on nearby diagonals (text position less template offset) make a candidate if they are
   MIN_HITS of its kept grams; a passage with MIN_COVERAGE of the words keeps more, unless every fourth word differs.
3. Candidates are aligned word by word in a band around their diagonal: the longest common subsequence within BAND
   words of it. The share of the template's words that are matched is the coverage; matches of MIN_COVERAGE and more
   are reported with their span.

A text costs one pass, a candidate costs its template's length times the band. Results: null and empty texts have no
matches; equal texts have equal ones; of overlapping matches of one template the better one stays, then the earlier.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logharbor.llm.common import small_slices, texts

GRAM, WINDOW, BAND, MIN_COVERAGE, SLACK, MIN_HITS = 8, 6, 6, 0.8, 24, 0.2

# Standard notices, as their licenses ask to be worded.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless"
        " required by applicable law or agreed to in writing, software distributed under the License is distributed on"
        ' an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "MIT line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without'
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met"
    ),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC line": "Licensed under CC BY-NC 4.0.",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "All rights reserved": "All rights reserved.",
}

_LOWER = bytes(
    32 if c in b"\t\n\v\f\r" else c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256)
)
_MIX, _TABLE_BITS = np.uint64(0x9E3779B97F4A7C15), 18
WORD = re.compile(rb"[^ !-/:-@\[-`{-~]+")

#: White space of two bytes and more, with comment marks between.
WIDE = re.compile(rb"[ \t\n\v\f\r](?:[ \t\n\v\f\r]++|[#*/;%!>|-]{1,4}[ \t\n\v\f\r]++)++")


def folded(text: bytes) -> tuple[bytes, np.ndarray | None]:
    """The lowered text with one blank for each run of white space, and where its bytes stand in the text (None: the
    same places)."""
    lowered = text.translate(_LOWER)
    runs = [m.span() for m in WIDE.finditer(text)]
    if not runs:
        return lowered, None
    keep = np.ones(len(text), bool)
    for a, b in runs:
        keep[a + 1 : b] = False
    return np.frombuffer(lowered, np.uint8)[keep].tobytes(), np.flatnonzero(keep)


def grams(text: bytes) -> np.ndarray:
    """A mixed 64-bit value for every GRAM bytes of lowered text."""
    v = np.frombuffer(text, np.uint8).astype(np.uint64)
    for step in (1, 2, 4):
        v = v[:-step] | v[step:] << np.uint64(8 * step) if len(v) > step else v[:0]
    return v * _MIX


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of every window, the rightmost of equals; all of a shorter sequence's window."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    window = min(window, len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    last = window - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(np.arange(len(views)) + last)


def words(text: bytes) -> list[tuple[bytes, int, int]]:
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(text)]


class Index:
    """The inverted index of the templates' winnowed fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        lowered = [templates[n].encode().translate(_LOWER) for n in self.names]
        self.sizes = [len(t) for t in lowered]
        self.words = [[w for w, _, _ in words(t)] for t in lowered]
        self.starts = [np.array([a for _, a, _ in words(t)]) for t in lowered]
        self.entries: dict[int, list[tuple[int, int]]] = defaultdict(list)
        # Of notices shorter than the slack, neighbours must stay apart.
        self.slack = [min(SLACK, len(t) // 2) for t in lowered]
        self.needed = []
        for k, t in enumerate(lowered):
            hashes = grams(t)
            self.needed.append(max(1, MIN_HITS * len(winnow(hashes))))
            for at in winnow(hashes).tolist():
                self.entries[int(hashes[at])].append((k, at))
        self.seen = np.zeros(1 << _TABLE_BITS, bool)
        for h in self.entries:
            self.seen[h >> (64 - _TABLE_BITS)] = True

    def candidates(self, text: bytes) -> list[tuple[int, int]]:
        """(template, text position where it would begin) for each group of hits on nearby diagonals."""
        groups: dict[int, list[int]] = defaultdict(list)
        for begin in range(min(GRAM, len(text) - GRAM + 1)):
            # Every GRAM-th gram at once, read in place.
            hashes = np.frombuffer(text, "<u8", (len(text) - begin) // GRAM, begin) * _MIX
            hits = np.flatnonzero(self.seen.take((hashes >> np.uint64(64 - _TABLE_BITS)).view(np.int64)))
            if len(hits):
                for at, h in zip((hits * GRAM + begin).tolist(), hashes[hits].tolist(), strict=True):
                    for k, offset in self.entries.get(h, ()):
                        groups[k].append(at - offset)
        out = []
        for k, diagonals in groups.items():
            diagonals.sort()
            begin = 0
            for i in range(1, len(diagonals) + 1):
                if i == len(diagonals) or diagonals[i] - diagonals[i - 1] > self.slack[k]:
                    if i - begin >= self.needed[k]:
                        out.append((k, diagonals[(begin + i - 1) // 2]))
                    begin = i
        return out

    def align(self, k: int, at: int, text: bytes) -> tuple[float, int, int] | None:
        """(coverage, start, end) in bytes of template k near position at of the text, in the band of its diagonal."""
        template, low = self.words[k], max(0, at - 4 * SLACK)
        # Words are looked for in a stretch that is longer than the template by what the band allows.
        while low > 0 and text[low - 1] != 32 and low > at - 8 * SLACK:
            low -= 1
        found = words(text[low : at + self.sizes[k] + 8 * SLACK])
        if not found or not template:
            return None
        m, n = len(template), len(found)
        band = min(BAND, m // 3)  # a short notice must not reach its neighbours
        # The band's middle: the text word nearest to where the template should begin.
        base = min(range(n), key=lambda j: abs(found[j][1] + low - at))
        width = 2 * band + 1
        score = [[0] * (width + 2) for _ in range(m + 1)]
        move = [[0] * (width + 2) for _ in range(m + 1)]
        for i in range(1, m + 1):
            word = template[i - 1]
            for d in range(width):
                j = base + i - 1 + d - band
                # Cell (i, d) stands for text word j; its neighbours are (i-1, d), (i-1, d+1) and (i, d-1).
                best, step = score[i - 1][d + 1] if d + 1 < width else -1, 2
                if d and score[i][d - 1] > best:
                    best, step = score[i][d - 1], 3
                if 0 <= j < n and found[j][0] == word and score[i - 1][d] + 1 >= best:
                    best, step = score[i - 1][d] + 1, 1
                score[i][d], move[i][d] = max(best, 0), step
        d = max(range(width), key=lambda x: score[m][x])
        matched, i, first, last = score[m][d], m, None, None
        while i > 0 and 0 <= d < width:
            step = move[i][d]
            if step == 1:
                j = base + i - 1 + d - band
                first, last = found[j][1], last if last is not None else found[j][2]
                i -= 1
            elif step == 2:
                i, d = i - 1, d + 1
            else:
                d -= 1
        return (matched / m, low + first, low + last) if matched else None

    def matches(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end) of a UTF-8 text; positions in bytes."""
        lowered, at_byte = folded(text)
        best: dict[int, list[tuple[float, int, int]]] = defaultdict(list)
        for k, at in self.candidates(lowered):
            found = self.align(k, at, lowered)
            if found and found[0] >= MIN_COVERAGE:
                best[k].append(found)
        out = []
        for k, found in best.items():
            found.sort(key=lambda f: (f[1], f[2], -f[0]))
            chosen: list[tuple[float, int, int]] = []
            for f in found:  # by position, so only the last one chosen can overlap
                if chosen and f[1] < chosen[-1][2]:
                    if f[0] > chosen[-1][0]:
                        chosen[-1] = f
                else:
                    chosen.append(f)
            if at_byte is not None:
                chosen = [(c, int(at_byte[a]), int(at_byte[b - 1]) + 1) for c, a, b in chosen]
            out += [(self.names[k], *f) for f in chosen]
        return sorted(out, key=lambda m: (m[2], m[3], m[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, coverage, start and end (code points) of every match, and the matched text."""
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        index = Index(templates)
        for batch in small_slices(batches):
            rows = []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for name, coverage, a, b in index.matches(text):
                    start = len(text[:a].decode(errors="replace"))
                    passage = text[a:b].decode(errors="replace")
                    rows.append((d, name, coverage, start, start + len(passage), passage))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            names = ["doc_id", "license", "coverage", "start", "end", "passage"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id bigint, license string, coverage double, start bigint, end bigint, passage string"
    return texts(docs).mapInArrow(run, schema)
