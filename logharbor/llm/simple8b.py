"""Simple-8b words: a selector in the top four bits says how many ids of which width the other sixty hold.

Packing and unpacking work on whole arrays. An id of sixty bits or more escapes: its word is followed by a raw word.
"""

from __future__ import annotations

import numpy as np

# Ids per word and bits per id of selectors 0 to 15; selector 15 announces a raw word.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
# The last plain selector holds one id of 60 bits; the escape has no selector number of its own left, so a word of
# selector 15 whose sixty bits are all ones announces a raw word.
ESCAPE = np.uint64((1 << 64) - 1)
ONE, LIMIT = 15, (1 << 60) - 1
STEPS = np.array(COUNTS, np.uint8)
SMALL_WIDTHS = np.repeat(np.arange(17, dtype=np.uint8), [1, *(1 << b for b in range(16))])


def widths_of(values: np.ndarray) -> np.ndarray:
    """Bits each unsigned value takes, as bytes; 0 for 0."""
    if len(values) and int(values.max()) < 1 << 16:
        return SMALL_WIDTHS[values]
    left, bits = values.astype(np.uint64), np.zeros(len(values), np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        high = left >= np.uint64(1) << np.uint64(shift)
        bits[high] += shift
        left = np.where(high, left >> np.uint64(shift), left)
    return bits + (left > 0).astype(np.uint8)


def pack(values: np.ndarray) -> np.ndarray:
    """The words of one run of unsigned ids."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    bits = widths_of(values)
    escaped = values >= LIMIT if int(bits.max()) >= 60 else None
    choice = np.full(n, ONE, np.uint8)
    # From the widest selector to the narrowest, so the one that holds most ids wins. Beyond the end any width fits.
    for s in range(ONE - 1, -1, -1):
        count, width = COUNTS[s], WIDTHS[s]
        fits = np.ones(n + count, bool)
        np.less_equal(bits, width, out=fits[:n])
        have = 1
        while have < count and fits[:n].any():
            step = min(have, count - have)
            fits[: len(fits) - step] &= fits[step:]
            have += step
        if have < count:
            break  # no run is that narrow, so fewer bits hold no longer one either
        choice[fits[:n]] = s
    steps, at, starts = STEPS[choice].tobytes(), 0, []
    push = starts.append
    while at < n:
        push(at)
        at += steps[at]
    starts = np.array(starts, np.int64)
    picked = choice[starts]
    padded = np.zeros(n + max(COUNTS), np.uint64)
    padded[:n] = values
    words = np.zeros(len(starts), np.uint64)
    for s in np.unique(picked).tolist():
        rows = np.flatnonzero(picked == s)
        word = np.full(len(rows), np.uint64(s) << np.uint64(60), np.uint64)
        if WIDTHS[s]:
            for j in range(COUNTS[s]):
                word |= (padded[starts[rows] + j] & np.uint64(LIMIT)) << np.uint64(j * WIDTHS[s])
        words[rows] = word
    if escaped is not None and escaped.any():
        raw = np.flatnonzero(escaped[starts])
        words[raw] = ESCAPE
        words = np.insert(words, raw + 1, padded[starts[raw]])
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of a run of words."""
    words = np.ascontiguousarray(words, np.uint64)
    follows = np.zeros(len(words), bool)
    marks = np.flatnonzero(words == ESCAPE)
    if len(marks):
        # A raw word may look like a mark itself: in a run of such words every second one is raw.
        first = np.ones(len(marks), bool)
        first[1:] = np.diff(marks) != 1
        head = np.maximum.accumulate(np.where(first, np.arange(len(marks)), 0))
        marks = marks[(np.arange(len(marks)) - head) % 2 == 0]
        follows[marks + 1] = True
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS, np.int64)[selector]
    counts[follows] = 0
    begins = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector[~follows]).tolist():
        if not WIDTHS[s]:
            continue
        rows = np.flatnonzero((selector == s) & ~follows)
        mask = np.uint64((1 << WIDTHS[s]) - 1)
        for j in range(COUNTS[s]):
            out[begins[rows] + j] = (words[rows] >> np.uint64(j * WIDTHS[s])) & mask
    if len(marks):
        out[begins[marks]] = words[marks + 1]
    return out[:n]
