"""Words and their 64-bit hashes, for whole Arrow batches at once.

A word is a run of bytes other than space and 09-0D; A-Z count as a-z. The hash is a polynomial over a random
number for each byte, mixed with the length. Equal words have equal hashes; different ones meet by chance in
one of 2^64 cases. Long texts are cut at white space, so memory follows the chunk and not the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
ODD = 0x9E3779B97F4A7C15
ODD2 = 0xD6E8FEB86659FD93
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)[LOWER]
_POWERS: dict[int, np.ndarray] = {}
Cuts = Callable[[np.ndarray], np.ndarray]


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the word."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(ODD2)
    h ^= h >> np.uint64(29)
    h *= np.uint64(ODD)
    h ^= h >> np.uint64(32)
    return h


def _chunks(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about CHUNK bytes that end at a row's end or between words."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + CHUNK, end)
        if stop < end:
            row = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
            if row > at:
                stop = row
            else:
                limit = int(offsets[np.searchsorted(offsets, at, side="right")])
                while stop < limit:
                    gap = np.flatnonzero(gaps[data[stop : min(stop + CHUNK, limit)]])
                    if len(gap):
                        stop += int(gap[0])
                        break
                    stop = min(stop + CHUNK, limit)
        yield at, stop
        at = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the rows' offsets; a null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def words(texts: pa.Array, gaps: np.ndarray = SPACE, values: np.ndarray = VALUES, cuts: Cuts | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: the words' hashes, rows, first bytes and bytes after the last, in the order of the text.

    ``gaps`` tells which bytes lie between words, ``values`` has each byte's random number; ``cuts`` tells, given a
    chunk, before which of its bytes a word ends in any case.
    """
    data, offsets = buffers(texts)
    inverse = pow(ODD, -1, 1 << 64)
    for a, b in _chunks(data, offsets, gaps):
        d = data[a:b]
        gap = gaps[d]
        cut = np.zeros(b - a + 1, dtype=bool)
        cut[0] = cut[-1] = True
        cut[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, side="right")] - a] = True
        if cuts is not None:
            cut[:-1] |= cuts(d)
        before, after = cut[:-1].copy(), cut[1:].copy()
        before[1:] |= gap[:-1]
        after[:-1] |= gap[1:]
        starts, ends = np.flatnonzero(before & ~gap), np.flatnonzero(after & ~gap) + 1
        sums = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(values[d] * _powers(ODD, b - a)[: b - a], out=sums[1:])
        h = (sums[ends] - sums[starts]) * _powers(inverse, b - a)[starts]
        h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(ODD2))
        yield h, np.searchsorted(offsets, a + starts, side="right") - 1, a + starts, a + ends


def all_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all words of a batch."""
    parts = [(h, r) for h, r, _, _ in words(texts)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def shingle_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of every row, one after the other, and the rows' bounds.

    A row with fewer than n words has one shingle, the whole sequence; a row without words has none.
    """
    h, row = all_words(texts)
    count = np.bincount(row, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(count)))
    m = max(0, len(h) - n + 1)
    grams = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        grams = (grams + h[i : i + m]) * np.uint64(ODD2) + np.uint64(ODD)
    whole = row[:m] == row[n - 1 : n - 1 + m]
    grams, owner = mix(grams[whole]), row[:m][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = []
        for r in short:
            g = np.uint64(int(count[r]))
            for x in h[first[r] : first[r + 1]]:
                g = np.uint64(((int(g) + int(x)) * ODD2 + 1) & (2**64 - 1))
            own.append(g)
        grams, owner = np.concatenate([grams, mix(np.array(own, dtype=np.uint64))]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        grams[a:b].sort()
    keep = np.ones(len(grams), dtype=bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[keep], np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))))
