"""Wavelet matrix of integers in one compressed file: access, counting and occurrences without decoding the rest.

Plane l holds bit l (from the highest) of every value, in an order where the values with a 0 in plane l - 1 come first;
within either part the order stays. Planes are cut into blocks of 2^16 bits, each compressed on its own where that
makes it smaller. The directory behind them has the blocks' offsets, the ones before each block (rank; select searches
them), each plane's zeros and the bounds of the documents. The last bytes of the file tell where the directory is.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa

MAGIC = b"WAVELET1"
BLOCK_BITS = 1 << 16
TRAILER = "<QQQIIQ8s"  # directory's offset and bytes, values, planes, unpacked directory's bytes, documents, magic


def built(values: np.ndarray, width: int, keys: np.ndarray, nulls: np.ndarray, bounds: np.ndarray) -> bytes:
    """The file of some documents' values below ``2^width``; document i has ``values[bounds[i]:bounds[i + 1]]``."""
    n, parts, sizes, ranks, zeros = len(values), [], [], [], []
    for level in range(width):
        bit = values & values.dtype.type(1 << (width - 1 - level)) != 0
        packed = np.packbits(bit, bitorder="little").tobytes()
        blocks = [packed[i : i + BLOCK_BITS // 8] for i in range(0, len(packed), BLOCK_BITS // 8)]
        for raw in blocks:
            small = pa.compress(raw, codec="zstd", asbytes=True)
            parts.append(small if len(small) < len(raw) else raw)
            sizes.append(len(parts[-1]))
        ones = np.add.reduceat(bit, np.arange(0, n, BLOCK_BITS), dtype=np.uint64) if n else np.zeros(0, np.uint64)
        ranks.append(np.concatenate(([0], np.cumsum(ones))).astype(np.uint64))
        values = np.concatenate((values[~bit], values[bit]))
        zeros.append(n - int(ranks[-1][-1]))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.uint64)
    arrays = (np.array(zeros, np.uint64), offsets, *ranks, keys.astype(np.int64), nulls.astype(np.uint8), bounds.astype(np.uint64))
    raw = b"".join(a.tobytes() for a in arrays)
    directory = pa.compress(raw, codec="zstd", asbytes=True)
    return b"".join([*parts, directory, struct.pack(TRAILER, int(offsets[-1]), len(directory), n, width, len(raw), len(keys), MAGIC)])


class Wavelet:
    """A file's values; reads the directory at once and blocks of planes when they are needed."""

    def __init__(self, source, blocks: int = 64):
        """``source``: an open random access file of ``pyarrow.fs``. ``blocks``: how many unpacked ones are kept."""
        self.source = source
        size = source.size()
        at, packed, self.n, self.width, raw, docs, magic = struct.unpack(TRAILER, source.read_at(length := struct.calcsize(TRAILER), size - length))
        if magic != MAGIC:
            raise ValueError("not a wavelet file")
        data = pa.decompress(source.read_at(packed, at), decompressed_size=raw, codec="zstd", asbytes=True)
        self.blocks = -(-self.n // BLOCK_BITS)
        kinds = [(np.uint64, self.width), (np.uint64, self.width * self.blocks + 1), *[(np.uint64, self.blocks + 1)] * self.width]
        arrays, place = [], 0
        for kind, count in [*kinds, (np.int64, docs), (np.uint8, docs), (np.uint64, docs + 1)]:
            arrays.append(np.frombuffer(data, kind, count, place).astype(np.int64))
            place += arrays[-1].size * np.dtype(kind).itemsize
        self.zeros, self.offsets, *self.ranks = arrays[: self.width + 2]
        self.keys, self.nulls, self.bounds = arrays[self.width + 2], arrays[self.width + 3] != 0, arrays[self.width + 4]
        self._sums = lru_cache(blocks)(self._unpacked_sums)

    def _bits(self, plane: int, block: int) -> np.ndarray:
        k = plane * self.blocks + block
        held = self.source.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
        count = min(BLOCK_BITS, self.n - block * BLOCK_BITS)
        raw = -(-count // 8)
        if len(held) != raw:
            held = pa.decompress(held, decompressed_size=raw, codec="zstd", asbytes=True)
        return np.unpackbits(np.frombuffer(held, np.uint8), count=count, bitorder="little")

    def _unpacked_sums(self, plane: int, block: int) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self._bits(plane, block), dtype=np.int32)))

    def _each_block(self, where: np.ndarray):
        order = np.argsort(where, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1) if len(order) else []:
            yield int(where[part[0]]), part

    def _rank(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place, which may be the end."""
        found = np.empty(len(at), np.int64)
        for block, part in self._each_block(np.minimum(at // BLOCK_BITS, max(0, self.blocks - 1))):
            found[part] = self.ranks[plane][block] + (self._sums(plane, block)[at[part] - block * BLOCK_BITS] if self.n else 0)
        return found

    def _select(self, plane: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Place of the nth (from 0) one or zero."""
        before = self.ranks[plane] if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK_BITS, self.n) - self.ranks[plane]
        found = np.empty(len(nth), np.int64)
        for block, part in self._each_block(np.searchsorted(before, nth, side="right") - 1):
            sums = self._sums(plane, block)
            own = sums if bit else np.arange(len(sums)) - sums
            found[part] = block * BLOCK_BITS + np.searchsorted(own, nth[part] - before[block] + 1) - 1
        return found

    def access(self, at: np.ndarray) -> np.ndarray:
        """The values at some places."""
        at, value = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for plane in range(self.width):
            ones = self._rank(plane, at)
            bit = self._rank(plane, at + 1) - ones
            value = 2 * value + bit
            at = np.where(bit == 1, self.zeros[plane] + ones, at - ones)
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        """Where a value's occurrences among the places from start to end lie below the last plane."""
        if not 0 <= value < 1 << self.width or start >= end:
            return 0, 0
        for plane in range(self.width):
            ones = self._rank(plane, np.array([start, end]))
            start, end = (self.zeros[plane] + ones if value >> (self.width - 1 - plane) & 1 else np.array([start, end]) - ones).tolist()
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often a value occurs among the places from start to end."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def occurrences(self, value: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """Places of a value, ascending."""
        a, b = self._range(value, start, self.n if end is None else end)
        at = np.arange(a, b)
        for plane in reversed(range(self.width)):
            bit = value >> (self.width - 1 - plane) & 1
            at = self._select(plane, bit, at - (self.zeros[plane] if bit else 0))
        return at

    def values(self) -> np.ndarray:
        """All values, from the last plane up."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for plane in reversed(range(self.width)):
            bit = np.concatenate([self._bits(plane, b) for b in range(self.blocks)]).view(bool) if self.n else np.zeros(0, bool)
            z, above = self.zeros[plane], np.empty(self.n, kind)
            above[bit] = value[z:] | kind(1 << (self.width - 1 - plane))
            above[~bit] = value[:z]
            value = above
        return value
