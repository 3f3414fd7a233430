"""Words of Arrow text columns as numpy arrays, and polynomial hashes over them.

A word is a maximal run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``; UTF-8
continuation bytes never are white space). All hashes are arithmetic modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

SLICE_BYTES = 2 << 20
LONG_WORD = 64
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads the low bits over the whole word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))


@cache
def _power_table(base: int, log_size: int) -> np.ndarray:
    table = np.full(1 << log_size, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1); tables are kept by powers of two."""
    return _power_table(base, max(16, int(n - 1).bit_length() if n > 1 else 0))[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Rolling:
    """Hashes of ranges of a sequence: sum of x[i] * base**(end - 1 - i)."""

    def __init__(self, x: np.ndarray, base: int):
        self.base = base
        down = powers(inverse(base), len(x))
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * down, out=self.sums[1:])
        self.up = powers(base, len(x) + 1)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        last = np.maximum(end - 1, 0)
        return (self.sums[end] - self.sums[start]) * self.up[last]


@dataclass
class Words:
    """Words of some texts, in order; ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """One 64-bit hash a word, equal for equal words of any batch or task."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        rolling = Rolling(BYTE_CODES[self.data], BYTE_BASE)
        size = self.end - self.start
        h = mix(rolling.ranges(self.start, self.end) + size.astype(np.uint64))
        for i in np.flatnonzero(size > LONG_WORD):  # their polynomials could be made to collide
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]].tobytes())
        return h

    def heads(self, which: np.ndarray) -> np.ndarray:
        """First eight bytes of some words, mixed with their lengths."""
        start, size = self.start[which], self.end[which] - self.start[which]
        head = size.astype(np.uint64)
        for k in range(8):
            byte = self.data[np.minimum(start + k, len(self.data) - 1)]
            head = head * np.uint64(257) + np.where(k < size, byte, 0).astype(np.uint64)
        return head

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def split(texts: pa.Array) -> Words:
    data, at = utf8(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(at), np.int64))
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text each; a longer text stands alone."""
    size = np.zeros(len(texts), np.int64)
    lengths = pa.compute.binary_length(texts.cast(pa.large_binary()))
    size[:] = np.asarray(lengths.fill_null(0))
    begin, total = 0, 0
    for i, s in enumerate(size):
        if i > begin and total + s > limit:
            yield begin, i
            begin, total = i, 0
        total += s
    if begin < len(texts):
        yield begin, len(texts)
