"""Words and word n-grams of a batch of texts as NumPy arrays, straight from Arrow's buffers.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; in UTF-8 these bytes occur in no other character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1024), base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known


@dataclass
class Words:
    """data: all bytes; ends: where each document ends in it (with a 0 in front); start, end: of each word; doc: the
    document of each word; first: the first word of each document, and the number of words."""

    data: np.ndarray
    ends: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self, base: int = 0, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, from one of two independent bases, or others by salt."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lengths = self.end - self.start
        inside = np.repeat(self.start - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        place = inside - np.repeat(self.start, lengths)
        value = (self.data[inside].astype(np.uint64) + np.uint64(1)) * _power(int(_BASES[base]) ^ salt << 8, int(lengths.max()))[place]
        return mix(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))

    def per_doc(self, of_words: np.ndarray) -> np.ndarray:
        """Sums over each document's words."""
        total = np.concatenate(([0], np.cumsum(of_words)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within one document, and the word that each begins with."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        begin = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        value = np.zeros(n, np.uint64)
        for i in range(k):
            value = value * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
        return mix(value[begin]), begin


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and its n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(column: pa.Array) -> Words:
    data, ends = buffers(column)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    first = np.searchsorted(start, ends)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(first))
    return Words(data, ends, start, end, doc, first)
