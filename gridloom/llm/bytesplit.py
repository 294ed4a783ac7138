"""Vectorised views of a batch of texts as bytes.

A batch's texts are one UTF-8 buffer plus row offsets, straight from Arrow.
All counts and hashes below are numpy passes over that buffer, so a task never
makes a Python object per word.  Words are maximal runs of bytes other than
0x20 and 0x09-0x0D, which equals ``[^\\x20\\x09-\\x0D]+`` on the characters:
UTF-8 never uses those bytes inside a longer character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240611)
#: Odd random multipliers by position in a word; longer words reuse them with a rotated value.
_MULT = _rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all (the public fmix64 step)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Texts:
    """Rows of one batch as a byte buffer and int64 offsets; null is empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.rows = len(offsets) - 1

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray | list) -> Texts:
        if isinstance(column, list):
            column = pa.array(column, type=pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = pc.fill_null(column, pa.scalar("", type=column.type))
        if len(column) == 0:
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        wide = pa.types.is_large_string(column.type)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(raw[at[0] : at[-1]], at - at[0])

    def parts(self, most: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
        """Row ranges of at most `most` bytes (or one row, if it is longer)."""
        at = 0
        while at < self.rows:
            end = int(np.searchsorted(self.offsets, self.offsets[at] + most, side="right")) - 1
            end = min(max(end, at + 1), self.rows)
            base = self.offsets[at]
            yield at, end, Texts(self.data[base : self.offsets[end]], self.offsets[at : end + 1] - base)
            at = end

    def row(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a byte-level array over each row."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


class Words:
    """Start, row and 64-bit hash of every word of `texts`."""

    def __init__(self, texts: Texts):
        self.texts = texts
        inside = ~SPACE[texts.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = texts.offsets[:-1][np.diff(texts.offsets) > 0]
        first[heads] = inside[heads]
        self.inside = inside
        self.starts = np.flatnonzero(first)
        self.bounds = np.searchsorted(self.starts, texts.offsets)
        self.counts = np.diff(self.bounds)
        self.row = np.repeat(np.arange(texts.rows), self.counts)
        self._first = first

    def hashes(self) -> np.ndarray:
        """A multilinear hash of each word's bytes and length, finalised."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        n = len(self.texts.data)
        which = np.cumsum(self._first, dtype=np.int32)
        at = np.arange(n, dtype=np.int64)
        at -= np.concatenate(([0], self.starts))[which]
        value = self.texts.data.astype(np.uint64)
        value += (at >> 12).astype(np.uint64) << np.uint64(9)
        value += np.uint64(1)
        value *= _MULT[at & 4095]
        value[~self.inside] = 0
        return mix(np.add.reduceat(value, self.starts))

    def grams(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first word of every k-word run inside a row, and the run's hash."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += hashes[j : j + n] * _GRAM[j]
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return at, mix(total[at])


def shingle_sets(texts: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each row, sorted: (flat values, row bounds).

    A row of one to k-1 words has the run of all its words as its one shingle;
    a row without words has none.
    """
    words = Words(texts)
    hashes = words.hashes()
    at, grams = words.grams(k, hashes)
    rows = words.row[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    found: list[np.ndarray] = []
    size = np.zeros(texts.rows, np.int64)
    cut = np.searchsorted(rows, np.arange(texts.rows + 1))
    lone = {int(r): hashes[words.bounds[r] : words.bounds[r + 1]] for r in short}
    for r in range(texts.rows):
        if r in lone:
            w = lone[r]
            one = mix((w * _GRAM[: len(w)]).sum(dtype=np.uint64, keepdims=True) + _GRAM[32 + len(w) : 33 + len(w)])
        else:
            one = np.unique(grams[cut[r] : cut[r + 1]])
        size[r] = len(one)
        found.append(one)
    bounds = np.zeros(texts.rows + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), bounds
