"""Texts of an Arrow column as flat numpy arrays: words, lines and their 64-bit hashes.

A word is a run of bytes that are none of space, tab, line feed, vertical tab, form feed and
carriage return. Those are single bytes of UTF-8 and never part of a longer character, so all of
this works on bytes. Hashes are polynomials over a table of random values, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_random = np.random.default_rng(20240131)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of text that are held as flat arrays at a time; a longer text stands alone.
SLICE_BYTES = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Texts:
    """UTF-8 of some rows: data[offsets[i]:offsets[i + 1]] is row i."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, texts) over a string column, null as empty, of about `limit` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.string()).fill_null("")
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Pieces:
    """Runs of bytes: piece i is data[start[i]:end[i]] of row row[i]; rows in order."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def bounds(self, rows: int) -> np.ndarray:
        """Row r has the pieces bounds[r] to bounds[r + 1]."""
        return np.searchsorted(self.row, np.arange(rows + 1))


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE, base: np.uint64 = _BASE) -> np.ndarray:
    """Of data[starts[i]:ends[i]]; ascending, not overlapping, none empty. Another table and base give other 64 bits."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    at = np.arange(int(length.sum())) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), base, np.uint64))
    value = table[data[at + np.repeat(starts, length)]] * power[at]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64) * _ODD[0])


def words(texts: Texts, lower: bool = True) -> Pieces:
    """All words, A-Z lowered for the hash if asked for."""
    data = LOWER[texts.data] if lower else texts.data
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[texts.offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Pieces(np.searchsorted(texts.offsets, start, "right") - 1, start, end, _hash(data, start, end))


def lines(texts: Texts) -> Pieces:
    r"""All \n-split lines that aren't empty."""
    data = texts.data
    inside = data != 10
    cut = np.zeros(len(data) + 1, bool)
    cut[texts.offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Pieces(np.searchsorted(texts.offsets, start, "right") - 1, start, end, _hash(data, start, end))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each `width` neighbours; len(hashes) - width + 1 values, at least none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += mix(hashes[j : j + n] * _ODD[1 + j % 63] + np.uint64(j))
    return mix(out)


def shingle_sets(texts: Texts, width: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its `width`-word shingles, A-Z lowered.

    A row with fewer words has one shingle, the whole; without words it has none.
    """
    found = words(texts)
    bounds = found.bounds(len(texts))
    every = windows(found.hash, width)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        elif b > a:
            out.append(windows(np.append(found.hash[a:b], np.uint64(b - a)), int(b - a) + 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
