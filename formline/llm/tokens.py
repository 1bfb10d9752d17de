"""Words of whole Arrow text columns as numpy arrays: places, rows and 64-bit hashes, in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Rows are taken together up to this many bytes.
SLICE_BYTES = 1 << 20

_RANDOM = np.random.Generator(np.random.PCG64(7))
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Word bytes: everything but white space; or digits, lower-case letters and all that is not ASCII.
NOT_SPACE = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
ALPHANUMERIC = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


@dataclass
class Words:
    """Words of some rows, in order: row of each, byte places in ``data``, hash; ``first`` bounds each row's words."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the bounds of its rows; a missing text is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None and held.size else np.empty(0, np.uint8)
    return data, bounds - bounds[0]


def slices(bounds: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``size`` bytes at most; a longer row is a range of its own."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def _hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word over random byte values, some words at a time."""
    out, before = np.empty(len(starts), np.uint64), np.cumsum(lens) - lens
    powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(lens.max(initial=1)), _BASE))))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + SLICE_BYTES, "left")))
        at = before[lo:hi] - before[lo]
        within = np.arange(at[-1] + lens[hi - 1]) - np.repeat(at, lens[lo:hi])
        values = _BYTE[data[np.repeat(starts[lo:hi], lens[lo:hi]) + within]] * powers[within]
        out[lo:hi] = np.add.reduceat(values, at)
        lo = hi
    return mixed(out)


def words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, lower: bool) -> Words:
    """All words of the rows: longest runs of word bytes, after lower-casing A to Z where asked for."""
    base, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    if lower:
        base = _LOWER[base]
    inside = is_word[base]
    edge = np.zeros(len(base) + 1, bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, bounds)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(base, rows, starts, ends, _hashes(base, starts, ends - starts), first)


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each place on, and whether they all lie in one row."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, n, np.uint64)
    for i in range(n):
        out = out * _BASE + hashes[i : i + count]
    return mixed(out), rows[:count] == rows[n - 1 : n - 1 + count]
