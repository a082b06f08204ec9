"""Words of many texts as numpy arrays, straight from Arrow buffers.

A word's hash is a polynomial over its bytes in 64 bits, taken from prefix sums, so that no word becomes an object.
"""

from __future__ import annotations

import ctypes
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_M = 0x9E3779B97F4A7C15
_INV = pow(_M, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WINDOW = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def _powers(m: int, n: int) -> np.ndarray:
    if m not in _POWERS or len(_POWERS[m]) < n:
        a = np.full(max(n, WINDOW * 2), m, np.uint64)
        a[0] = 1
        _POWERS[m] = np.cumprod(a)
    return _POWERS[m][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spans(columns: list[pa.Array], rows: int = 1024, size: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of rows (first, number) with at most ``rows`` rows and, but for single rows, ``size`` bytes of text."""
    n = len(columns[0])
    end = sum(np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)) for c in columns)
    out, at, done = [], 0, 0
    while at < n:
        stop = min(n, at + rows, max(at + 1, int(np.searchsorted(end, done + size, "right"))))
        out.append((at, stop - at))
        at, done = stop, int(end[stop - 1])
    return out


def bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of all rows begins and ends, in order."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[raw]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(raw))]
    begin[edges] |= word[edges]
    end[edges - 1] |= word[edges - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash of each word. ``lower`` maps A-Z to a-z first."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + WINDOW, "right")))
        a, b = starts[i], ends[j - 1]
        part = raw[a:b]
        values = _BYTE[_LOWER[part] if lower else part] * _powers(_M, b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * _powers(_INV, b - a)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def words(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of all rows, in order."""
    starts, ends = bounds(raw, at)
    return hashes(raw, starts, ends, lower), np.searchsorted(at, starts, "right") - 1


def trimmed(f):
    """``f``, which turns batches into batches, with the memory that it freed handed back once it has ended: Python workers
    live on from task to task, and would keep the most that any of them ever took."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return run


def runs(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
