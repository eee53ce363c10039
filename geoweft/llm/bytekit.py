"""Vectorised byte kernels over Arrow string columns.

Words of all the operators are runs of bytes of one class (the separators are ASCII), so word bounds
and word hashes of a whole Arrow batch come from a few passes over its UTF-8 buffer.
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd multipliers of the finaliser of a 64-bit mixer.
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: True for bytes inside words of ``[^\x20\x09-\x0D]+``.
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: True for bytes inside words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer, element-wise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _M1
        x = (x ^ (x >> _U(27))) * _M2
        return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def runs(raw: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the words' bounds by row; no word crosses rows."""
    n = len(raw)
    inside = table[raw]
    first = inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        edges = bounds[:-1][bounds[:-1] < n]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = bounds[1:][bounds[1:] > 0] - 1
        last[ends] = inside[ends]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    else:
        start = end = np.zeros(0, np.int64)
    return start, end, np.searchsorted(start, bounds)


class Hasher:
    """Polynomial hashes mod 2^64 of many byte ranges of one buffer."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            with np.errstate(over="ignore"):
                up, down = np.full(n, _BASE, _U), np.full(n, pow(_BASE, -1, 1 << 64), _U)
                up[0] = down[0] = 1
                self.power, self.inverse = np.cumprod(up), np.cumprod(down)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        """``p`` with ``p[j] - p[i]`` the hash of bytes i to j, times the power of i."""
        self._grow(len(raw) + 1)
        out = np.zeros(len(raw) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE[raw] * self.power[: len(raw)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of the ranges; equal bytes give equal hashes wherever they stand."""
        with np.errstate(over="ignore"):
            return mix((prefix[end] - prefix[start]) * self.inverse[start] + (end - start).astype(_U))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, hasher: Hasher, step: int = 1 << 19) -> np.ndarray:
    """Hashes of words; the buffer is passed in pieces of ``step`` bytes, which bounds memory."""
    out = np.empty(len(start), _U)
    i = 0
    while i < len(start):
        at = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, at + step, "right")))
        prefix = hasher.prefix(raw[at : int(end[j - 1])])
        out[i:j] = hasher.of(prefix, start[i:j] - at, end[i:j] - at)
        i = j
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` consecutive words that begin at each place, for all places with so many."""
    if len(words) < n:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.zeros(len(words) - n + 1, _U)
        for k in range(n):
            out = mix(out * _U(_BASE) + words[k : len(words) - n + 1 + k])
    return out


def take(arrays: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype)


def slices(batches, column: str, limit: int = 2 << 20):
    """Arrow batches cut so that ``column`` holds about ``limit`` bytes in each; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def tidy(f):
    """A partition function that gives freed memory back at its end: workers live on, and allocators keep it."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def range_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over index ranges."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[end] - total[start]


class SequenceHasher(Hasher):
    """Hashes of ranges of a sequence of 64-bit symbols."""

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        self._grow(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(symbols * self.power[: len(symbols)], out=out[1:])
        return out

    def of_ranges(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.of(self.prefix(symbols), start, end)
