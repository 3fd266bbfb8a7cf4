"""Vectorised text kernels on Arrow buffers.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r. The delimiters are
ASCII, so splitting the UTF-8 bytes equals splitting the code points. Hashes are
64-bit polynomials over bytes (words) or over word hashes (shingles), finished
by an avalanche mix; arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Bytes hashed at a time: bounds the 64-bit work arrays whatever a text's length.
CHUNK = 1 << 19
SPACES = b" \t\n\x0b\x0c\r"


def mix64(x: np.ndarray) -> np.ndarray:
    """An avalanche permutation of 64-bit words."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that depend on ``seed`` alone."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 2654435761 % (1 << 64))) | _U(1)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


@lru_cache(maxsize=4)
def _byte_table(fold: bool) -> np.ndarray:
    table = seeds(256, 11).copy()
    if fold:
        table[65:91] = table[97:123]
    table[list(SPACES)] = 0
    return table


@lru_cache(maxsize=1)
def _space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    return table


_BASE = 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK * 2)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about CHUNK bytes that end between words."""
    space, a, n = _space_table(), 0, len(data)
    while a < n:
        b = min(n, a + CHUNK)
        while b < n:
            stop = int(offsets[min(np.searchsorted(offsets, b), len(offsets) - 1)])
            found = np.flatnonzero(space[data[b : min(n, b + 65536, max(stop, b + 1))]])
            if len(found):
                b += int(found[0])
                break
            if stop <= b + 65536:
                b = stop
                break
            b += 65536
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False, hashes: bool = True, head: int | None = None):
    """(starts, ends, hashes, first): byte spans of all words and hashes of them (of their first ``head`` bytes); text i has words first[i]:first[i+1]."""
    space, table = _space_table(), _byte_table(fold)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends, out = [], [], []
    for a, b in _cuts(data, offsets):
        part = data[a:b]
        gap = space[part]
        before = np.empty(b - a, bool)
        before[0] = True
        before[1:] = gap[:-1]
        before |= edge[a:b]
        s = np.flatnonzero(before & ~gap)
        after = np.empty(b - a, bool)
        after[-1] = True
        after[:-1] = gap[1:] | edge[a + 1 : b]
        e = np.flatnonzero(after & ~gap) + 1
        if hashes:
            up, down = _power_tables(b - a + 1)
            with np.errstate(over="ignore"):
                sums = np.zeros(b - a + 1, _U)
                np.cumsum(table[part] * up[: b - a], out=sums[1:])
                stop = e if head is None else np.minimum(e, s + head)
                out.append(mix64((sums[stop] - sums[s]) * down[s] + (stop - s).astype(_U)))
        starts.append(s + a)
        ends.append(e + a)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    e = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    h = np.concatenate(out) if out else np.zeros(0, _U)
    return s, e, h, np.searchsorted(s, offsets)


def shingles(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of k consecutive items of h (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        c, out = seeds(k, 101 + seed), np.zeros(n, _U)
        for t in range(k):
            out += h[t : t + n] * c[t]
    return mix64(out)


def word_sets(h: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text: the sorted distinct k-word shingles; a shorter text's whole sequence as one; empty without words."""
    out = []
    whole = shingles(h, k)
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            out.append(mix64(shingles(h[a:b], b - a, seed=b - a)))
        else:
            out.append(np.zeros(0, _U))
    return out


def batches(frames: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of ``column``, at least a row and at most ``rows`` each."""
    for batch in frames:
        _, off = texts(batch.column(column))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
            b = b if rows is None else min(b, a + rows)
            yield batch.slice(a, b - a)
            a = b
