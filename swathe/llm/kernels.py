"""Vectorised byte kernels over Arrow string columns.

All hashes are polynomial prefix sums over bytes modulo 2**64 (an odd base, so that powers are
invertible), passed through a finaliser. A prefix array gives the hash of any substring in O(1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(20240501)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PLACE = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * U(2) + U(1)

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK_BYTES + 1024)
        a = np.full(size, BASE, np.uint64)
        b = np.full(size, BASE_INV, np.uint64)
        a[0] = b[0] = 1
        _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def prefix(data: np.ndarray) -> np.ndarray:
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Finalised hashes of the substrings [start, end)."""
    _, inv = powers(len(pre))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64) * PLACE[7])


def strings(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = col.buffers()
    offs = np.frombuffer(raw[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text has a range of its own, whole."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space, and for each text its first word's index.

    ``offs`` begins at 0; words never cross texts.
    """
    n = len(data)
    solid = ~space[data]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles, A-Z lower-cased."""
    low = LOWER[data]
    starts, ends, first = words(low, offs)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(offs) - 1)
    w = span_hash(prefix(low), starts, ends)
    m = len(w) - k + 1
    if m > 0:
        roll = w[:m] * PLACE[0]
        for i in range(1, k):
            roll += w[i : i + m] * PLACE[i]
        roll = mix(roll)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(roll[a : b - k + 1]))
        elif b > a:
            part = w[a:b] * PLACE[: b - a]
            out.append(mix(part.sum(dtype=np.uint64, keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
