"""Word shingles of whole Arrow batches of texts, as 64-bit hashes in numpy arrays.

Words are runs of bytes other than space and TAB to CR, A-Z in lower case. A word's hash is a sum over its bytes of a
random table entry times a power, taken from one running sum over the batch; a shingle's hash mixes those of its words.
Work is done on runs of texts of about ``CHUNK`` bytes, whole texts each, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STEPS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, CHUNK)
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts: first row, last row + 1, their bytes and the offsets of each in them. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, at, raw = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets of each text's words in them."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(start)
    last = np.flatnonzero(end)
    power, inverse = _power(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[:n], out=total[1:])
    hashes = mix((total[last + 1] - total[first]) * inverse[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(first, at)


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``size`` words, repeats included, and the offsets of each text's.

    A text with fewer words, but some, has one shingle: all its words.
    """
    h, w = words(data, at)
    n = np.diff(w)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    first = w[:-1][doc] + (np.arange(out_at[-1]) - out_at[:-1][doc])
    out = np.zeros(len(first), np.uint64)
    width = np.minimum(n, size)[doc]
    for k in range(size):
        use = width > k
        if use.all():
            out = mix(out * _STEPS[0] + h[first + k] * _STEPS[k + 1])
        elif use.any():
            out[use] = mix(out[use] * _STEPS[0] + h[first[use] + k] * _STEPS[k + 1])
    return out ^ width.astype(np.uint64), out_at


def distinct(hashes: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's set of shingles, sorted."""
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        own = np.sort(hashes[a:b])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        yield own
