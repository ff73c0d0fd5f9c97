"""Vectorised tokenising and hashing of Arrow string columns with numpy.

A batch's texts are one UTF-8 buffer plus offsets; everything here works on
slices of that buffer of about ``CHUNK`` bytes (never less than one text), so
memory is bounded by the longest text and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("0") : ord("9") + 1] = True
_WORD[128:] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts; no copy where there are no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after last, bytes, offsets from 0) of runs of texts of about ``size`` bytes."""
    if not len(column):
        return
    data, offsets = buffers(column)
    row, last = 0, len(offsets) - 1
    while row < last:
        end = min(last, max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def fold(raw: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters that UTF-8 writes as C3 80..9E."""
    low = _FOLD[raw]
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    if len(second):
        b = raw[second]
        up = second[(b >= 0x80) & (b <= 0x9E) & (b != 0x97)]
        low[up] += 0x20
    return low


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _P, np.uint64), np.full(n, _PINV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from one prefix sum of a polynomial modulo 2**64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(max(CHUNK.bit_length() + 1, int(len(low)).bit_length() + 1))
    total = np.empty(len(low) + 1, np.uint64)
    total[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, first byte) of every word: a longest run of letters, digits and non-ASCII
    characters, in lower case, never across two texts."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = fold(raw)
    edge = np.zeros(len(raw) + 1, dtype=bool)  # a text begins here
    edge[offsets] = True
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _WORD[low]
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return span_hashes(low, starts, ends), np.searchsorted(offsets, starts, "right") - 1, starts


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, plus the length as the last entry."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)])).astype(np.int64)


def distinct_pairs(owner: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, value, count) of the distinct pairs in order; value < 2**bits, owner < 2**(63-bits)."""
    key = (owner.astype(np.uint64) << np.uint64(bits)) | value.astype(np.uint64)
    key.sort()
    at = runs(key)
    key = key[at[:-1]]
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64), np.diff(at)


def segment_sum(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Row sums of ``values`` (axis 0) by a sorted ``owner``; zero for owners without rows."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    at = runs(owner)
    if len(at) > 1:
        out[owner[at[:-1]]] = np.add.reduceat(values, at[:-1], axis=0)
    return out
