"""Whole Arrow batches of texts as byte arrays: words, hashes and slices without a loop over characters.

Hashes are 64-bit polynomials over random byte values, finished with a mixer. A
hash stands for its string; two different strings of one table meet with
probability about ``pairs / 2**64``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = np.random.Generator(np.random.PCG64(20260101)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(n: int, up: bool = True) -> np.ndarray:
    """Powers 0 .. n-1 of the base, or of its inverse."""
    if len(_powers[up]) < n:
        got = np.full(max(n, CHUNK_BYTES + 1), _BASE if up else _INVERSE, np.uint64)
        got[0] = 1
        _powers[up] = np.cumprod(got, dtype=np.uint64)
    return _powers[up][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column in a row, and where each begins (one more at the end); null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    if not len(column) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]: at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about ``limit`` bytes; one longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def words(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words lie before each text (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~separator[data]
    before = np.empty_like(inside)
    before[1:], before[0] = inside[:-1], False
    after = np.empty_like(inside)
    after[:-1], after[-1] = inside[1:], False
    edges = at[(at > 0) & (at < len(data))]
    before[edges], after[edges - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, at)


def running_hashes(data: np.ndarray) -> np.ndarray:
    """What ``hashes_between`` needs of the bytes, for any number of spans."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers(len(data)), out=sums[1:])
    return sums


def hashes_between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    # The inverse power moves each span to place zero.
    h = (sums[ends] - sums[starts]) * powers(len(sums), up=False)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:end]``."""
    return hashes_between(running_hashes(data), starts, ends)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
