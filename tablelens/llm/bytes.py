"""Texts of Arrow batches as byte arrays: slices of bounded size, words, and hashes of spans, all without a loop over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (one longer text is taken whole).
SLICE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batch that hold about ``limit`` bytes of text each."""
    _, offsets = text_bytes(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), at + rows, n)
        yield batch.slice(at, end - at)
        at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and where each begins and the last ends; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ``outside``, and each text's first word number (one more at the end)."""
    inside = ~outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def _weights(seed: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F) + U64(seed))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands."""
    n = len(data)
    powers = np.full(n + 1, _BASE, U64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_weights(seed)[data] * powers[:n], out=sums[1:])
    back = np.full(n + 1, _INVERSE, U64)
    back[0] = 1
    np.cumprod(back, out=back)
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64) * U64(0xE7037ED1A0B428DB))


def per_text(reduce, values: np.ndarray, bounds: np.ndarray, empty: float) -> np.ndarray:
    """reduce.reduceat over each text's values; texts without any get ``empty``."""
    out = np.full(len(bounds) - 1, empty, values.dtype if len(values) else float)
    full = bounds[:-1] < bounds[1:]
    if full.any():
        out[full] = reduce.reduceat(values, bounds[:-1][full])
    return out
