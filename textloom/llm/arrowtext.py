"""Whole texts as numpy arrays: words, polynomial word hashes and shingles over an Arrow batch.

Batches are worked on in slices of a few megabytes of text, so memory is bounded by the slice or by
the longest single text. Null text is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_P_INV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20_240_601).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, n = 0, batch.num_rows
        ends = np.cumsum(sizes, dtype=np.int64)
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, done + limit, side="right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, n + 1 offsets)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def spans(data: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the runs without ``gap`` bytes; rows end runs; first[i] is row i's first run."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~gap
    start, end = inside.copy(), inside.copy()
    start[1:] &= gap[:-1]
    end[:-1] &= gap[1:]
    cuts = off[(off > 0) & (off < len(data))]
    start[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(data, off, _SPACE[data])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _P, np.uint64), np.full(size, _P_INV, np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[size]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values; equal runs give equal hashes anywhere."""
    up, down = _power(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal bytes give equal hashes anywhere."""
    return run_hashes(_BYTE[data], starts, ends)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, n rows + 1 offsets), repeats included; a row with fewer than ``n`` words has its whole sequence as one."""
    count = np.diff(first)
    sizes = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(sizes)])
    acc = np.full(len(hashes), n, np.uint64)
    for k in range(n):
        acc[: len(hashes) - k] = mix64(acc[: len(hashes) - k] * np.uint64(_P) + hashes[k:])
    out = np.zeros(off[-1], np.uint64)
    long = count >= n
    if len(hashes):
        take = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(take, first[:-1][long], 1)
        np.add.at(take, first[1:][long] - n + 1, -1)
        # rows of n words or more: every window that stays inside the row
        inside = np.cumsum(take[:-1]) > 0
        place = np.repeat(long, sizes)
        out[place] = acc[inside]
    for row in np.flatnonzero((count > 0) & ~long):
        h = np.array([count[row]], np.uint64)
        for w in hashes[first[row] : first[row + 1]]:
            h = mix64(h * np.uint64(_P) + w)
        out[off[row]] = h[0]
    return out, off


def distinct_shingles(column: pa.Array, n: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes after lower-casing A-Z."""
    data, off = utf8(column)
    data = lower_ascii(data)
    starts, ends, first = words(data, off)
    all_, at = shingles(span_hashes(data, starts, ends), first, n)
    return [np.unique(all_[a:b]) for a, b in zip(at[:-1], at[1:])]


def long_lists(rows: list[np.ndarray]) -> pa.ListArray:
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64)))
