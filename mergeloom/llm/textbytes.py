"""Whole Arrow columns of text as one byte array, for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is worked on alone.
CHUNK_BYTES = 2 << 20


def blocks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about ``most`` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, bytes_[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) of the maximal runs of True that don't cross a text's border; bounds: per text, its first run."""
    n = len(inside)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    border = offsets[:-1][offsets[:-1] < n]
    begins[border] = inside[border]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:-1] - 1
    last = last[last >= 0]
    ends[last] = inside[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def weights(n: int, seed: int) -> np.ndarray:
    """The first n members of a fixed random sequence of odd 64-bit numbers."""
    step, start = 0x9E3779B97F4A7C15, (seed * 0xD1B54A32D192ED03) & (2**64 - 1)
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(step) + np.uint64(start)) | np.uint64(1)


def hash_runs(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of the byte runs [start, stop); equal runs get equal hashes everywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = stops - starts
    first = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(first, sizes)
    table = weights(int(sizes.max()), seed)
    values = data[within + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)
    values *= table[within]
    return mix(np.add.reduceat(values, first) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
