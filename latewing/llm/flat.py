"""Texts of an Arrow batch as one flat byte array, and vector operations on it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

MULTIPLIER = 0x9E3779B97F4A7C15                       # odd, so it has an inverse modulo 2^64
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: What a byte counts for in polynomial hashes.
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each have at most ``limit`` bytes, or are one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(size), 0
        while start < len(size):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross rows: starts, ends (exclusive), and each row's first run."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of MULTIPLIER and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((MULTIPLIER, INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose low and high bits depend on all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * MULTIPLIER^i, with a 0 in front."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of the sequences values[s:e]; starts and ends must not fall. Works on a block of values at a time."""
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + block, "right")))
        part = values[base:int(ends[j - 1])]
        if part.dtype == np.uint8:
            part = BYTE_VALUES[part]
        s = sums(part)
        lo, hi = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((s[hi] - s[lo]) * powers(len(part) + 1)[1][lo] + (hi - lo).astype(np.uint64))
        i = j
    return out


def window_hashes(values: np.ndarray, width: int, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of all windows of ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(0, n, block):
        j = min(n, i + block)
        part = values[i:j + width - 1]
        if part.dtype == np.uint8:
            part = BYTE_VALUES[part]
        s = sums(part)
        out[i:j] = mix((s[width:] - s[:-width]) * powers(j - i)[1])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start + length - 1."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """The concatenated slices data[start : start + length]; indexes are made for a block of the result at a time."""
    ends = np.cumsum(lengths)
    out, i = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype), 0
    while i < len(lengths):
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + block, "right")))
        out[before:int(ends[j - 1])] = data[ranges(starts[i:j], lengths[i:j])]
        i = j
    return out


def covered(length: int, starts: np.ndarray, width) -> np.ndarray:
    """Mask of positions inside any of the intervals start .. start + width - 1."""
    step = np.zeros(length + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0




def with_key(rows: DataFrame, fields: str) -> T.StructType:
    """The type of ``rows``'s column k, whatever it is, and further fields."""
    return T.StructType([T.StructField("k", rows.schema["k"].dataType), *T.StructType.fromDDL(fields).fields])
