"""Substring dedup by difference-cover anchors.

Positions of a document count modulo a period; a difference cover of the period is a small set of residues such that any two
shifts of it meet. Short windows are hashed at cover positions only. Wherever two documents share a long window, they share a short one
that is aligned to the cover in both. So only windows around anchors that occur in several documents can repeat; each
such match is extended to full windows, and a window's hash meets those of all other documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latewing.llm.flat import SPACES, by_bytes, covered, flat, ranges, runs, span_hashes, window_hashes
from latewing.llm.meeting import ASKED, KNOWN, SCHEMA, Sender, answer, bins, distinct_pairs, groups, member, named, numbered

BATCH_BYTES = 4 << 20
PERIOD = 31
#: A perfect difference set: every non-zero residue modulo 31 is the difference of exactly one pair.
PERFECT_31 = (0, 1, 3, 8, 12, 18)


def difference_cover(period: int) -> np.ndarray:
    """Residues whose pairwise differences are all residues."""
    if period == 31:
        return np.array(PERFECT_31)
    step = isqrt(max(0, period - 1)) + 1
    return np.array(sorted({*range(min(step, period)), *range(0, period, step)}))


class _Words:
    """Words of a batch: hashes, and each row's first word."""

    def __init__(self, column: pa.Array):
        data, offsets = flat(column)
        starts, ends, self.bounds = runs(~SPACES[data], offsets)
        self.hashes = span_hashes(data, starts, ends)
        self.count = np.diff(self.bounds)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first word and row of every window inside a row."""
        number = np.maximum(self.count - width + 1, 0)
        at = ranges(self.bounds[:-1], number)
        return window_hashes(self.hashes, width)[at], at, np.repeat(np.arange(len(number)), number)


def _ask(out: Sender, h: np.ndarray, d: np.ndarray, smaller_only: bool) -> None:
    """What a batch knows of its own hashes it tells at once; of each hash it asks about one document."""
    h, d = distinct_pairs(h, d)
    begin, low, high = groups(h, d)
    known = d > low if smaller_only else low < high
    out.put(KNOWN, h[known], d[known])
    out.put(ASKED, h[begin], d[begin])


def repeated_windows(docs: DataFrame, window: int = 50, period: int = PERIOD, text: str = "text", key: str = "doc_id",
                     batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The rows of ``docs`` as (d, t) with ``hashes``: those windows of the row that also start in a smaller document."""
    period = min(period, window)
    short, cover = window - period + 1, difference_cover(period)
    in_cover = np.isin(np.arange(period), cover)
    rows = numbered(docs, text, key)
    number = bins(rows)

    def anchors(words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, at, row = words.windows(short)
        keep = in_cover[(at - words.bounds[row]) % period]
        return h[keep], at[keep], row[keep]

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(number)
        for b in by_bytes(batches, "t", batch_bytes):
            d = b.column("d").to_numpy(zero_copy_only=False)
            h, _, row = anchors(_Words(b.column("t")))
            _ask(out, h, d[row], False)
            yield from out.take()
        yield from out.take(True)

    def ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(number)
        for b in by_bytes(batches, "t", batch_bytes):
            d = b.column("d").to_numpy(zero_copy_only=False)
            words = _Words(b.column("t"))
            h, at, row = anchors(words)
            shared = at[member(h, row, b.column("hashes"))]
            h, at, row = words.windows(window)
            # Windows that hold a shared anchor begin up to period - 1 words before it.
            first = np.maximum(shared - (period - 1), 0)
            near = covered(len(words.hashes) + period, first, shared - first + 1)[at]
            _ask(out, h[near], d[row[near]], True)
            yield from out.take()
        yield from out.take(True)

    shared = answer(rows.select("d", "t").mapInArrow(ask_anchors, SCHEMA), lambda d, low, high: low < high, number)
    placed = rows.repartition("d")  # read twice, exchanged once
    found = answer(placed.join(shared, "d").select("d", "t", "hashes").mapInArrow(ask_windows, SCHEMA), lambda d, low, high: d > low, number)
    return placed.join(found, "d", "left")


def remove_repeats(docs: DataFrame, window: int = 50, period: int = PERIOD, text: str = "text", key: str = "doc_id",
                   batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs``: key (an integer), n_words, n_removed, kept (the words that stay, joined by one space), kept_sha256.

    A word goes if a window of ``window`` consecutive words covers it that also starts in a document with a smaller key. Null texts
    have no words. A null key counts as smaller than all others; rows with one key are one document. Texts of fewer words
    than a window stay. Other columns are left out.
    """
    rows = repeated_windows(docs, window, period, text, key, batch_bytes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "t", batch_bytes):
            n, kept, removed = [], [], np.zeros(len(b), np.int64)
            touched = np.flatnonzero(b.column("hashes").is_valid().to_numpy(zero_copy_only=False))
            gone: dict[int, np.ndarray] = {}
            if len(touched):
                some = b.take(pa.array(touched))
                words = _Words(some.column("t"))
                h, at, row = words.windows(window)
                mask = covered(len(words.hashes), at[member(h, row, some.column("hashes"))], window)
                gone = {int(i): mask[x:y] for i, x, y in zip(touched, words.bounds[:-1], words.bounds[1:])}
            data, offsets = flat(b.column("t"))
            raw = data.tobytes()
            for i in range(len(b)):
                words = raw[offsets[i]:offsets[i + 1]].split()
                n.append(len(words))
                if i in gone and gone[i].any():
                    removed[i] = gone[i].sum()
                    words = [w for w, x in zip(words, gone[i].tolist()) if not x]
                kept.append(b" ".join(words))
            yield pa.record_batch([b.column("d"), pa.array(n, pa.int64()), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(
                [hashlib.sha256(x).hexdigest() for x in kept], pa.string())], ["d", "n_words", "n_removed", "kept", "kept_sha256"])

    out = rows.select("d", "t", "hashes").mapInArrow(
        cut, "d bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")
    return named(out, docs, key)
