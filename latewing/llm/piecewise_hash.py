"""Context-triggered piecewise hashing of documents.

A hash rolls over seven bytes; where its lowest bits are zero a chunk ends, so chunk borders depend on nearby bytes only. Each chunk
gives one character. A fingerprint holds the level (the number of zero bits, chosen so that at most 64 chunks remain) and
the signatures at this level and the next. Two fingerprints are compared by edit distance at a level that both have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latewing.llm.flat import by_bytes, flat, ranges, span_hashes, window_hashes, with_key
from latewing.llm.meeting import partitions

CONTEXT = 7
LOWEST = 2                  # level of the shortest chunks, four bytes on average
LONGEST = 64                # characters of a signature
BATCH_BYTES = 4 << 20
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _signatures(data, offsets, place, zeros, row, level) -> list[str]:
    ends = place[zeros >= level[row]] + CONTEXT
    border = np.unique(np.concatenate([offsets, ends]))
    start, end = border[:-1], border[1:]
    letters = ALPHABET[(span_hashes(data, start, end) >> np.uint64(58)).astype(np.int64)].tobytes().decode()
    cut = np.searchsorted(start, offsets)
    return [letters[i:j] for i, j in zip(cut[:-1], cut[1:])]


def fingerprints(texts: pa.Array) -> list[str]:
    """``level:signature:signature at the next level`` for each text; an empty text has empty signatures."""
    data, offsets = flat(texts)
    number = np.maximum(np.diff(offsets) - CONTEXT + 1, 0)
    h = window_hashes(data, CONTEXT)
    zeros = np.bitwise_count((h & (~h + np.uint64(1))) - np.uint64(1)).astype(np.int8)
    place = ranges(offsets[:-1], number)
    row = np.repeat(np.arange(len(number), dtype=np.int32), number)
    keep = zeros[place] >= LOWEST
    place, row = place[keep], row[keep]
    zeros = zeros[place]
    ends = np.bincount(row * np.int64(65) + zeros, minlength=65 * len(number)).reshape(-1, 65)
    left = ends[:, ::-1].cumsum(axis=1)[:, ::-1]            # chunk ends at each level
    level = np.maximum(LOWEST, (left >= LONGEST).sum(axis=1))
    one = _signatures(data, offsets, place, zeros, row, level)
    two = _signatures(data, offsets, place, zeros, row, level + 1)
    return [f"{k}:{a}:{b}" for k, a, b in zip(level.tolist(), one, two)]


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs of ASCII strings of at most 64 characters, all pairs at once, 64 columns in a word."""
    n = len(a)
    la, lb = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    letters = lambda x: np.frombuffer("".join(x).encode(), np.uint8).astype(np.int64)
    one = np.uint64(1)
    places = np.zeros((n, 128), np.uint64)                  # where each letter stands in a
    row = np.repeat(np.arange(n), la)
    np.bitwise_or.at(places, (row, letters(a)), one << (np.arange(len(row)) - np.repeat(np.cumsum(la) - la, la)).astype(np.uint64))
    text = np.zeros((n, int(lb.max(initial=0))), np.int64)
    text[np.arange(text.shape[1]) < lb[:, None]] = letters(b)
    last = np.maximum(la - 1, 0).astype(np.uint64)
    up, down, score = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64), la.copy()
    for j in range(text.shape[1]):
        x = places[np.arange(n), text[:, j]] | down
        same = ((up + (x & up)) ^ up) | x
        less, more = up & same, down | ~(up | same)
        step = (more >> last & one).astype(np.int64) - (less >> last & one).astype(np.int64)
        score += np.where(j < lb, step, 0)
        more = more << one | one
        down, up = more & same, less << one | ~(more | same)
    return np.where(la == 0, lb, score)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """From 0 to 1 for pairs of fingerprints: 1 for equal ones, 0 where no level is common, else by the best edit distance."""
    out = np.array([float(x == y) for x, y in zip(a, b)])
    owner, left, right = [], [], []
    for i in np.flatnonzero(out == 0):
        (k, *s), (m, *t) = a[i].split(":"), b[i].split(":")
        k, m = int(k), int(m)
        for x in (0, 1):
            for y in (0, 1):
                if k + x == m + y and s[x] and t[y]:
                    owner.append(i)
                    left.append(s[x])
                    right.append(t[y])
    if owner:
        longest = np.array([max(len(x), len(y)) for x, y in zip(left, right)])
        np.maximum.at(out, owner, 1 - edit_distances(left, right) / longest)
    return out


def _placed(rows: DataFrame) -> DataFrame:
    """Rows in partitions by ranges of d, sorted inside; the first document of the next range follows each as a tail row.

    Range borders are documents' ids, so each border's row is also sent to the range before, and the first of all to the last.
    """
    parts = partitions(rows)
    found = rows.agg(F.min("d"), F.percentile_approx("d", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()
    first = found[0]
    borders = np.unique(np.array([x for x in found[1] or [] if x > first], np.int64))
    last = len(borders)

    @F.pandas_udf("struct<own:int,before:int>")
    def place(d: pd.Series) -> pd.DataFrame:
        d = d.to_numpy()
        own = np.searchsorted(borders, d, "right")
        at_border = np.isin(d, borders)
        before = np.where(at_border, own - 1, np.where(d == first, last, -1))
        return pd.DataFrame({"own": own.astype(np.int32), "before": before.astype(np.int32)})

    tail = lambda c, flag: F.struct(c.alias("part"), F.lit(flag).alias("tail"))
    sent = rows.withColumn("p", place("d")).withColumn("to", F.explode(F.when(
        F.col("p.before") < 0, F.array(tail(F.col("p.own"), False))).otherwise(
        F.array(tail(F.col("p.own"), False), tail(F.col("p.before"), True)))))
    return sent.select("k", "d", "t", "to.part", "to.tail").repartitionById(last + 1, "part").sortWithinPartitions("tail", "d", "t")


def compare_edits(docs: DataFrame, text: str = "text", key: str = "doc_id", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Fingerprints of each text and of an edited text, in which the last quarter gives way to the start of the next document.

    One row per row of ``docs``: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are empty.
    Rows are ordered by key (null first) and, for repeated keys, by text; after the last comes the first, which is also its own
    successor in a table of one row. Equal texts have equal fingerprints. Other columns are left out.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))).alias("d"),
                       F.coalesce(F.col(text), F.lit("")).alias("t"))
    names = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, prints, done = [], [], [], False       # of the row whose successor is still to come
        for b in by_bytes(batches, "t", batch_bytes):
            if done:
                continue
            own = int(np.count_nonzero(~b.column("tail").to_numpy(zero_copy_only=False)))
            b = b.slice(0, min(len(b), own + 1))            # of the tail rows only the first is a successor
            keys += b.column("k").slice(0, own).to_pylist()
            texts += b.column("t").to_pylist()
            prints += fingerprints(b.column("t"))
            if len(texts) < 2:
                continue
            cut = [len(t) // 4 for t in texts[:-1]]
            edited = [t[:len(t) - n] + after[:n] for t, after, n in zip(texts, texts[1:], cut)]
            changed = fingerprints(pa.array(edited, pa.large_string()))
            yield pa.record_batch([
                pa.array(keys[:len(edited)], b.schema.field("k").type), pa.array(list(map(len, texts[:-1])), pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), pa.array(prints[:-1], pa.string()),
                pa.array(changed, pa.string()), pa.array(likeness(prints[:-1], changed)), pa.array(likeness(prints[:-1], prints[1:]))], names)
            done = own < len(b)
            keys, texts, prints = keys[-1:], texts[-1:], prints[-1:]

    kinds = with_key(rows, "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                     "near_edited double, near_next double")
    if rows.limit(1).count() == 0:
        return rows.select("k").mapInArrow(lambda it: iter(()), kinds).withColumnRenamed("k", key)
    return _placed(rows).select("k", "t", "tail").mapInArrow(work, kinds).withColumnRenamed("k", key)
