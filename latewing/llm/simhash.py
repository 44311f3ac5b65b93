"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint's 64 bits lie in five segments on a ring. If two fingerprints differ in at most 4 bits, then from some segment on
every chain of consecutive segments stays within its share of that budget: a chain of L segments differs in at most
floor(4 L / 5) bits. So that first segment is equal and the first two differ in at most one bit. Candidates meet under the
bits of two consecutive segments, one side as it is, the other with one bit of the second segment turned at most; longer chains prune
them, then the full distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from latewing.llm.flat import by_bytes, flat, ranges, with_key
from latewing.llm.graph import components
from latewing.llm.meeting import partitions
from latewing.session import cut_lineage

BITS, BUDGET, SEGMENTS = 64, 4, 5
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
BATCH_BYTES = 4 << 20
BLOCK = 4096                # fingerprints of one key held at a time


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and fp (the 64-bit fingerprint as a signed long) for each row; null texts and texts without words have fp 0."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "t", BATCH_BYTES):
            data, offsets = flat(b.column("t"))
            raw = data.tobytes().lower()
            fps = [fingerprint(raw[i:j], shingle, seed) for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch([b.column("k"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["k", "fp"])

    return rows.mapInArrow(work, with_key(rows, "fp bigint")).withColumnRenamed("k", key)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42, block: int = 1 << 16) -> int:
    """The fingerprint of a lower-cased text: a bit is set if over half of the shingles' XXH64 values have it."""
    words = text.split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])[:n].tolist()
    stops = (ends - 1)[min(shingle, len(words)) - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, block):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i:i + block], stops[i:i + block])], np.uint64)
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _ring(fp: np.ndarray, first: int) -> np.ndarray:
    """Fingerprints turned so that segment ``first`` holds the lowest bits."""
    by = np.uint64(STARTS[first])
    return fp if first == 0 else fp >> by | fp << (np.uint64(BITS) - by)


def _chains(first: int) -> list[tuple[np.uint64, int]]:
    """Masks of the chains that begin at a segment, once it stands lowest, with the bits in which each may differ."""
    out, bits = [], 0
    for n in range(1, SEGMENTS + 1):
        bits += WIDTHS[(first + n - 1) % SEGMENTS]
        out.append((np.uint64((1 << bits) - 1), BUDGET * n // SEGMENTS))
    return out


def probes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, fingerprint, and whether a bit of it is turned, for all places where a fingerprint is filed or looked for."""
    keys, owners, turned = [], [], []
    for s in range(SEGMENTS):
        width, low = WIDTHS[s] + WIDTHS[(s + 1) % SEGMENTS], WIDTHS[s]
        own = _ring(fp, s) & np.uint64((1 << width) - 1)
        for bit in [None, *range(low, width)]:
            flip = np.uint64(0 if bit is None else 1 << bit)
            keys.append((own ^ flip) | np.uint64(s << 32))
            owners.append(fp)
            turned.append(np.full(len(fp), bit is not None))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(turned)


def near(a: np.ndarray, b: np.ndarray, segment: np.ndarray | int) -> np.ndarray:
    """Whether pairs pass every chain from their segment on; the last chain is the full distance."""
    segment = np.broadcast_to(segment, a.shape)
    ok = np.zeros(a.shape, bool)
    for s in np.unique(segment):
        at = np.flatnonzero(segment.ravel() == s)
        differ = _ring((a ^ b).ravel()[at], int(s))
        good = np.ones(len(at), bool)
        for mask, most in _chains(int(s)):
            good[good] = np.bitwise_count(differ[good] & mask) <= most
        ok.ravel()[at] = good
    return ok


def _small_groups(key, fp, turned, begin, size, filed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among many short groups: every filed fingerprint against the group's rows, in bounded slices."""
    work = filed * size
    cut = np.append(0, np.cumsum(work))
    at = 0
    while at < len(begin):
        stop = max(at + 1, int(np.searchsorted(cut, cut[at] + (1 << 20), "right")) - 1)
        g = slice(at, stop)
        left = np.repeat(ranges(begin[g], filed[g]), np.repeat(size[g], filed[g]))
        right = ranges(np.repeat(begin[g], filed[g]), np.repeat(size[g], filed[g]))
        keep = fp[left] != fp[right]
        left, right = left[keep], right[keep]
        good = near(fp[left], fp[right], (key[left] >> np.uint64(32)).astype(np.int64))
        yield fp[left[good]], fp[right[good]]
        at = stop


def _large_group(segment: int, filed: np.ndarray, rows: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what a long group's links connect, at most one or two for each row.

    Rows are compared with all filed fingerprints in blocks; a filed fingerprint keeps the smallest label it is connected to, and
    only links to labels, and between labels that meet, leave. No pair is left out of the comparison.
    """
    label = np.arange(len(filed))
    out_a, out_b = [], []
    for i in range(0, len(rows), block):
        some = rows[i:i + block]
        close = near(np.broadcast_to(some[:, None], (len(some), len(filed))), np.broadcast_to(filed, (len(some), len(filed))), segment)
        some, close = some[close.any(1)], close[close.any(1)]
        while len(some):
            low = np.where(close, label, len(filed)).min(1)
            new = np.minimum(label, np.where(close, low[:, None], len(filed)).min(0))
            changed = np.flatnonzero(new != label)
            if not len(changed):
                out_a.append(some)
                out_b.append(filed[low])
                break
            # What was known under the old label is now linked to the new one.
            out_a.append(filed[label[changed]])
            out_b.append(filed[new[changed]])
            label = new
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (filed[:0], filed[:0])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (key, block, turned, fp) sorted so; a long group's rows pass in pieces, its filed part is bounded."""
    def whole_groups():
        rest = None
        for b in batches:
            if not len(b):
                continue
            part = [np.asarray(b.column(c).to_numpy(zero_copy_only=False)) for c in ("key", "block", "turned", "fp")]
            part = part if rest is None else [np.concatenate(x) for x in zip(rest, part)]
            same = (part[0] == part[0][-1]) & (part[1] == part[1][-1])
            last = int(np.argmax(same))
            if last:
                yield [x[:last] for x in part]
            rest = [x[last:] for x in part]
        if rest is not None:
            yield rest

    for key, block, turned, fp in whole_groups():
        fp, key, turned = fp.view(np.uint64), key.view(np.uint64), turned.astype(bool)
        begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
        size = np.diff(np.append(begin, len(key)))
        filed = np.add.reduceat((~turned).astype(np.int64), begin)
        useful = (size > 1) & (filed > 0)
        short = useful & (filed * size <= 1 << 12)
        found = list(_small_groups(key, fp, turned, begin[short], size[short], filed[short]))
        for g in np.flatnonzero(useful & ~short):
            i, j, n = int(begin[g]), int(begin[g] + size[g]), int(filed[g])
            found.append(_large_group(int(key[i] >> np.uint64(32)), fp[i:i + n], fp[i:j]))
        for a, b in found:
            keep = a != b
            lo, hi = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
            if len(lo):
                pairs = np.unique(np.stack([lo, hi], 1), axis=0).view(np.int64)
                yield pa.record_batch([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints connected by pairs of at most BUDGET differing bits.

    A key under which more than ``block`` fingerprints are filed is split: each block of them is met by all rows of the key.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 4096):
                key, owner, turned = probes(fp[i:i + 4096])
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(owner.view(np.int64)), pa.array(turned)], ["key", "fp", "turned"])

    def file_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            key, _, turned = probes(fp)
            yield pa.record_batch([pa.array(key[~turned].view(np.int64))], ["key"])

    # Each fingerprint makes many rows: as many tasks as the shuffle has partitions, however few bytes go in.
    distinct = distinct.repartition(partitions(distinct), "fp")
    rows = distinct.mapInArrow(spread, "key bigint, fp bigint, turned boolean")
    hot = cut_lineage(distinct.mapInArrow(file_only, "key bigint").groupBy("key").count().where(F.col("count") > block).select(
        "key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot")
    if hot.isEmpty():
        rows = rows.withColumn("block", F.lit(0))
    else:
        blocks = F.coalesce("blocks", F.lit(1))
        rows = rows.join(hot, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn(
            # In its own block a fingerprint is filed; in the others it is a row that looks for partners.
            "turned", F.col("turned") | (F.pmod(F.xxhash64("fp"), blocks) != F.col("block"))).drop("blocks")
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "turned", "fp")
    return rows.select("key", "block", "turned", "fp").mapInArrow(_links, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, fp, root (the same for all rows of a group) and component_id, the group's smallest key.

    Equal fingerprints link, so texts without words form one group. Null texts count as empty. A null key is kept and never
    is a group's smallest unless all are null. Repeated rows stay; other columns are left out.
    """
    own = cut_lineage(fingerprints(docs, text=text, key=key).select(F.col(key).alias("k"), "fp"), "fingerprints")
    first = own.groupBy("fp").agg(F.min("k").alias("k"))
    roots = cut_lineage(components(links(first.select("fp"))).select(F.col("node").alias("fp"), "root"), "roots")
    lowest = first.join(roots, "fp").groupBy("root").agg(F.min("k").alias("component_id"))
    moved = roots.join(lowest, "root").select("fp", "root", "component_id")
    groups = first.join(moved, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "k").alias("component_id"))
    return own.join(groups, "fp").select(F.col("k").alias(key), "fp", "root", "component_id")
