"""Exchanges of (hash, document) entries as few large rows: each task packs what it sends to a bin into one binary value.

Where a hash is common, a task answers what it can itself and sends one entry for it, so no bin gets more entries of one hash
than there are batches. The number of bins follows from the bytes of the texts. A partition has many bins if there are more of them than
partitions; Spark sorts it by bin, spilling to disk, and a task holds one bin's entries at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latewing.llm.flat import mix

ASKED, KNOWN = 0, 1
NO_KEY = -(1 << 63)         # stands for a null key, which is smaller than all others
SCHEMA = "part int, kind tinyint, body binary"
HELD_BYTES = 32 << 20
BIN_BYTES = 64 << 20        # of entries, if every word of the texts were asked for


def partitions(df: DataFrame) -> int:
    """As many partitions as the session's shuffles have."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bins(rows: DataFrame) -> int:
    """As many bins as the texts t of ``rows`` need: 16 bytes an entry, and a word of five letters and its blank for each."""
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    return max(partitions(rows), -(-size * 16 // 6 // BIN_BYTES))


def numbered(docs: DataFrame, text: str, key: str) -> DataFrame:
    """The integer key as a long d without null, and the text t without null; nothing else, so that all uses share an exchange."""
    return docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def named(df: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The key as it was in ``docs`` instead of d."""
    old = F.when(F.col("d") != NO_KEY, F.col("d")).cast(docs.schema[key].dataType).alias(key)
    return df.select(old, *[c for c in df.columns if c != "d"])


def distinct_pairs(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))[:len(h)]
    return h[new], d[new]


def groups(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs sorted by (hash, document): first row of each hash, and each row's group's smallest and largest document."""
    if not len(h):
        return np.zeros(0, np.int64), d, d
    new = np.append(True, h[1:] != h[:-1])
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    last = np.append(begin[1:], len(h)) - 1
    return begin, d[begin][group], d[last][group]


class Sender:
    """Collects entries and gives them out as record batches of SCHEMA, in pieces of bounded size."""

    def __init__(self, bins: int):
        self.bins, self.held, self.size = bins, [], 0

    def put(self, kind: int, h: np.ndarray, d: np.ndarray) -> None:
        if len(h):
            self.held.append((kind, h, d))
            self.size += 16 * len(h)

    def take(self, everything: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.held or not everything and self.size < HELD_BYTES:
            return
        parts, kinds, bodies = [], [], []
        for kind in (ASKED, KNOWN):
            some = [x for x in self.held if x[0] == kind]
            if not some:
                continue
            h, d = (np.concatenate([x[k] for x in some]) for k in (1, 2))
            to = (mix(d.view(np.uint64) if kind == KNOWN else h) % np.uint64(self.bins)).astype(np.int64)
            order = np.lexsort((d, to))
            h, d, to = h[order], d[order], to[order]
            cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            for i, j in zip(cut, np.append(cut[1:], len(to))):
                parts.append(int(to[i]))
                kinds.append(kind)
                bodies.append(h[i:j].tobytes() + d[i:j].tobytes())
        self.held, self.size = [], 0
        yield pa.record_batch([pa.array(parts, pa.int32()), pa.array(kinds, pa.int8()), pa.array(bodies, pa.binary())], ["part", "kind", "body"])


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """(kind, hashes, documents) of the rows of a partition that is sorted by bin, bin by bin."""
    def entries() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for b in batches:
            for i in range(len(b)):
                part, kind, body = (b.column(c)[i].as_py() for c in range(3))
                both = np.frombuffer(body, np.uint64)
                yield part, kind, both[:len(both) // 2], both[len(both) // 2:].view(np.int64)

    for _, same in groupby(entries(), key=lambda x: x[0]):
        yield (x[1:] for x in same)


def answer(sent: DataFrame, chosen: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], bins: int) -> DataFrame:
    """(d, hashes): for each document all its hashes that are known or chosen.

    ``chosen`` gets the documents of the pairs that meet under a hash, and the smallest and largest document of that hash.
    ``sent`` comes from senders with ``bins`` bins.
    """
    parts = partitions(sent)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(bins)
        for same in _bins(batches):
            held = []
            for kind, h, d in same:
                if kind == KNOWN:
                    out.put(KNOWN, h, d)
                    yield from out.take()
                else:
                    held.append((h, d))
            if held:
                h, d = distinct_pairs(*(np.concatenate(x) for x in zip(*held)))
                held.clear()
                _, low, high = groups(h, d)
                yes = chosen(d, low, high)
                out.put(KNOWN, h[yes], d[yes])
                yield from out.take()
        yield from out.take(True)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for same in _bins(batches):
            held = [(d, h) for _, h, d in same]
            d, h = distinct_pairs(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            begin = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            end = np.append(begin[1:], len(d))
            for i in range(0, len(begin), 4096):
                yield pa.record_batch([pa.array(d[begin[i:i + 4096]]), pa.array(
                    [h[a:b].tobytes() for a, b in zip(begin[i:i + 4096], end[i:i + 4096])], pa.binary())], ["d", "hashes"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartitionById(parts, F.col("part") % parts).sortWithinPartitions("part")

    return dealt(dealt(sent).mapInArrow(meet, SCHEMA)).mapInArrow(collect, "d bigint, hashes binary")


def member(hashes: np.ndarray, row: np.ndarray, bodies: pa.Array) -> np.ndarray:
    """Whether each hash is among its row's: bodies[row] as uint64 values."""
    sets = [np.frombuffer(x, np.uint64) if x else np.zeros(0, np.uint64) for x in bodies.to_pylist()]
    if not any(map(len, sets)):
        return np.zeros(len(hashes), bool)
    salt = mix(np.arange(1, len(sets) + 1, dtype=np.uint64))
    known = np.sort(np.concatenate([s ^ k for s, k in zip(sets, salt)]))
    wanted = hashes ^ salt[row]
    return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted
