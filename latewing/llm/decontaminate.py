"""Benchmark decontamination with one FM-index per training shard.

A shard is a bounded batch of documents. Its words are mapped to the benchmark's vocabulary; every other word is a separator, and
so is every document's end. Over the suffix array of this sequence stands the Burrows-Wheeler transform in a wavelet
matrix: all test phrases are searched backwards at once through its ranks, occurrences are located by walking to sampled suffix
positions, and their spans are merged per document. No window crosses a word outside the vocabulary, so nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latewing.llm.flat import by_bytes, covered, flat, ranges, runs, span_hashes, with_key
from latewing.session import cut_lineage

SHARD_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20      # of phrases and item ids searched at a time
BATCH_BYTES = 1 << 20       # of benchmark text
WINDOWS_TOGETHER = 1 << 14
ITEMS_TOGETHER = 1_000
SAMPLE = 8                  # one suffix position in so many is kept

WORD = np.ones(256, bool)
WORD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def suffix_array(first: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a sequence of ranks, by doubling; only unsettled groups are sorted again."""
    n = len(first)
    order = np.argsort(first, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.append(True, first[order][1:] != first[order][:-1])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 1
    while True:
        alone = new & np.append(new[1:], True)
        open_rows = np.flatnonzero(~alone)
        if not len(open_rows):
            return order
        at = order[open_rows]
        key = rank[at] * (n + 1) + rank[np.minimum(at + h, n)] + 1
        by = np.argsort(key, kind="stable")
        order[open_rows] = at = at[by]
        key = key[by]
        new[open_rows] = np.append(True, key[1:] != key[:-1])
        rank[order[open_rows]] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[open_rows]
        h *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, level by level from the highest bit."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        s = sequence
        for level in reversed(range(bits)):
            bit = (s >> level & 1).astype(bool)
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[~bit], s[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        begin = np.zeros_like(at)
        for k in range(self.bits):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self.ones[k][at], self.ones[k][begin]
            at = np.where(one, self.zeros[k] + a, at - a)
            begin = np.where(one, self.zeros[k] + b, begin - b)
        return at - begin


class ShardIndex:
    """FM-index of a sequence of symbols; 0 separates, and phrases hold no 0."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(text)
        apart = text == 0
        # Separators are distinct and in text order, so no two suffixes are equal beyond one.
        first = np.where(apart, np.cumsum(apart) - 1, int(apart.sum()) + text.astype(np.int64))
        order = suffix_array(first)
        self.n, self.bwt = n, text[order - 1]              # the text is taken as a ring; it ends with a separator
        self.before = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.before[1:])
        self.ranks = WaveletMatrix(self.bwt, max(1, int(sigma - 1).bit_length()))
        kept = (order % sample == 0) | (self.bwt == 0)     # the walk never crosses a separator
        self.kept = np.zeros(n + 1, np.int64)
        np.cumsum(kept, out=self.kept[1:])
        self.sampled, self.position = kept, order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix array that begin with each phrase; phrases stand at the right end of their rows."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1]):
            live = live[(lengths[live] > k) & (lo[live] < hi[live])]
            c = phrases[live, phrases.shape[1] - 1 - k]
            lo[live] = self.before[c] + self.ranks.rank(c, lo[live])
            hi[live] = self.before[c] + self.ranks.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows."""
        out, steps = np.empty(len(rows), np.int64), 0
        at, row = np.arange(len(rows)), rows
        while len(row):
            known = self.sampled[row]
            out[at[known]] = self.position[self.kept[row[known]]] + steps
            at, row = at[~known], row[~known]
            c = self.bwt[row]
            row = self.before[c] + self.ranks.rank(c, row)
            steps += 1
        return out


def phrase_table(benchmark: DataFrame, window: int, item: str, text: str) -> DataFrame:
    """The distinct windows of all items, p (the hashes of its words), with the ids of the items that hold it.

    A window that very many items hold has several rows, of about ITEMS_TOGETHER ids each.
    """
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "t", BATCH_BYTES):
            data, offsets = flat(b.column("t"))
            data = LOWER[data]
            starts, ends, bounds = runs(WORD[data], offsets)
            hashes = span_hashes(data, starts, ends)
            for i, x, y in zip(b.column("i").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                last = max(x, y - window)
                for begin in range(x, last + 1 if y > x else x, WINDOWS_TOGETHER):
                    some = {hashes[k:min(k + window, y)].tobytes() for k in range(begin, min(begin + WINDOWS_TOGETHER, last + 1))}
                    yield pa.record_batch([pa.array([i] * len(some), pa.string()), pa.array(sorted(some), pa.binary())], ["i", "p"])

    items = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    seen = items.mapInArrow(windows, "i string, p binary").distinct()
    many = seen.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / ITEMS_TOGETHER).alias("n"))
    dealt = seen.join(many, "p").withColumn("c", F.pmod(F.xxhash64("i"), "n"))
    return dealt.groupBy("p", "c").agg(F.collect_list("i").alias("items")).select("p", "items")


class Phrases:
    """A block of test phrases, as symbols of their vocabulary."""

    def __init__(self, bodies: list[bytes], items: list[list[str]]):
        self.items = items
        self.lengths = np.fromiter((len(x) // 8 for x in bodies), np.int64, len(bodies))
        self.vocabulary, symbol = np.unique(np.frombuffer(b"".join(bodies), np.uint64), return_inverse=True)
        self.sigma, width = len(self.vocabulary) + 1, int(self.lengths.max(initial=0))
        self.phrases = np.zeros((len(bodies), width), np.int64)
        row = np.repeat(np.arange(len(bodies)), self.lengths)
        self.phrases[row, ranges(width - self.lengths, self.lengths)] = symbol.astype(np.int64) + 1
        self.shortest = int(self.lengths.min(initial=width))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for those that the benchmark lacks."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def occurrences(self, symbol: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every occurrence in a shard whose documents' words begin at ``bounds``."""
        none = np.zeros(0, np.int64)
        starts, ends, _ = runs(symbol > 0, bounds)
        keep = ends - starts >= max(1, self.shortest)
        starts, ends = starts[keep], ends[keep]
        if not len(starts) or not len(self.phrases):
            return none, none
        length = ends - starts + 1                         # with a separator behind each run
        place = ranges(starts, length)
        text = symbol[np.minimum(place, len(symbol) - 1)]
        text[np.cumsum(length) - 1] = 0
        index = ShardIndex(text, self.sigma)
        lo, hi = index.search(self.phrases, self.lengths)
        found = index.locate(ranges(lo, hi - lo))
        return place[found], np.repeat(np.arange(len(lo)), hi - lo)


def _block(phrases: DataFrame, number: int, of: int) -> Phrases:
    """One of ``of`` parts of the written phrases, about BLOCK_BYTES: the only one that the driver holds."""
    got = phrases.where(F.pmod(F.xxhash64("p"), F.lit(of)) == number).toArrow()
    return Phrases(got.column("p").to_pylist(), got.column("items").to_pylist())


def _hits(docs: DataFrame, phrases: Phrases, shard_bytes: int) -> DataFrame:
    """k, n_words, merged spans of hit words, and the ids of the items found, for each row of (k, t)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "t", shard_bytes):
            data, offsets = flat(b.column(1))
            data = LOWER[data]
            starts, ends, bounds = runs(WORD[data], offsets)
            first, phrase = phrases.occurrences(phrases.symbols(span_hashes(data, starts, ends)), bounds)
            hit = covered(len(starts), first, phrases.lengths[phrase])
            s, e, doc = runs(hit, bounds)
            owner = np.searchsorted(bounds, first, "right") - 1
            items: list[set] = [set() for _ in range(len(b))]
            for d, p in set(zip(owner.tolist(), phrase.tolist())):
                items[d].update(phrases.items[p])
            base = np.repeat(bounds[:-1], np.diff(doc))
            spans = pa.ListArray.from_arrays(pa.array(doc.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(s - base), pa.array(e - base)], ["start", "end"]))
            yield pa.record_batch([b.column(0), pa.array(np.diff(bounds)), spans, pa.array(
                [sorted(x) for x in items], pa.list_(pa.string()))], ["k", "n_words", "spans", "items"])

    return docs.mapInArrow(
        work, with_key(docs, "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"))


def _merged(found: DataFrame) -> DataFrame:
    """(k, spans, items) with the spans of each row in order, those that overlap or touch as one."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column("spans")
            s, e = (np.asarray(x) for x in spans.flatten().flatten())
            row = np.repeat(np.arange(len(b)), np.diff(np.asarray(spans.offsets)))
            order = np.lexsort((s, row))
            # Rows are moved apart, so that one running maximum of ends serves all.
            far = (e.max(initial=0) + 2) * row[order]
            s, e, row = s[order] + far, np.maximum.accumulate(e[order] + far), row[order]
            new = np.flatnonzero(np.append(True, s[1:] > e[:-1])[:len(s)])
            last = np.append(new[1:], len(s))[:len(new)] - 1
            count = np.bincount(row[new], minlength=len(b))
            merged = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.StructArray.from_arrays(
                [pa.array(s[new] - far[new]), pa.array(e[last] - far[new])], ["start", "end"]))
            yield pa.record_batch([b.column("k"), merged, b.column("items")], ["k", "spans", "items"])

    return found.mapInArrow(work, with_key(found, "spans array<struct<start:bigint,end:bigint>>, items array<string>"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, text: str = "text", key: str = "doc_id",
    item: str = "item_id", item_text: str = "text", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, spans (merged, in words), items (sorted as strings), contaminated.

    A window is ``window`` consecutive words of an item, or all words of a shorter item. A document is contaminated if at
    least one word in ``share`` is hit. Null texts have no words; a null item_id counts as the id "null"; items without words and
    an empty benchmark hit nothing. Repeated rows stay; other columns are left out. The benchmark's phrases are made and written by
    Spark; those beyond ``block_bytes`` are searched block by block, and a block's hits are written before the next is read.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    phrases = cut_lineage(phrase_table(benchmark, window, item, item_text), "phrases")
    size = F.length("p") + F.aggregate("items", F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x))
    number = -(-(phrases.agg(F.sum(size)).first()[0] or 0) // block_bytes)
    if number <= 1:
        out = _hits(rows, _block(phrases, 0, 1), shard_bytes)
    else:
        # Rows are told apart by key and text; equal rows have equal hits. Only rows with hits are written and exchanged.
        inner = rows.select(F.struct("k", F.xxhash64("t").alias("h")).alias("k"), "t")
        parts = [cut_lineage(_hits(inner, _block(phrases, i, number), shard_bytes).where(F.size("spans") > 0).distinct(), "hits")
                 for i in range(number)]
        found = reduce(DataFrame.unionByName, parts).groupBy("k").agg(
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        every = _hits(inner, Phrases([], []), shard_bytes).select("k", "n_words")
        joined = every.alias("a").join(_merged(found).alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")), "left")
        out = joined.select(F.col("a.k.k").alias("k"), "n_words", *[
            F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c) for c in ("spans", "items")])
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return out.select(F.col("k").alias(key), "n_words", n_hit.alias("n_hit"), "spans", "items").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
