"""Exact byte-level dedup from suffix order and common prefixes, built column by column over many reads.

Every window of a text has a minimizer: the leftmost of its smallest k-byte hashes. Neighbouring windows with one minimizer form a read.
Equal windows have equal minimizers at equal places, so only reads of one minimizer can share a window, and there they are
aligned. Reads that are equal as a whole repeat without further work. The different reads of a minimizer are sorted in the manner of
the multi-document construction of the Burrows-Wheeler transform: one round for each column, from right to left, inserts one
symbol of every read, which stably regroups the order of all suffixes and updates the common prefixes of neighbours. The
reads lie column-wise in a file that the rounds pass through once, in sequence. A window repeats if it shares its length with a
neighbour. As all suffixes of a round begin at the same column, order and prefixes of earlier rounds need not be kept.

A minimizer with very many reads (a border of a common passage, where each read holds its text's own context) is not sorted but dealt
out by content. The windows that begin in one block of columns share a core, and equal windows have equal cores: only where a block's
core also occurs in another read are its windows compared, each by its own hash. So no task holds all reads of a minimizer.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from latewing.llm.flat import by_bytes, covered, flat, mix, ranges, span_hashes, window_hashes
from latewing.llm.meeting import named, numbered
from latewing.session import cut_lineage

BATCH_BYTES = 4 << 20
SEGMENT_BYTES = 8 << 20     # of a long text looked at together; at most 2^24
SHARD_BYTES = 8 << 20       # of reads sorted together, besides the rest of the last minimizer's group
HOT_READS = 1 << 13         # a minimizer with more reads is not sorted but dealt out
GRAM = 32
LARGE_GROUP = 1 << 20       # rows of one minimizer that are decided together


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    pad[:len(x)] = x
    blocks = pad.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def reads(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Row, first byte in the row, length, place of the minimizer in the read, its hash and the read's hash, for all reads."""
    out = []
    number = np.diff(offsets)
    for lo in range(0, max(1, len(data)), SEGMENT_BYTES) if len(number) == 1 else [None]:
        if lo is None:
            part, begin, count, base = data, offsets[:-1], np.maximum(number - window + 1, 0), 0
        else:
            part, begin, base = data[lo:lo + SEGMENT_BYTES + window - 1], np.zeros(1, np.int64), lo
            count = np.array([max(0, len(part) - window + 1)])
        grams = window_hashes(part, gram)
        place = np.uint64((1 << 24) - 1)
        low = sliding_min(grams & ~place | np.arange(len(grams), dtype=np.uint64), window - gram + 1)
        start = ranges(begin, count)
        row = np.repeat(np.arange(len(begin)), count)
        anchor = (low[start] & place).astype(np.int64)
        first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))[:len(anchor)])
        s1 = start[first]
        end = start[np.append(first[1:], len(start))[:len(first)] - 1] + window
        out.append((row[first], s1 - begin[row[first]] + base, end - s1, anchor[first] - s1, grams[anchor[first]],
                    span_hashes(part, s1, end)))
    return [np.concatenate(x) for x in zip(*out)]


class Shard:
    """Reads of whole groups, kept in a file, and their repeated windows by column-wise construction."""

    def __init__(self, window: int, gram: int):
        self.window, self.left = window, window - gram      # the minimizer stands at column ``left``
        self.width = self.left + window
        self.file, self.groups, self.offs, self.lens = tempfile.TemporaryFile(), [], [], []
        self.n = 0

    def add(self, groups: np.ndarray, offs: np.ndarray, texts: pa.Array) -> None:
        data, offsets = flat(texts)
        size = np.diff(offsets)
        for i in range(0, len(size), 4096):
            some = slice(i, i + 4096)
            rows = np.zeros((len(size[some]), self.width), np.uint8)
            at = ranges(np.arange(len(rows)) * self.width + self.left - offs[some], size[some])
            rows.ravel()[at] = data[offsets[i]:offsets[i] + len(at)]
            self.file.write(rows.data)
        self.groups.append(groups)
        self.offs.append(offs)
        self.lens.append(size)
        self.n += len(size)

    def repeated(self) -> Iterator[tuple[int, np.ndarray]]:
        """(column, reads whose window there repeats), column by column from right to left."""
        group, off, size = (np.concatenate(x) for x in (self.groups, self.offs, self.lens))
        first = self.left - off                             # columns of each read
        last = first + size - 1
        with tempfile.TemporaryFile() as turned:
            columns = np.memmap(turned, np.uint8, "w+", shape=(self.width, self.n))
            self.file.seek(0)
            for i in range(0, self.n, 4096):
                rows = np.frombuffer(self.file.read(4096 * self.width), np.uint8).reshape(-1, self.width)
                columns[:, i:i + len(rows)] = rows[:, ::-1].T
            self.file.close()
            yield from self._rounds(columns, group, first, last)
            del columns

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Read, first and last column of the maximal runs of repeated windows, by read."""
        low, high = np.full(self.n, -1, np.int32), np.full(self.n, -1, np.int32)
        out = []
        for x, some in self.repeated():
            new = some[low[some] != x + 1]
            done = new[low[new] >= 0]
            out.append((done, low[done], high[done]))
            high[new] = x
            low[some] = x
        done = np.flatnonzero(low >= 0)
        out.append((done, low[done], high[done]))
        read, low, high = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((low, read))
        return read[order], low[order].astype(np.int64), high[order].astype(np.int64)

    def _rounds(self, columns, group, first, last) -> Iterator[tuple[int, np.ndarray]]:
        by_last, by_first = np.argsort(-last, kind="stable"), np.argsort(-first, kind="stable")
        in_at, out_at = 0, 0
        ends, begins = -last[by_last], -first[by_first]
        order, prefix = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for x in range(int(last.max()), -1, -1):
            to = int(np.searchsorted(begins, -x, "left"))   # reads that begin right of x have ended
            if to > out_at:
                out_at = to
                keep = np.flatnonzero(first[order] <= x)
                # The common prefix with the next one left is the least of those in between.
                prefix = np.minimum.reduceat(prefix[:keep[-1] + 1], np.append(0, keep[:-1] + 1)) if len(keep) else prefix[:0]
                order = order[keep]
            to = int(np.searchsorted(ends, -x, "right"))
            if to > in_at:                                  # their suffixes are empty and sort first in their groups
                order = np.concatenate([by_last[in_at:to], order])
                prefix = np.concatenate([np.zeros(to - in_at, np.int32), prefix])
                at = np.argsort(group[order], kind="stable")
                order, prefix = order[at], prefix[at]
                in_at = to
            if not len(order):
                continue
            symbol = columns[len(columns) - 1 - x][order]
            key = group[order] * 256 + symbol
            at = np.argsort(key, kind="stable")
            key = key[at]
            same = np.flatnonzero(key[1:] == key[:-1]) + 1
            new = np.zeros(len(order), np.int32)
            if len(same):
                a, b = at[same - 1] + 1, at[same] + 1
                bounds = np.stack([a, b], 1).ravel()
                new[same] = np.minimum.reduceat(np.append(prefix, np.int32(0)), bounds)[::2] + 1
            order, prefix = order[at], new
            if x + self.window <= self.width:
                shared = np.maximum(prefix, np.append(prefix[1:], np.int32(0))) >= self.window
                if shared.any():
                    yield x, order[shared]


def told(anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries whose (anchor, content) occurs again here, one entry of each different pair, and how often that one occurs (2: or more)."""
    order = np.lexsort((content, anchor))
    a, c = anchor[order], content[order]
    begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))[:len(a)])
    number = np.diff(np.append(begin, len(a)))
    return order[np.repeat(number > 1, number)], order[begin], np.minimum(number, 2).astype(np.int32)


def block_size(starts: int) -> int:
    """Columns of a block: about the root of their number, and at most 62 blocks."""
    return max(isqrt(starts), -(-starts // 62))


def block_cores(data, offsets, first, size, window: int, starts: int):
    """Read, block and hash of the core for all blocks in which a window of a read begins. The core is what all windows of a block share."""
    block = block_size(starts)
    lo, hi = first // block, (first + size - window) // block
    row = np.repeat(np.arange(len(first)), hi - lo + 1)
    number = ranges(lo, hi - lo + 1)
    hashes = window_hashes(data, window - block + 1)
    return row, number, hashes[offsets[row] + number * block + block - 1 - first[row]]


def open_windows(data, offsets, first, size, cells, window: int, starts: int):
    """Read, column and hash of the windows that begin in a read's open blocks (bits of ``cells``), by read and column."""
    number = size - window + 1
    row = np.repeat(np.arange(len(first)), number)
    x = ranges(first, number)
    some = cells[row] >> (x // block_size(starts)) & 1 > 0
    row, x = row[some], x[some]
    return row, x, window_hashes(data, window)[offsets[row] + x - first[row]]


def repeated_runs(docs: DataFrame, found_in: DataFrame, window: int, gram: int, batch_bytes: int, hot_reads: int) -> DataFrame:
    """(d, h, runs): for each text the runs [start, end) of window starts whose windows also start elsewhere.

    ``found_in`` has the rows of ``docs`` as they come, for the step that is written before the rest is planned.
    """
    names = ["d", "h", "start", "size", "off", "a", "c", "n"]
    kinds = "d bigint, h bigint, start bigint, size int, off int, a bigint, c bigint, n int"
    left = window - gram

    def entries(b: pa.RecordBatch, row, start, size, off, anchor, content, n) -> pa.RecordBatch:
        return pa.record_batch([
            b.column("d").take(pa.array(row)), b.column("h").take(pa.array(row)), pa.array(start), pa.array(size.astype(np.int32)),
            pa.array(off.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(n)], names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Reads that occur twice in a batch are known to repeat (n = 0); of each different read one asks for others.
        for b in by_bytes(batches, "t", batch_bytes):
            data, offsets = flat(b.column("t"))
            row, start, size, off, anchor, content = reads(data, offsets, window, gram)
            if not len(row):
                continue
            known, asked, number = told(anchor, content)
            at = np.concatenate([known, asked])
            yield entries(b, row[at], start[at], size[at], off[at], anchor[at], content[at], np.concatenate([np.zeros(len(known), np.int32), number]))

    def fields(b: pa.RecordBatch):
        data, offsets = flat(b.column("read"))
        off = b.column("off").to_numpy(zero_copy_only=False).astype(np.int64)
        return data, offsets, left - off, np.diff(offsets), b.column("start").to_numpy(zero_copy_only=False), b.column("a").to_numpy(
            zero_copy_only=False).view(np.uint64)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Like find, with a block's core in place of a read; size is the block.
        for b in by_bytes(batches, "read", batch_bytes):
            data, offsets, first, size, start, a = fields(b)
            row, number, content = block_cores(data, offsets, first, size, window, left + 1)
            anchor = mix(a[row] + number.astype(np.uint64))
            known, asked, n = told(anchor, content)
            at = np.concatenate([known, asked])
            yield entries(b, row[at], start[row[at]], number[at], number[at], anchor[at], content[at], np.concatenate([np.zeros(len(known), np.int32), n]))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Like find, with single windows in place of reads; known ones are joined to runs.
        for b in by_bytes(batches, "read", max(1, batch_bytes // 8)):
            data, offsets, first, size, start, a = fields(b)
            row, x, content = open_windows(data, offsets, first, size, b.column("cells").to_numpy(zero_copy_only=False), window, left + 1)
            if not len(row):
                continue
            anchor = mix(a[row] + x.astype(np.uint64))
            known, asked, n = told(anchor, content)
            known = np.sort(known)
            new = np.append(True, (row[known][1:] != row[known][:-1]) | (np.diff(x[known]) != 1))[:len(known)]
            begin = np.flatnonzero(new)
            length = x[known[np.append(begin[1:], len(known))[:len(begin)] - 1]] - x[known[begin]]
            at = np.concatenate([known[begin], asked])
            yield entries(b, row[at], start[row[at]] + x[at] - first[row[at]], window + np.concatenate([length, np.zeros(len(asked), np.int64)]),
                          x[at], anchor[at], content[at], np.concatenate([np.zeros(len(begin), np.int32), n]))

    def meet(batches: Iterator[pa.RecordBatch], all_mixed: bool = False) -> Iterator[pa.RecordBatch]:
        """n becomes 0 for reads that repeat as a whole and 1 for one each of a minimizer's different reads, if any occurs once or all are asked for."""
        def decide(t: pa.Table, mixed: bool = False) -> pa.Table:
            a, c, n = (t.column(x).to_numpy() for x in ("a", "c", "n"))
            begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
            size = np.diff(np.append(begin, len(a)))
            total = np.add.reduceat(n, begin)
            owner = np.flatnonzero(np.append(True, a[begin][1:] != a[begin][:-1]))
            several = np.diff(np.append(owner, len(begin))) > 1
            several = np.repeat((several & (np.minimum.reduceat(total, owner) == 1)) | mixed | all_mixed, np.diff(np.append(owner, len(begin))))
            whole, open_ones = np.flatnonzero(np.repeat(total > 1, size)), begin[several]
            out = t.take(pa.array(np.concatenate([whole, open_ones])))
            return out.set_column(7, "n", pa.array(np.repeat(np.array([0, 1], np.int32), [len(whole), len(open_ones)])))

        rest, large = None, False
        for b in batches:
            n = b.column("n").to_numpy(zero_copy_only=False)
            if (n == 0).any():
                yield b.filter(pa.array(n == 0))
            t = pa.Table.from_batches([b.filter(pa.array(n > 0))])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not len(t):
                continue
            a, c = t.column("a").to_numpy(), t.column("c").to_numpy()
            cut = int(np.argmax(a == a[-1]))
            if len(a) - cut > LARGE_GROUP:                  # all but the last different read of it are decided at once
                cut, large_next = int(np.argmax((a == a[-1]) & (c == c[-1]))), True
            else:
                large_next = False
            if cut:
                first = int(np.searchsorted((a != a[0]).astype(np.int8), 1)) if large else 0
                for part, mixed in ((t.slice(0, min(first, cut)), True), (t.slice(first, max(0, cut - first)), False)):
                    if len(part):
                        yield from decide(part, mixed or large_next).combine_chunks().to_batches()
            large = large_next if cut else large
            rest = t.slice(cut).combine_chunks()
        if rest is not None and len(rest):
            yield from decide(rest, large).combine_chunks().to_batches()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, number, before = None, [], 0, None

        def finish():
            read, low, high = shard.runs()
            known = pa.concat_batches(held)
            first = np.concatenate([shard.left - o for o in shard.offs])
            shift = known.column("start").to_numpy(zero_copy_only=False) - first
            keep, number = np.unique(read, return_counts=True)
            some = known.take(pa.array(keep, pa.int64()))
            both = pa.StructArray.from_arrays([pa.array(low + shift[read]), pa.array(high + shift[read] + 1)], ["from", "to"])
            runs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number)), pa.int32()), both)
            return pa.record_batch([some.column("d"), some.column("h"), runs], ["d", "h", "runs"])

        for b in batches:
            a = b.column("a").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else a
            i = 0
            while i < len(a):
                if shard is not None and a[i] != before and shard.n * shard.width >= SHARD_BYTES:
                    yield finish()
                    shard = None
                if shard is None:
                    shard, held = Shard(window, gram), []
                # Whole groups up to the size of a shard; the last one may go on in the next batch.
                room = i + max(1, (SHARD_BYTES - shard.n * shard.width) // shard.width)
                nxt = cut[np.searchsorted(cut, max(room, i + 1), "left")] if room <= cut[-1] else len(a)
                part = b.slice(i, nxt - i)
                own = a[i:nxt]
                new = np.append(before is None or own[0] != before, own[1:] != own[:-1])
                groups = number + np.cumsum(new)
                number, before = int(groups[-1]), own[-1]
                shard.add(groups, part.column("off").to_numpy(zero_copy_only=False).astype(np.int64), part.column("read"))
                held.append(part.select(["d", "h", "start"]))
                i = nxt
        if shard is not None:
            yield finish()

    def settled(rows: DataFrame, by: tuple[str, ...], step) -> DataFrame:
        # Known reads only pass through; they are spread evenly.
        return rows.withColumn("p", F.when(F.col("n") > 0, F.xxhash64(*by)).otherwise(F.xxhash64("d", "h", "start"))).repartition(
            "p").sortWithinPartitions("a", "c").select(*names).mapInArrow(step, kinds)

    def as_runs(rows: DataFrame) -> DataFrame:
        return rows.where("n = 0").select("d", "h", F.array(F.struct(
            F.col("start").alias("from"), (F.col("start") + F.col("size") - window + 1).alias("to"))).alias("runs"))

    def fetched(rows: DataFrame) -> DataFrame:
        lists = rows.where("n = 1").groupBy("d", "h").agg(F.collect_list(F.struct("a", "start", "size", "off")).alias("reads"))
        texts = docs.join(lists, ["d", "h"]).select("d", "h", F.col("t").cast("binary").alias("t"), F.explode("reads").alias("r"))
        return texts.select("d", "h", "r.start", "r.a", "r.off", F.substring(
            F.col("t"), F.col("r.start").cast("int") + 1, F.col("r.size")).alias("read")).dropDuplicates(["d", "h", "start"])

    found = cut_lineage(found_in.select("d", "h", "t").mapInArrow(find, kinds), "reads")
    hot = cut_lineage(found.where("n > 0").groupBy("a").count().where(F.col("count") > hot_reads).select("a"), "hot")
    dealt = None
    if not hot.isEmpty():                                   # one row for each hot_reads reads at most
        met = cut_lineage(settled(found.join(F.broadcast(hot), "a", "left_semi"), ("a", "c"), lambda b: meet(b, True)), "hot_reads")
        texts = cut_lineage(fetched(met), "hot_texts")
        cells = settled(texts.mapInArrow(cores, kinds), ("a", "c"), meet).where("n = 0").groupBy("d", "h", "start").agg(
            F.bit_or(F.expr("shiftleft(1L, size)")).alias("cells"))
        single = settled(texts.join(cells, ["d", "h", "start"]).mapInArrow(windows, kinds), ("a", "c"), meet)
        dealt = as_runs(met).unionByName(as_runs(single))
        found = found.join(F.broadcast(hot), "a", "left_anti")
    met = settled(found, ("a",), meet)
    sorted_ones = fetched(met).repartition("a").sortWithinPartitions("a").mapInArrow(
        sort, "d bigint, h bigint, runs array<struct<`from`:bigint,`to`:bigint>>")
    out = as_runs(met).unionByName(sorted_ones)
    if dealt is not None:
        out = out.unionByName(dealt)
    return out.groupBy("d", "h").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def remove_repeats(docs: DataFrame, window: int = 400, gram: int = GRAM, text: str = "text", key: str = "doc_id",
                   batch_bytes: int = BATCH_BYTES, kept: bool = False, hot_reads: int = HOT_READS) -> DataFrame:
    """One row per row of ``docs``: key (an integer), n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and if asked for, kept.

    A byte goes if a string of ``window`` bytes covers it that also starts anywhere else, in the same text or another. Null texts are
    empty; texts shorter than a window stay. Repeated rows are texts of their own, so they remove each other; a null key is
    kept. ``kept`` is binary, since a cut may fall inside a character. Other columns are left out.
    """
    gram = min(gram, window)
    rows = numbered(docs, text, key).withColumn("h", F.xxhash64("t"))
    placed = rows.repartition("d", "h")                     # read twice, exchanged once
    placed_runs = repeated_runs(placed, rows, window, gram, batch_bytes, hot_reads)
    joined = placed.join(placed_runs, ["d", "h"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "t", batch_bytes):
            data, offsets = flat(b.column("t"))
            runs = pa.concat_arrays([b.column("runs")])
            number = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
            values = runs.flatten()
            lo, hi = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            base = np.repeat(offsets[:-1], number)
            gone = covered(len(data), lo + base, hi - lo + window - 1)
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            begins = gone.copy()
            begins[1:] &= ~gone[:-1] | edge[1:-1]
            count = np.append(0, np.cumsum(gone))
            spans = np.append(0, np.cumsum(begins))
            left = [data[i:j][~gone[i:j]].tobytes() if n else data[i:j].tobytes() for i, j, n in zip(offsets[:-1], offsets[1:], number)]
            out = [b.column("d"), pa.array(np.diff(offsets)), pa.array(np.diff(count[offsets])), pa.array(np.diff(spans[offsets])), pa.array(
                [hashlib.sha256(x).hexdigest() for x in left], pa.string())]
            if kept:
                out.append(pa.array(left, pa.binary()))
            yield pa.record_batch(out, ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * kept])

    out = joined.select("d", "t", "runs").mapInArrow(
        cut, "d bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * kept)
    return named(out, docs, key)
