"""Alignment of two tokenizers' tokens of the same text.

Tokens cover bytes one after the other, so a token is its end. Where an end of one side is an end of the other too, both id lists
are cut: the common ends come from the key sets of two dictionaries from end to index, and the slices between them are the groups.
In a group all pairs of tokens that share bytes are linked.

How many documents of the corpus hold a linked pair is counted in two steps: a task counts its own block of documents, and the
blocks' counts are added up. The totals travel back to each block that holds a pair, once, not to each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from latewing.llm.byte_bpe import vocabulary
from latewing.llm.flat import by_bytes, ranges
from latewing.llm.token_counts import _byte_level, _sentence_model, _tokenizer, safe_parts
from latewing.session import cut_lineage

BLOCK_BYTES = 8 << 20       # texts that are counted together
SENT_PAIRS = 1 << 16        # pairs of a block in one row
SIDE = 32                   # bits of an id of the second side in a pair


@dataclass(frozen=True)
class Side:
    """Bytes and sizes of a vocabulary's tokens, and for each its id as text twice: inside a group, and at the end of its part."""

    token: list
    size: np.ndarray
    name: list


def _side(token: list, end: str) -> Side:
    return Side(token, np.array([len(t) for t in token], np.int64), [f"{i}{c}" for i in range(len(token)) for c in (",", end)])


@lru_cache(maxsize=2)
def both_sides(paths: tuple[str, str]) -> tuple[Side, Side, list]:
    """Both vocabularies, and their names in one list."""
    a, b = byte_side(paths[0]), piece_side(paths[1])
    return a, b, a.name + b.name


@lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    known = vocabulary(path)
    return _side([known.bytes_of.get(i) for i in range(known.size)], "|")


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    model = _sentence_model(path)
    return _side([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                  for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))], ";")


def byte_ids(texts: list[str], path: str) -> Iterator[list[int]]:
    """Ids of a byte-level file; strings of special tokens are plain text. A text on which the fast engine gives up goes to the other."""
    own = _byte_level(path)

    def slowly(text: str) -> list[int]:
        library = _tokenizer(path)
        before, library.encode_special_tokens = library.encode_special_tokens, True
        ids = library.encode(text, add_special_tokens=False).ids
        library.encode_special_tokens = before
        return ids

    for t in texts:
        try:
            ids = [i for p in safe_parts(t) for i in own.encode(p, disallowed_special=())] if own else slowly(t)
        except ValueError:
            ids = slowly(t)
        yield ids


@dataclass(frozen=True)
class Alignment:
    """Borders of the groups in both id lists (the first is 0), and the linked tokens as places in these lists."""

    a_border: np.ndarray
    b_border: np.ndarray
    a_link: np.ndarray
    b_link: np.ndarray


def align(a_size: np.ndarray, b_size: np.ndarray) -> Alignment:
    """The alignment of two token lists over the same bytes, given the tokens' sizes, none of them 0."""
    a_ends, b_ends = np.cumsum(a_size), np.cumsum(b_size)
    a_at, b_at = dict(zip(a_ends.tolist(), range(1, len(a_ends) + 1))), dict(zip(b_ends.tolist(), range(1, len(b_ends) + 1)))
    common = sorted(filter(b_at.__contains__, a_at))
    a_border = np.fromiter(chain((0,), map(a_at.__getitem__, common)), np.int64, len(common) + 1)
    b_border = np.fromiter(chain((0,), map(b_at.__getitem__, common)), np.int64, len(common) + 1)
    wide_a, wide_b = np.diff(a_border), np.diff(b_border)
    # A slice with one token on a side links it to all of the other side.
    plain = np.flatnonzero((wide_a == 1) | (wide_b == 1))
    n = np.maximum(wide_a, wide_b)[plain]
    step = ranges(np.zeros(len(plain), np.int64), n)
    a_link = np.repeat(a_border[plain], n) + np.where(np.repeat(wide_a[plain] > 1, n), step, 0)
    b_link = np.repeat(b_border[plain], n) + np.where(np.repeat(wide_b[plain] > 1, n), step, 0)
    # In the other slices every stretch between neighbouring ends of either side links the two tokens that cover it.
    wide = np.flatnonzero((wide_a > 1) & (wide_b > 1))
    ends = np.concatenate([a_ends[ranges(a_border[wide], wide_a[wide])], b_ends[ranges(b_border[wide], wide_b[wide])]])
    ends = np.unique(ends) if len(ends) else ends
    return Alignment(a_border, b_border, np.append(a_link, np.searchsorted(a_ends, ends)), np.append(b_link, np.searchsorted(b_ends, ends)))


def written(found: Alignment, a_ids: np.ndarray, b_ids: np.ndarray, sides: tuple[Side, Side, list]) -> str:
    """Groups as ``a1,a2|b1;a3|b2,b3``: the names of all tokens in their order, each with what follows it."""
    place = np.empty(len(a_ids) + len(b_ids), np.int64)
    wide_a, wide_b = np.diff(found.a_border), np.diff(found.b_border)
    # A token comes after the ids of both sides in the groups before it, and one of the second side after its group's first side.
    at_a = np.arange(len(a_ids)) + np.repeat(found.b_border[:-1], wide_a)
    at_b = np.arange(len(b_ids)) + np.repeat(found.a_border[1:], wide_b)
    last_a, last_b = (np.zeros(len(x), np.int64) for x in (a_ids, b_ids))
    last_a[found.a_border[1:] - 1] = last_b[found.b_border[1:] - 1] = 1
    place[at_a] = a_ids * 2 + last_a
    place[at_b] = len(sides[0].name) + b_ids * 2 + last_b
    return "".join(map(sides[2].__getitem__, place.tolist()))[:-1]


def _spells(ids: list[int], side: Side, whole: bytes) -> bool:
    return b"".join(map(side.token.__getitem__, ids)) == whole


OWN = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
#: A row is a document (key, figures, its pairs as places in the block's list with their numbers) or a part of a block's list.
ROWS = f"block bigint, k {{key}}, {OWN}, groups string, place binary, times binary, pair binary, held binary"


class Block:
    """Documents counted together."""

    def __init__(self):
        self.keys, self.figures, self.pairs, self.times, self.size = [], [], [], [], 0

    def add(self, keys: list, texts: list[str], paths: tuple[str, str], with_groups: bool) -> None:
        sides, lossless = both_sides(paths), _byte_level(paths[0]) is not None
        a_side, b_side, _ = sides
        told = [t for t in texts if t]
        b_lists = iter(_sentence_model(paths[1]).encode(told, num_threads=1) if told else [])
        a_lists = byte_ids([" " + t for t in told], paths[0])
        for key, t in zip(keys, texts):
            self.keys.append(key)
            a, b = (next(a_lists), next(b_lists)) if t else ([], [])
            whole = (" " + t).encode()
            if not t or not _spells(b, b_side, whole) or not lossless and not _spells(a, a_side, whole):
                self.figures.append((0, 0, 0, 0, "", "" if with_groups else None))
                self.pairs.append(np.zeros(0, np.int64))
                self.times.append(np.zeros(0, np.int32))
                continue
            a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
            found = align(a_side.size[a_ids], b_side.size[b_ids])
            groups = written(found, a_ids, b_ids, sides)
            pairs, times = np.unique(a_ids[found.a_link] << SIDE | b_ids[found.b_link], return_counts=True)
            self.pairs.append(pairs)
            self.times.append(times.astype(np.int32))
            self.figures.append((len(a), len(b), len(found.a_border) - 1, len(found.a_link), hashlib.sha256(groups.encode()).hexdigest(),
                                 groups if with_groups else None))

    def rows(self, number: int, kind: pa.Schema) -> Iterator[pa.RecordBatch]:
        if not self.keys:
            return
        ends = np.cumsum([len(p) for p in self.pairs])
        pairs, place, held = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        places = np.split(place.astype(np.int32), ends[:-1])
        n = len(self.keys)
        cols = [pa.array([number] * n, pa.int64()), pa.array(self.keys, kind.field("k").type)]
        cols += [pa.array(c, kind.field(i + 2).type) for i, c in enumerate(zip(*self.figures))]
        cols += [pa.array([np.diff(p, prepend=np.int32(0)).astype(np.int32).tobytes() for p in places], pa.binary()), pa.array([t.tobytes() for t in self.times], pa.binary())]
        cols += [pa.nulls(n, pa.binary())] * 2
        yield pa.record_batch(cols, schema=kind)
        cut = range(0, len(pairs), SENT_PAIRS)
        m = len(cut)
        if m:
            sent = [pa.array([number] * m, pa.int64()), *(pa.nulls(m, f.type) for f in list(kind)[1:-2])]
            sent += [pa.array([c[i:i + SENT_PAIRS].tobytes() for i in cut], pa.binary()) for c in (pairs, held.astype(np.int64))]
            yield pa.record_batch(sent, schema=kind)


def tokenized(
    docs: DataFrame, text: str, key: str, paths: tuple[str, str], block_bytes: int = BLOCK_BYTES, with_groups: bool = False,
) -> DataFrame:
    """Rows of documents and of blocks' pair lists, as ROWS says, written once. A block is of one task, and no longer than ``block_bytes`` or one text."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = ROWS.format(key=rows.schema["k"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, block, schema = TaskContext.get().partitionId(), 0, Block(), None
        for b in by_bytes(batches, "t", block_bytes):
            schema = schema or _schema(b.schema.field("k").type)
            size = pc.sum(pc.binary_length(b.column(1))).as_py() or 0
            if block.size and block.size + size > block_bytes:
                yield from block.rows(task << 32 | number, schema)
                number, block = number + 1, Block()
            block.size += size
            block.add(b.column(0).to_pylist(), b.column(1).to_pylist(), paths, with_groups)
        if schema:
            yield from block.rows(task << 32 | number, schema)

    return cut_lineage(rows.mapInArrow(run, kind), "tokens-of-two")


def _schema(key: pa.DataType) -> pa.Schema:
    whole, text, raw = pa.int64(), pa.string(), pa.binary()
    fields = [("block", whole), ("k", key), ("n_a", whole), ("n_b", whole), ("n_groups", whole), ("n_links", whole), ("groups_sha256", text),
              ("groups", text), ("place", raw), ("times", raw), ("pair", raw), ("held", raw)]
    return pa.schema(fields)


def block_pairs(told: DataFrame) -> DataFrame:
    """(block, pair, held): each pair of a block with the number of the block's documents that hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, pair, held in zip(*(b.column(i).to_pylist() for i in range(3))):
                pairs = np.frombuffer(pair, np.int64)
                yield pa.record_batch([pa.array(np.full(len(pairs), number)), pa.array(pairs), pa.array(np.frombuffer(held, np.int64))], ["block", "pair", "held"])

    return told.where(F.col("pair").isNotNull()).select("block", "pair", "held").mapInArrow(run, "block bigint, pair bigint, held bigint")


def pair_counts(sent: DataFrame) -> DataFrame:
    """(pair, count, best): the number of documents that hold a linked pair, and the largest such number of its first id.

    A first id has no more pairs than the second vocabulary has tokens.
    """
    total = sent.groupBy("pair").agg(F.sum("held").alias("count"))
    best = total.groupBy(F.shiftright("pair", SIDE).alias("a")).agg(F.max("count").alias("best"))
    total = total.withColumn("a", F.shiftright("pair", SIDE))
    return total.join(best, "a").select("pair", "count", "best")


def cross_align(
    docs: DataFrame, first: str | None = None, second: str | None = None, text: str = "text", key: str = "doc_id",
    block_bytes: int = BLOCK_BYTES, with_groups: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if asked for.

    A is the byte-level file ``first`` over space + text, B the sentencepiece model ``second`` over text. A text that is null, empty
    or not what the tokens of either spell has no tokens: zeros and an empty digest. Each row counts as a document, also
    repeated ones; null keys stay; other columns of ``docs`` are left out, whatever their names. A task holds one block of
    texts, or one text that is longer.
    """
    paths = first or public_tokenizers.path("byte_bpe_50k.json"), second or public_tokenizers.path("piece_bpe_32k.model")
    told = tokenized(docs, text, key, paths, block_bytes, with_groups)
    sent = block_pairs(told)
    counts = cut_lineage(pair_counts(sent), "pair-counts")
    answers = sent.join(counts, "pair").select("block", "pair", "count", "best")
    own = told.where(F.col("pair").isNull()).drop("pair", "held")
    names = ["k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    kind = f"k {own.schema['k'].dataType.simpleString()}, {OWN}, groups string, n_best bigint, count_sum bigint"

    def settle(rows: pa.Table, found: pa.Table) -> pa.Table:
        pair, count, best = (found.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.argsort(pair)
        count, leads = count[order], (count == best)[order]
        n_best, count_sum = [], []
        for place, times in zip(rows.column("place").to_pylist(), rows.column("times").to_pylist()):
            at, n = np.cumsum(np.frombuffer(place, np.int32)), np.frombuffer(times, np.int32).astype(np.int64)
            n_best.append(int(n[leads[at]].sum()))
            count_sum.append(int((n * count[at]).sum()))
        return rows.select(names).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    done = own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(settle, kind)
    out = done.select(F.col("k").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    return out if with_groups else out.drop("groups")
