"""Byte-level BPE: batched numpy merge rounds, and decoding by table.

The distinct pieces of a batch lie in one flat array of symbols. Each round looks every adjacent pair up in the sorted array of
pair keys by binary search and merges, in every piece, all places of its lowest-ranked pair; finished pieces leave the
array. Merging all places of one pair at once is what the usual algorithm does, since a pair's product only takes part in
merges of higher rank.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from latewing.llm.flat import by_bytes, gather, with_key

BATCH_BYTES = 4 << 20
#: The characters of Unicode's White_Space property, and the separators that count as such in some libraries.
WHITE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of_char()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for token, i in ids.items():
            tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in byte_of.items():
            self.byte_ids[b] = ids[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        self.products = np.array([ids[a + b] for a, b in pairs], np.int32)  # by rank
        self.size = size
        self.bytes_of = _Table(tokens)
        self.digits_of = _Table([b"%d," % i for i in range(size)])
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        """The pieces that are encoded on their own; special tokens are pieces."""
        if self.specials is None or not any(s in text for s in self.special):
            return self.pieces.findall(text)
        out = []
        for part in self.specials.split(text):
            out += [part] if part in self.special else self.pieces.findall(part)
        return out

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and offsets."""
        raw = [b"" if p in self.special else p.encode() for p in pieces]
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        piece = np.repeat(np.arange(len(raw), dtype=np.int32), np.fromiter(map(len, raw), np.int64, len(raw)))
        done_ids, done_piece, done_at = [], [], []
        at = np.arange(len(symbols))                       # keeps the order of symbols across rounds
        none = np.int32(len(self.ranks))
        while len(symbols) > 1:
            keys = symbols[:-1].astype(np.int64) << 32 | symbols[1:]
            place = np.searchsorted(self.keys, keys)
            place[place == len(self.keys)] = 0
            rank = np.where((self.keys[place] == keys) & (piece[:-1] == piece[1:]), self.ranks[place], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
            lowest = np.repeat(best, lengths)
            merge = (rank == lowest) & (rank < none)
            twice = np.flatnonzero(merge[1:] & merge[:-1])  # overlapping places of a pair of equal symbols: every other one
            if len(twice):
                where = np.flatnonzero(merge)
                first = np.append(True, np.diff(where) > 1)
                begin = np.maximum.accumulate(np.where(first, np.arange(len(where)), 0))
                merge[where[(np.arange(len(where)) - begin) % 2 == 1]] = False
            symbols = np.where(merge, self.products[np.minimum(rank, none - 1)], symbols).astype(np.int32)
            keep = np.append(True, ~merge[:-1])
            finished = lowest == none
            if finished.any():
                done_ids.append(symbols[finished])
                done_piece.append(piece[finished])
                done_at.append(at[finished])
                keep &= ~finished
            symbols, piece, at = symbols[keep], piece[keep], at[keep]
        done_ids.append(symbols)
        done_piece.append(piece)
        done_at.append(at)
        for i, p in enumerate(pieces):
            if p in self.special:
                done_ids.append(np.array([self.special[p]], np.int32))
                done_piece.append(np.array([i], np.int32))
                done_at.append(np.zeros(1, np.int64))
        ids, piece, at = (np.concatenate(x) for x in (done_ids, done_piece, done_at))
        order = np.lexsort((at, piece))
        offsets = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(np.bincount(piece, minlength=len(pieces)), out=offsets[1:])
        return ids[order], offsets

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a list or Arrow array without null) in one array, and offsets.

        Texts are cut before single spaces; the distinct words between are split into pieces and encoded once. The cut is where
        the pre-tokenizer also cuts, unless white space stands on both sides of the space; such texts, and those with
        special tokens, are split into pieces as a whole.
        """
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        odd = pc.match_substring_regex(texts, f"{WHITE} {WHITE}")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        words = lists.flatten().dictionary_encode()
        unit = words.indices.to_numpy().astype(np.int64)
        begins = lists.flatten().take(pa.array(bounds[:-1])).dictionary_encode()  # the first words have no space before them
        unit[bounds[:-1]] = begins.indices.to_numpy() + len(words.dictionary)
        units = [" " + w for w in words.dictionary.to_pylist()] + begins.dictionary.to_pylist()

        known: dict[str, int] = {}
        pieces: list[int] = []
        ends = []
        split = [self.pieces.findall(u) for u in units] + [self.split(texts[int(i)].as_py()) for i in np.flatnonzero(odd)]
        for some in split:
            pieces += [known.setdefault(p, len(known)) for p in some]
            ends.append(len(pieces))
        ids, offsets = self.encode_pieces(list(known))
        piece = np.array(pieces, np.int64)
        length = np.diff(offsets)[piece]
        total = np.zeros(len(piece) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        ids = gather(ids, offsets[:-1][piece], length)     # of all units
        unit_ends = total[np.array([0, *ends])]

        unit[bounds[:-1][odd]] = len(units) + np.arange(int(odd.sum()))
        length = np.diff(unit_ends)[unit]
        total = np.zeros(len(unit) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        return gather(ids, unit_ends[:-1][unit], length), total[bounds]

    def decode_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.bytes_of.of(ids, offsets)

    def decode(self, ids) -> str:
        """One text; bytes that are no UTF-8 become replacement characters, as in the library."""
        data, _ = self.decode_bytes(np.asarray(ids, np.int64), np.array([0, len(ids)]))
        return data.tobytes().decode("utf-8", "replace")


class _Table:
    """Byte strings by id, looked up for many ids at once."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.length = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.length) - self.length

    def get(self, i: int) -> bytes:
        return self.data[self.start[i]:self.start[i] + self.length[i]].tobytes()

    def of(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.length[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        return gather(self.data, self.start[ids], length), ends[offsets]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", key: str = "doc_id",
           batch_bytes: int = BATCH_BYTES, ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: key, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids.

    A null or empty text has no ids. Repeated rows and null keys stay; other columns are left out. ``ids_sha256`` is the digest of
    the decimal ids joined by commas, ``decoded_sha256`` that of the text decoded from the ids.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    names = ["k", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in by_bytes(batches, "t", batch_bytes):
            found, offsets = v.encode(b.column(1))
            digits, d_at = v.digits_of.of(found, offsets)
            shas = [hashlib.sha256(digits[i:max(i, j - 1)]).hexdigest() for i, j in zip(d_at[:-1], d_at[1:])]
            decoded, t_at = v.decode_bytes(found, offsets)
            back = [hashlib.sha256(_utf8(decoded[i:j])).hexdigest() for i, j in zip(t_at[:-1], t_at[1:])]
            columns = [b.column(0), pa.array(np.diff(offsets)), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(found.astype(np.int32))))
            yield pa.record_batch(columns, names)

    out = rows.mapInArrow(work, with_key(
        rows, "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids))
    return out.select(F.col("k").alias(key), *names[1:])


def _utf8(data: np.ndarray) -> bytes:
    raw = data.tobytes()
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


def decode(encoded: DataFrame, tokenizer: str | None = None, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and text for each row of ids; null ids give an empty text."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = encoded.select(F.col(key).alias("k"), F.col(ids).alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            texts = [v.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["k", "t"])

    return rows.mapInArrow(work, with_key(rows, "t string")).select(
        F.col("k").alias(key), F.col("t").alias("text"))
