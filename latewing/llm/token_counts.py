"""Token counts: Arrow functions encode batches of texts and return only lengths.

A byte-level file whose ids follow its merges is read by tiktoken, which gives the same ids as tokenizers in a fifth of the time;
other files go to tokenizers or sentencepiece.
Batches are balanced by bytes. A long text is cut before spaces that follow a letter or digit, where the pre-tokenizer always
begins a new piece, so the lengths of its parts add up to the length of the whole. Very long runs of white space, on which tiktoken's
regex engine gives up, are pieces that are merged without it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, functions as F

from latewing.llm.byte_bpe import vocabulary
from latewing.llm.flat import with_key

BATCH_BYTES = 1 << 20
PART_CHARS = 1 << 16
#: The white space of the pattern, which is not quite Python's; a run is found where it begins.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(rf"(?<![{_WHITE}])[{_WHITE}]{{65536,}}")


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def _byte_level(path: str):
    """A tiktoken encoding with the vocabulary of a byte-level file; None if the file is of another kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or any(pre.get(k) != v for k, v in plain.items()) or model.get("ignore_merges"):
        return None
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    if any(a >= b for a, b in zip(made, made[1:])) or len(made) + 256 != len(model["vocab"]):
        return None
    v = vocabulary(path)
    ranks = {v.bytes_of.get(i): i for i in model["vocab"].values()}
    return tiktoken.Encoding("byte level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=v.special)


@lru_cache(maxsize=4)
def _sentence_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def safe_parts(text: str, size: int = PART_CHARS) -> list[str]:
    """Cut a text into parts of about ``size`` characters, only before a space that follows a letter or digit.

    Such a space never stands inside a byte-level piece: spaces begin pieces or belong to runs of white space, and what
    precedes ends with a character that is none. A text without such a place stays whole.
    """
    parts, start = [], 0
    while len(text) - start > size:
        at = text.find(" ", start + size)
        while at > 0 and not text[at - 1].isalnum():
            at = text.find(" ", at + 1)
        if at < 0:
            break
        parts.append(text[start:at])
        start = at
    parts.append(text[start:])
    return parts


def byte_level_length(own: tiktoken.Encoding, text: str) -> int:
    """The number of tokens of a text; if the regex engine gives up, long runs of white space are cut out and merged by themselves.

    What follows a run takes its last character, unless that is the end or a special token.
    """
    try:
        return len(own.encode(text, allowed_special="all"))
    except ValueError:
        if not LONG_RUN.search(text):
            raise
    n, at = 0, 0
    for m in LONG_RUN.finditer(text):
        whole = m.end() == len(text) or any(text.startswith(t, m.end()) for t in own.special_tokens_set)
        end = m.end() if whole else m.end() - 1
        n += len(own.encode(text[at:m.start()], allowed_special="all")) + len(own._encode_single_piece(text[m.start():end]))
        at = end
    return n + len(own.encode(text[at:], allowed_special="all"))


def byte_level_lengths(own: tiktoken.Encoding, group: list[str]) -> list[int]:
    """The numbers of tokens of a group of parts, encoded by one call; one by one if the regex engine gives up on any."""
    try:
        return [len(x) for x in own.encode_batch(group, num_threads=1, allowed_special="all")]
    except ValueError:
        return [byte_level_length(own, p) for p in group]


def lengths(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES, part_chars: int = PART_CHARS) -> np.ndarray:
    """The number of tokens of each text, without added special tokens."""
    if path.endswith(".model"):
        # The pieces of this library depend on more than the neighbouring characters: whole texts only.
        encode = _sentence_model(path).encode
        parts, count = [[t] for t in texts], lambda group: [len(x) for x in encode(group, num_threads=1)]
    elif own := _byte_level(path):
        parts = [safe_parts(t, part_chars) for t in texts]
        count = lambda group: byte_level_lengths(own, group)
    else:
        encode = _tokenizer(path).encode_batch_fast
        parts = [[t] for t in texts]
        count = lambda group: [len(x) for x in encode(group, add_special_tokens=False)]
    out, row, group, held = np.zeros(len(texts), np.int64), [], [], 0
    for i, some in enumerate(parts):
        for p in some:
            row.append(i)
            group.append(p)
            held += len(p)
            if held >= batch_bytes:
                np.add.at(out, row, count(group))
                row, group, held = [], [], 0
    if group:
        np.add.at(out, row, count(group))
    return out


def token_counts(
    docs: DataFrame, tokenizer: str | None = None, limit: int = 512, text: str = "text", key: str = "doc_id",
    batch_bytes: int = BATCH_BYTES, part_chars: int = PART_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: the key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows and null keys stay as they are; other columns of ``docs`` are
    left out, whatever their names. Strings of special tokens inside a text count as the library counts them by default.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for b in batches:
            yield pa.record_batch([
                b.column(0), pc.binary_length(b.column(1)).cast(pa.int64()),
                pa.array(lengths(b.column(1).to_pylist(), path, batch_bytes, part_chars))], ["k", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, with_key(rows, "n_bytes bigint, n_tokens bigint")).select(
        F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
