import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from latewing.llm import alignment
from tests.llm.tables import documents, empty, rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spelled():
    """Functions from a text to (id, bytes) lists of both sides, by the libraries alone."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}

    def a(text):
        return [(i, bytes(chars[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]

    def b(text):
        out = []
        for i in second.encode(text):
            p = second.id_to_piece(i)
            out.append((i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()))
        return out
    return a, b


def brute(texts):
    first, second = spelled()
    whole, held = [], Counter()
    for t in texts:
        a, b = (first(t), second(t)) if t else ([], [])
        want = (" " + (t or "")).encode()
        if not t or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            whole.append(None)
            continue
        owner = []          # of each byte, the places of its tokens
        for side in (a, b):
            owner.append([i for i, (_, x) in enumerate(side) for _ in x])
        links = {(i, k) for i, k in zip(*owner)}
        ends = [{0}, {0}]
        for s, side in enumerate((a, b)):
            at = 0
            for _, x in side:
                at += len(x)
                ends[s].add(at)
        cuts = sorted(ends[0] & ends[1])
        groups = ";".join("|".join(",".join(str(side[i][0]) for i in sorted({own[p] for p in range(lo, hi)})) for side, own in zip((a, b), owner))
                          for lo, hi in zip(cuts, cuts[1:]))
        pairs = [(a[i][0], b[k][0]) for i, k in links]
        held.update(set(pairs))
        whole.append((len(a), len(b), len(cuts) - 1, pairs, groups))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for w in whole:
        if w is None:
            out.append((0, 0, 0, 0, 0, 0, "", ""))
            continue
        na, nb, ng, pairs, groups = w
        out.append((na, nb, ng, len(pairs), sum(held[p] == best[p[0]] for p in pairs), sum(held[p] for p in pairs),
                    hashlib.sha256(groups.encode()).hexdigest(), groups))
    return out


def check(spark, data, **options):
    got = alignment.cross_align(documents(spark, data), with_groups=True, **options).collect()
    mine = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in got]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    want = [(d, *x) for (d, _), x in zip(data, brute([t for _, t in data]))]
    assert sorted(mine, key=key) == sorted(want, key=key)


def odd_texts():
    texts = ["<|endoftext|> and <s> </s> <unk>", "▁a ▁", "a▁b", "  two  spaces ", "\n\t\x00\x7f", "日本語のテキスト", "\U0001f600\U0001f468‍\U0001f469", "éé ﬁ ①",
             " ", "x", "﻿bom", "Ünïcödé naïve façade", "0123456789" * 30, "a" * 3000, " " * 4000 + "x", "don't can't we'll", " 　line", "🇩🇪🇫🇷"]
    return [(1000 + i, t) for i, t in enumerate(texts)]


def test_against_brute_force(spark):
    data = rows(seed=2) + odd_texts()
    check(spark, data)
    check(spark, data, block_bytes=500)


def test_documents(spark, sf):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], block_bytes=100_000)


def test_alignment_of_random_tokens():
    rnd = random.Random(4)
    for _ in range(300):
        n = rnd.randrange(1, 60)
        sizes = []
        for _ in range(2):
            cut = sorted({0, n, *(rnd.randrange(1, n) for _ in range(rnd.randrange(n)))} if n > 1 else {0, 1})
            sizes.append(np.diff(cut))
        a, b = (np.repeat(np.arange(len(s)), s) for s in sizes)
        found = alignment.align(*sizes)
        assert sorted(zip(found.a_link.tolist(), found.b_link.tolist())) == sorted(set(zip(a.tolist(), b.tolist())))
        assert len(found.a_link) == len(sizes[0]) + len(sizes[1]) - (len(found.a_border) - 1)
        ends = [np.append(0, np.cumsum(s)) for s in sizes]
        assert [ends[0][i] for i in found.a_border] == [ends[1][i] for i in found.b_border] == sorted(set(ends[0]) & set(ends[1]))


def test_long_white_space(spark):
    """A text on which the fast engine gives up."""
    data = [(1, "a" + " " * 1_200_000 + "b"), (2, "a b")]
    got = {r.doc_id: r for r in alignment.cross_align(documents(spark, data)).collect()}
    ids = next(alignment.byte_ids([" " + data[0][1]], A))
    own = Tokenizer.from_file(A)
    assert ids == own.encode(" " + data[0][1], add_special_tokens=False).ids and got[1].n_a == len(ids) and got[2].n_links >= 2


def test_keys_and_empty(spark):
    assert alignment.cross_align(empty(spark)).count() == 0
    kinds = T.StructType([T.StructField("doc_id", T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])), T.StructField("text", T.StringType())])
    got = alignment.cross_align(spark.createDataFrame([(("x", 1), "some text"), (None, "some text"), (("y", None), None)], kinds)).collect()
    assert {(r.doc_id and tuple(r.doc_id)): r.count_sum > 0 for r in got} == {("x", 1): True, None: True, ("y", None): False}
