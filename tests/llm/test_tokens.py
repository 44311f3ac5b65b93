import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from latewing.llm import byte_bpe, token_counts
from tests.llm.tables import documents, empty, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def hostile_texts():
    rnd = random.Random(3)
    pool = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    out = ["".join(rnd.choice(" \n\t'sabc1é  aaaa") for _ in range(rnd.randrange(80))) for _ in range(400)]
    out += ["".join(rnd.choice(pool) + rnd.choice(["", " ", "a", "1"]) for _ in range(40)) for _ in range(400)]
    out += ["a<|endoftext|>  b", "  <|endoftext|>", "a  <|endoftext|><|endoftext|>", "", " ", "a" * 5000, "\n \n x", "a \n b", "'ll 've"]
    return out


def test_ids_and_round_trip_equal_the_library():
    texts, v = hostile_texts(), byte_bpe.vocabulary(PATH)
    ids, at = v.encode(texts)
    for i, e in enumerate(LIBRARY.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i]:at[i + 1]].tolist() == e.ids, texts[i]
        assert v.decode(e.ids) == LIBRARY.decode(e.ids, skip_special_tokens=False)
    broken = [220, 100, 5, 255, 7]  # bytes that are no UTF-8
    assert v.decode(broken) == LIBRARY.decode(broken, skip_special_tokens=False)


def test_safe_parts_keep_the_length():
    texts = hostile_texts()
    expected = [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    for part in (1, 7, 100):
        assert token_counts.lengths(texts, PATH, 64, part).tolist() == expected
    assert all("".join(token_counts.safe_parts(t, 5)) == t for t in texts)


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, "\u3000\x85 \t" * 300_000])
def test_long_runs_of_white_space(run):
    texts = [run, f"word{run}word", f"a.{run}<|endoftext|>{run}\n", f"1 {run}\n!"]
    assert token_counts.lengths(texts, PATH).tolist() == [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_tokenizer_files():
    import sentencepiece

    texts = ["Hello World 12", "", "été über"]
    for name in ("word_bpe_49k.json",):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        assert token_counts.lengths(texts, public_tokenizers.path(name)).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    p = public_tokenizers.path("piece_bpe_32k.model")
    s = sentencepiece.SentencePieceProcessor(model_file=p)
    assert token_counts.lengths(texts, p).tolist() == [len(s.encode(x)) for x in texts]


def test_tables(spark):
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    expected = [(d, len((t or "").encode()), len(LIBRARY.encode(t or "", add_special_tokens=False).ids)) for d, t in rows()]
    out = token_counts.token_counts(documents(spark), batch_bytes=500, part_chars=100)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted([tuple(r)[:3] for r in out.collect()], key=key) == sorted(expected, key=key)
    assert all(r.over_limit == (r.n_tokens > 512) for r in out.collect())
    coded = byte_bpe.encode(documents(spark), batch_bytes=500)
    assert sorted([(r.doc_id, r.n_tokens, r.decoded_sha256) for r in coded.collect()], key=key) == sorted(
        [(d, n, hashlib.sha256((t or "").encode()).hexdigest()) for (d, t), (_, _, n) in zip(rows(), expected)], key=key)
    for r in coded.collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    back = byte_bpe.decode(coded)
    assert sorted([tuple(r) for r in back.collect()], key=key) == sorted([(d, t or "") for d, t in rows()], key=key)
    assert token_counts.token_counts(empty(spark)).count() == byte_bpe.encode(empty(spark)).count() == 0


@pytest.mark.parametrize("name", ["op1_token_counts", "op3_bpe"])
def test_query_on_all_documents(spark, sf, name):
    from latewing.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in QUERIES[name].run(spark, sf).collect()}
    assert got == {d: len(LIBRARY.encode(t, add_special_tokens=False).ids) for d, t in texts.items()}


def test_groups_are_encoded_at_once(monkeypatch):
    """One call a group of parts, groups of about ``batch_bytes``; a group that the engine refuses is counted part by part."""
    import public_tokenizers
    from latewing.llm import token_counts

    path, calls = public_tokenizers.path("byte_bpe_50k.json"), []
    real = token_counts.byte_level_lengths
    monkeypatch.setattr(token_counts, "byte_level_lengths", lambda own, group: calls.append(sum(map(len, group))) or real(own, group))
    texts = ["some words and more " * 50] * 40 + ["x", "", "word " * 3000]
    got = token_counts.lengths(texts, path, batch_bytes=5000, part_chars=2000)
    assert got.tolist() == [len(token_counts._tokenizer(path).encode(t, add_special_tokens=False).ids) for t in texts]
    assert 10 <= len(calls) < len(texts) and max(calls) < 5000 + 2 * 2000
    odd = ["a" + " " * 1_200_000 + "b", "a b"]
    assert token_counts.lengths(odd, path).tolist() == [len(token_counts._tokenizer(path).encode(t, add_special_tokens=False).ids) for t in odd]
