import random
import re

import numpy as np

from latewing.llm import decontaminate
from tests.llm.tables import documents, empty, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, window=13):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[k:k + window]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[tuple(w[k:k + n])]
        out.append((d, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def check(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS k", "'x' AS items")
    got = decontaminate.contamination(documents(spark, docs), bench, **options)
    key = lambda x: (x[0] is None, x[0] or 0, str(x))
    rows_ = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()]
    assert sorted(rows_, key=key) == sorted(brute(docs, items, options.get("window", 13)), key=key)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got.collect())


def test_against_brute_force(spark):
    docs, rnd = rows(), random.Random(4)
    texts = [t for _, t in docs if t and len(t) > 50]
    items = [(i, " ".join(rnd.choice(texts).split()[rnd.randrange(20):][:rnd.randrange(1, 30)])) for i in range(12)]
    items += [(3, items[0][1]), (None, items[1][1]), (90, None), (91, "... ,"), (92, "unseen word here"), (93, "word")]
    check(spark, docs, items, shard_bytes=700)
    check(spark, docs, items, window=4)
    check(spark, docs, items, block_bytes=3_000, shard_bytes=5_000)  # the phrases in several blocks
    check(spark, docs, [(90, None)])
    check(spark, docs, [(1, "the word word")] * 2)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert decontaminate.contamination(documents(spark), bench).where("n_hit > 0 or contaminated").count() == 0


def test_index_ranks_and_order():
    rng = np.random.default_rng(2)
    for n, sigma in ((1, 2), (50, 2), (400, 5), (3000, 40)):
        text = np.append(rng.integers(0, sigma, n), 0)
        order = decontaminate.suffix_array(np.where(text == 0, np.cumsum(text == 0) - 1, (text == 0).sum() + text))
        index = decontaminate.ShardIndex(text, sigma)
        assert np.array_equal(np.sort(order), np.arange(n + 1))
        inside = np.flatnonzero(text[order] > 0)
        assert np.array_equal(index.locate(inside), order[inside])
        for c in range(sigma):
            at = rng.integers(0, n + 2, 20)
            assert np.array_equal(index.ranks.rank(np.full(20, c), at), [(index.bwt[:a] == c).sum() for a in at])


def test_many_blocks_of_phrases(spark, monkeypatch):
    """Phrases of one document lie in different blocks and overlap there; a phrase has more items than a row holds."""
    monkeypatch.setattr(decontaminate, "ITEMS_TOGETHER", 3)
    monkeypatch.setattr(decontaminate, "WINDOWS_TOGETHER", 2)
    words_ = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(words_[i:i + 16])) for i in range(0, 40, 5)] + [(100 + i, "common short phrase") for i in range(12)]
    docs = [(1, " ".join(words_)), (2, "a common short phrase " + " ".join(words_[7:30])), (3, None), (3, "nothing here"),
            (None, " ".join(words_[20:50])), (2, "a common short phrase " + " ".join(words_[7:30]))]
    table = decontaminate.phrase_table(spark.createDataFrame(items, "item_id bigint, text string"), 13, "item_id", "text").collect()
    assert len({bytes(r.p) for r in table}) < len(table) and sum(len(r["items"]) for r in table) == 8 * 4 + 12
    check(spark, docs, items, block_bytes=400)
    check(spark, docs, items)
