import hashlib
import random

import numpy as np

from latewing.llm import substring_dedup
from tests.llm.tables import documents, empty, rows


def brute(data, window):
    where = {}
    order = lambda d: -1 if d is None else d
    for d, t in data:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            g = tuple(w[i:i + window])
            where[g] = min(where.get(g, order(d)), order(d))
    out = []
    for d, t in data:
        w, gone = (t or "").encode().split(), set()
        for i in range(len(w) - window + 1):
            if where[tuple(w[i:i + window])] < order(d):
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, data, window, period, **options):
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(documents(spark, data), window, period, **options).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(brute(data, window), key=key)


def test_covers():
    for p in (*range(1, 40), 31, 64, 97):
        c = substring_dedup.difference_cover(p)
        assert {int((a - b) % p) for a in c for b in c} == set(range(p)) and max(c) < p
    assert len(substring_dedup.difference_cover(31)) == 6


def test_against_brute_force(spark):
    data = [(d, t) for d, t in rows() if len(t or "") < 20_000]
    check(spark, data, 12, 7)
    check(spark, data, 5, 31, batch_bytes=300)
    check(spark, rows(), 50, 31, batch_bytes=5000)
    rnd = random.Random(6)  # every text from few words: many repeats inside and between
    check(spark, [(rnd.randrange(30), " ".join(rnd.choice("ab") for _ in range(rnd.randrange(40)))) for _ in range(60)], 8, 5)


def test_production_parameters_on_documents(spark, sf):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, data, 50, 31)
    assert sum(x[2] for x in brute(data, 50)) > 0


def test_empty(spark):
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0
    assert np.array_equal(substring_dedup.difference_cover(1), [0])
