import hashlib
import random

import numpy as np
import pyarrow as pa

from latewing.llm import piecewise_hash
from latewing.llm.queries import QUERIES
from tests.llm.tables import documents, empty, rows


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def test_edit_distance():
    rnd = random.Random(1)
    a, b = (["".join(rnd.choice("abC") for _ in range(rnd.choice([0, 1, 5, 40, 63, 64]))) for _ in range(200)] for _ in range(2))
    assert piecewise_hash.edit_distances(a, b).tolist() == [distance(x, y) for x, y in zip(a, b)]


def test_fingerprints_follow_the_text():
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(900))
    same, near, far = text, text[:1500] + "inserted words " + text[1500:], text[::-1]
    f = piecewise_hash.fingerprints(pa.array([text, same, near, far, "", "x", "a" * 5000]))
    assert f[0] == f[1] and max(len(s) for x in f for s in x.split(":")[1:]) <= 64
    like = lambda i, j: float(piecewise_hash.likeness([f[i]], [f[j]])[0])
    assert like(0, 1) == like(4, 4) == 1 and like(0, 2) > 0.9 and like(0, 3) < 0.3 and like(0, 4) == 0 and 0 <= like(5, 6) <= 1


def expected(data):
    order = sorted([(-99 if d is None else d, t or "") for d, t in data])
    out = []
    for i, (d, t) in enumerate(order):
        after, n = order[(i + 1) % len(order)][1], len(t) // 4
        out.append((d, len(t), hashlib.sha256((t[:len(t) - n] + after[:n]).encode()).hexdigest()))
    return sorted(out)


def check(spark, data):
    got = piecewise_hash.compare_edits(documents(spark, data), batch_bytes=4000).collect()
    assert sorted((-99 if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected(data)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_successors(spark):
    check(spark, rows())
    check(spark, [(1, "abcdefgh")])
    check(spark, [(3, "ab" * 10)] * 5)
    check(spark, [(None, None)] * 3 + [(None, "abcd")])
    assert piecewise_hash.compare_edits(empty(spark)).count() == 0


def test_query(spark, sf):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op6_piecewise_hash"].run(spark, sf).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected(data)
    assert np.mean([r.near_edited for r in got]) > 0.6 and np.mean([r.near_next for r in got]) < 0.2
    texts, prints = dict(data), {r.doc_id: r.fingerprint for r in got}
    by_text = {}
    for d, t in texts.items():
        assert by_text.setdefault(t, prints[d]) == prints[d]
