import numpy as np
import pytest
import xxhash

from latewing.llm import simhash
from latewing.llm.graph import components
from latewing.llm.queries import QUERIES
from tests.llm.tables import documents, empty, rows


def plain(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps):
    parent = list(range(len(fps)))
    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(fps ^ f) <= 4):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = np.array([plain(texts[i]) for i in ids], np.uint64)
    root = roots(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"].run(spark, sf).collect()}
    assert got == {d: (f"{int(f):016x}", ids[r]) for d, f, r in zip(ids, fps, root)}
    assert len(set(root)) < len(ids)


@pytest.mark.parametrize("block", [4096, 40])
def test_dense_groups_lose_no_link(spark, block):
    rng, fps = np.random.default_rng(1), set()
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    while len(fps) < 1500:
        x = int(base[rng.integers(3)])
        for k in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(k)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    signed = fps.view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in signed], "fp bigint")
    found = {r.node: r.root for r in components(simhash.links(df, block)).collect()}
    groups = {}
    for s, r in zip(signed.tolist(), roots(fps)):
        groups.setdefault(r, []).append(s)
    assert {s: min(g) for g in groups.values() for s in g if len(g) > 1} == found


def test_odd_rows(spark):
    data = rows()
    got = simhash.near_duplicates(documents(spark)).collect()
    fps = np.array([plain(t) for _, t in data], np.uint64)
    group = roots(fps)
    low = {}
    for (d, _), r in zip(data, group):
        if d is not None:
            low[r] = min(low.get(r, d), d)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted([(r.doc_id, r.fp, r.component_id) for r in got], key=key) == sorted(
        [(d, int(np.uint64(f).astype(np.int64)), low[r]) for (d, _), f, r in zip(data, fps, group)], key=key)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_chain_and_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(301)} | {(1000, 1000), (1001, 1000)}
    assert components(links.limit(0)).count() == 0
