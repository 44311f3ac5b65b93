from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from latewing.llm import whitening

KIND = "vec_id bigint, embedding array<double>, label int, k int, x string, d int, n int, component int"


def table(spark, data, parts=3):
    return spark.createDataFrame([(i, v, None, 1, "clash", 2, 3, 4) for i, v in data], KIND).repartition(parts)


def exact(vectors):
    """The integers, their sums, and the covariance by exact arithmetic."""
    x = [[int(np.floor(1024.0 * c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - s[j] for j in range(d)] for r in x]
    big = np.array(y, object)
    v = big.T @ big
    return x, n, s, y, np.array([[float(Fraction(int(c), n ** 3)) for c in row] for row in v])


def check(spark, data, count=8):
    d = max({len(v) for _, v in data if v}, key=lambda m: (sum(len(v) == m for _, v in data if v), m))
    good = [(i, v) for i, v in data if v and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    x, n, s, y, cov = exact([v for _, v in good])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    k = int((e[:count] > 64 * whitening.EPS * d * e[0]).sum())
    got = whitening.components(table(spark, data), count=count).collect()
    assert len(got) == len(good) * k
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert max(r.identity_error for r in got) < 1e-4 and max(r.residual for r in got) < 1e-12
    deviation = {}
    for (i, _), r in zip(good, y):
        deviation.setdefault(i, set()).add(sum(c * c for c in r))
    for r in got:
        assert r.deviation in deviation[r.vec_id]
    for j in range(k):
        mine = sorted((r.vec_id is None, r.vec_id or 0, r.whitened) for r in got if r.component == j + 1)
        assert all(abs(r.explained / (e[j] / np.trace(cov)) - 1) < 1e-9 + 1e3 * whitening.EPS * e[0] / e[j] for r in got if r.component == j + 1)
        gap = min(abs(e[j] - e[m]) for m in range(d) if m != j) if d > 1 else e[0]
        if gap > 1e-6 * e[0]:
            p = (np.array(y, object).astype(float) / n) @ q[:, j] / np.sqrt(e[j])
            best = min(np.abs(np.array([m[2] for m in mine]) - np.array(
                [c for *_, c in sorted((i is None, i or 0, sign * c) for (i, _), c in zip(good, p))])).max() for sign in (1, -1))
            assert best < 1e-7 + 1e4 * whitening.EPS * e[0] / gap
    return got


def planted(n, d, spectrum, seed=3):
    rnd = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rnd.normal(size=(d, d)))
    return (rnd.normal(size=(n, d)) * np.sqrt(spectrum)) @ q.T


def test_against_exact_covariance(spark, sf):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(spark, data)


@pytest.mark.parametrize("spectrum", [
    np.geomspace(1e4, 1e-3, 24), np.array([100.0] * 3 + [99.9] * 3 + [1.0] * 18), np.ones(24), np.array([1e5, 1e4] + [1e-4] * 22)])
def test_spectra(spark, spectrum):
    check(spark, list(enumerate(planted(400, 24, spectrum).tolist())))


def test_odd_rows(spark):
    v = planted(60, 5, np.arange(1.0, 6.0)).tolist()
    data = list(enumerate(v)) + [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("inf")] + [0.0] * 4),
                                 (105, [1.0, 2.0]), (0, v[0]), (0, v[0]), (None, v[1]), (None, None)]
    got = check(spark, data)
    assert {r.vec_id for r in got} == {*range(60), None}


def test_large_entries_stay_exact(spark):
    v = (planted(40, 3, np.array([9.0, 4.0, 1.0])) * 1e9).tolist()
    got = whitening.components(table(spark, list(enumerate(v)))).collect()
    _, n, s, y, _ = exact(v)
    want = {i: sum(c * c for c in r) for i, r in enumerate(y)}
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in got) and len(got) == 120
    assert whitening.components(table(spark, [(1, [1e300, 0.0]), (2, [0.0, -1e300])])).count() == 2


def test_no_direction(spark):
    assert whitening.components(table(spark, [])).count() == 0
    assert whitening.components(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.components(table(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    line = whitening.components(table(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    kinds = T.StructType([T.StructField("vec_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    named = spark.createDataFrame([(c, [float(i), float(i * i % 5)]) for i, c in enumerate("abcdef")], kinds)
    assert {r.vec_id for r in whitening.components(named).collect()} == set("abcdef")


def test_pairs_without_spark():
    rnd = np.random.default_rng(1)
    for d, k in ((1, 8), (3, 8), (40, 8), (300, 8), (300, 1)):
        q, _ = np.linalg.qr(rnd.normal(size=(d, d)))
        e = np.sort(rnd.exponential(size=d))[::-1]
        a, calls = (q * e) @ q.T, []
        values, vectors, residuals = whitening.leading_pairs(lambda w: calls.append(w.shape) or a @ w, d, k)
        m = min(k, d)
        assert np.allclose(values, e[:m], rtol=1e-12) and np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-13 and residuals.max() < 1e-13
        assert len(calls) < 150, (d, k, len(calls))


def test_minres_solves():
    rnd = np.random.default_rng(2)
    m = rnd.normal(size=(30, 30))
    a, b = m + m.T, rnd.normal(size=(30, 3))
    b[:, 1] = 0
    x = whitening.minres(lambda w: a @ w, b, 60, 1e-12)
    assert np.abs(a @ x - b).max() < 1e-7 and not x[:, 1].any()
