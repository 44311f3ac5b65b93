"""Neighbours from bucketed projections against exact ones; outlier factors against their definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from latewing.operators import neighbours


def points(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "flight_id long, x array<double>").repartition(4)


def exact(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return near, np.take_along_axis(d, near, axis=1)


@pytest.mark.parametrize("make", ["cloud", "clusters"])
def test_recall(spark, make):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8)) if make == "cloud" else np.concatenate([rng.normal(size=(1000, 8)) * s + c for s, c in ((0.1, 0), (1.0, 5), (3.0, -9))])
    got = neighbours.nearest(points(spark, x), 8, 10, size=400).groupBy("flight_id").agg(F.collect_set("neighbour").alias("n")).collect()
    near, _ = exact(x, 10)
    recall = np.mean([len(set(r.n) & set(near[r.flight_id].tolist())) / 10 for r in got])
    assert len(got) == 3000 and recall >= 0.9, recall


def test_buckets_are_bounded_even_for_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 3))
    x[:300] = x[0]                       # a third of all flights are alike
    sizes = neighbours.buckets(points(spark, x), 3, size=50, trees=2).groupBy("tree", "level", "node").count().collect()
    assert max(r["count"] for r in sizes) <= 50 and sum(r["count"] for r in sizes) == 1800
    alike = neighbours.nearest(points(spark, x), 3, 5, size=50, trees=2).where("flight_id < 300").agg(F.max("distance"), F.count(F.lit(1))).first()
    assert tuple(alike) == (0.0, 1500)


def test_outlier_factor(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(80, 2)), [[9.0, 9.0], [0.0, 0.0], [0.0, 0.0]]])
    near, d = exact(x, 5)
    far = d[:, -1]
    density = 5 / np.maximum(np.maximum(d, far[near]).sum(axis=1), 1e-9)
    want = density[near].mean(axis=1) / density
    got = {r.flight_id: r for r in neighbours.outlier_factors(neighbours.nearest(points(spark, x), 2, 5)).collect()}
    assert all(abs(got[i].lof - want[i]) < 1e-9 and abs(got[i].k_distance - far[i]) < 1e-12 for i in range(len(x)))
    assert max(got.values(), key=lambda r: r.lof).flight_id == 80


def test_incomplete_flights_keep_a_row(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i)) for i in range(30)] + [(99, None, 1.0)], "flight_id long, a double, b double")
    got = {r.flight_id: r for r in neighbours.local_outliers(rows, ["a", "b"], 3).collect()}
    assert len(got) == 31 and got[99].lof is None and len(got[3].neighbours) == 3
