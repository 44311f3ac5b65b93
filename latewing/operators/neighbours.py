"""Nearest neighbours and local outlier factors.

Flights are dealt into buckets of bounded size by several trees of random projections: a bucket that is too large is cut at sketched
quantiles of the next projection, and equal values are dealt by a hash, so a point that half the fleet shares can't fill a bucket.
Inside a bucket neighbours are exact, in numpy; a flight keeps the nearest of all its buckets. Up to ``size`` flights there is one
bucket, and the neighbours are exact altogether.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from latewing.operators.anomaly import standardise, with_incomplete
from latewing.operators.joins import left_lookup
from latewing.session import cut_lineage

BUCKET = 2048               # flights compared with one another
TREES = 8
FAN = 4                     # parts of a bucket that is too large


def _projected(directions: np.ndarray) -> Column:
    """The row's vector along the direction of its tree."""
    own = F.get(F.array(*[F.array(*[F.lit(float(c)) for c in d]) for d in directions]), F.col("tree"))
    return reduce(lambda a, b: a + b, [F.col("x")[i] * own[i] for i in range(directions.shape[1])])


def buckets(points: DataFrame, dims: int, size: int = BUCKET, trees: int = TREES, seed: int = 42, fan: int = FAN) -> DataFrame:
    """``(tree, level, node, flight_id, x)``: every point once in each tree, at most ``size`` points in a node."""
    rng = np.random.default_rng(seed)
    open_ = points.select(F.explode(F.array(*map(F.lit, range(trees)))).alias("tree"), F.lit(0).cast("bigint").alias("node"), "flight_id", "x")
    open_, done, level = cut_lineage(open_, "buckets"), [], 0
    while True:
        counts = open_.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"))
        large = counts.where(F.col("n") > size)
        if large.isEmpty():
            done.append(open_.withColumn("level", F.lit(level)))
            return reduce(DataFrame.unionByName, done)
        v = _projected(rng.normal(size=(trees, dims)))
        told = left_lookup(open_, cut_lineage(counts, "bucket-sizes"), ["tree", "node"]).withColumn("v", v)
        done.append(told.where(F.col("n") <= size).select("tree", "node", "flight_id", "x").withColumn("level", F.lit(level)))
        told = told.where(F.col("n") > size)
        cuts = told.groupBy("tree", "node").agg(F.percentile_approx("v", [i / fan for i in range(1, fan)]).alias("cuts"))
        split = left_lookup(told, cut_lineage(cuts, "cuts"), ["tree", "node"])
        below, equal = (F.size(F.filter("cuts", f)) for f in (lambda c: c < F.col("v"), lambda c: c == F.col("v")))
        part = below + F.pmod(F.xxhash64("flight_id", "tree", F.lit(level)), equal + 1)
        open_ = cut_lineage(split.select("tree", (F.col("node") * fan + part).alias("node"), "flight_id", "x"), "buckets")
        level += 1


def _nearest(ids: np.ndarray, x: np.ndarray, k: int, block: int = 512) -> pd.DataFrame:
    """The ``k`` nearest others of each point, ties by id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    out = []
    for i in range(0, len(x), block):
        part = x[i:i + block]
        d = np.zeros((len(part), len(x)))
        for j in range(x.shape[1]):
            d += (part[:, j:j + 1] - x[None, :, j]) ** 2
        d[np.arange(len(part)), i + np.arange(len(part))] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :min(k, len(x) - 1)]
        own = np.repeat(np.arange(len(part)), near.shape[1])
        out.append(pd.DataFrame({"flight_id": ids[i + own], "neighbour": ids[near.ravel()], "distance": np.sqrt(d[own, near.ravel()])}))
    return pd.concat(out)


def nearest(points: DataFrame, dims: int, k: int = 10, size: int = BUCKET, trees: int = TREES, seed: int = 42) -> DataFrame:
    """``(flight_id, neighbour, distance, rank)``: up to ``k`` rows a flight. ``points`` has unique flight_id and arrays x of ``dims`` numbers."""
    kind = dict(points.dtypes)["flight_id"]
    found = buckets(points, dims, max(size, k + 1), trees, seed).groupBy("tree", "level", "node").applyInPandas(
        lambda pdf: _nearest(pdf["flight_id"].to_numpy(), np.vstack(pdf["x"].to_numpy()), k),
        f"flight_id {kind}, neighbour {kind}, distance double")
    once = found.groupBy("flight_id", "neighbour").agg(F.min("distance").alias("distance"))
    # A flight has at most trees x k candidates.
    rank = F.row_number().over(Window.partitionBy("flight_id").orderBy("distance", "neighbour"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def outlier_factors(pairs: DataFrame) -> DataFrame:
    """``(flight_id, k_distance, density, lof)`` from the neighbours of all flights.

    Density is neighbours over summed reach distances (never below 1e-9, so copies have a finite one); the factor is the mean density
    of the neighbours over the own: about 1 inside a cluster, larger outside.
    """
    far = pairs.groupBy("flight_id").agg(F.max("distance").alias("k_distance"))
    reach = pairs.join(far.select(F.col("flight_id").alias("neighbour"), "k_distance"), "neighbour").select(
        "flight_id", F.greatest("distance", "k_distance").alias("reach"))
    density = cut_lineage(reach.groupBy("flight_id").agg((F.count(F.lit(1)) / F.greatest(F.sum("reach"), F.lit(1e-9))).alias("density")), "densities")
    around = pairs.join(density.select(F.col("flight_id").alias("neighbour"), "density"), "neighbour").groupBy("flight_id").agg(
        F.avg("density").alias("_around"))
    return far.join(density, "flight_id").join(around, "flight_id").select(
        "flight_id", "k_distance", "density", (F.col("_around") / F.col("density")).alias("lof"))


def local_outliers(flights: DataFrame, cols: Sequence[str], k: int = 10, size: int = BUCKET, trees: int = TREES, seed: int = 42) -> DataFrame:
    """Nearest neighbours (ids by distance), their distance, density and outlier factor of each flight over standardised features.

    Flights that lack a feature have a row of nulls.
    """
    # A constant column says nothing; it becomes 0.
    rows = standardise(flights.select("flight_id", *[F.col(c).cast("double").alias(c) for c in cols]).na.drop(), cols)
    points = rows.select("flight_id", F.array(*cols).alias("x"))
    pairs = cut_lineage(nearest(points, len(cols), k, size, trees, seed), "neighbours")
    listed = pairs.groupBy("flight_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))), lambda p: p["neighbour"]).alias("neighbours"))
    return with_incomplete(listed.join(outlier_factors(pairs), "flight_id"), flights, cols)
