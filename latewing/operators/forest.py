"""Probabilities of a trained forest for batches of rows: its nodes as flat arrays, all rows of a batch one step down a tree at a time."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


@dataclass
class Nodes:
    """All trees' nodes, one tree after the other, a tree's by level and siblings side by side. A leaf is its own child, so rows that have arrived stay."""

    cuts: list[np.ndarray]  # of each feature, all thresholds that occur: a value's code is the number of those below it
    feature: np.ndarray
    cut: np.ndarray         # place of the threshold; a row goes right if its code is larger. No code is larger than a leaf's
    left: np.ndarray        # left child's place in its tree
    shares: np.ndarray      # of both classes among a node's training rows
    roots: np.ndarray
    depths: np.ndarray

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Sums of the leaves' shares over the trees in their order, as the model adds them, for the rows of ``x``."""
        n, width = x.shape
        codes = np.empty((n, width), self.cut.dtype)
        for f, cut in enumerate(self.cuts):
            codes[:, f] = np.searchsorted(cut, x[:, f])
        codes, first, out = codes.ravel(), np.arange(n, dtype=np.int64) * width, np.zeros((n, 2))
        node, at = np.empty(n, np.int64), np.empty(n, np.int64)
        own, cut, right = np.empty(n, codes.dtype), np.empty(n, codes.dtype), np.empty(n, bool)
        for root, end, depth in zip(self.roots, np.append(self.roots[1:], len(self.left)), self.depths, strict=True):
            feature, cuts, left = self.feature[root:end].astype(np.int64), self.cut[root:end], self.left[root:end].astype(np.int64)
            node[:] = 0
            for _ in range(depth):      # places are in range: clipping only spares their check
                feature.take(node, out=at, mode="clip")
                np.add(at, first, out=at)
                codes.take(at, out=own, mode="clip")
                cuts.take(node, out=cut, mode="clip")
                np.greater(own, cut, out=right)
                left.take(node, out=at, mode="clip")
                np.add(at, right, out=node)
            out += self.shares[root:end].take(node, axis=0)
        return out


def saved_stage(spark: SparkSession, path: str) -> dict:
    """What the files of the pipeline at ``path`` say of its only stage."""
    return json.loads(spark.read.text(f"{path}/stages/*/metadata").first()[0])


def saved_nodes(spark: SparkSession, path: str, uid: str) -> DataFrame:
    """The node table of a forest that was saved as a stage of the pipeline at ``path``."""
    split = F.col("nodeData.split")
    return spark.read.parquet(f"{path}/stages/*_{uid}/data").select(
        F.col("treeID").alias("tree"), "nodeData.id", F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        F.get("nodeData.impurityStats", F.lit(0)).alias("n0"), F.get("nodeData.impurityStats", F.lit(1)).alias("n1"),
        (split["numCategories"] != -1).alias("listed"))


def read_nodes(spark: SparkSession, path: str, uid: str, width: int) -> Nodes:
    """Arrays of a saved forest of two classes on ``width`` numbers. The model's size is bounded by its number of trees and their depth."""
    t = saved_nodes(spark, path, uid).toArrow().sort_by([("tree", "ascending"), ("id", "ascending")])
    tree, left, right = (t[c].to_numpy().astype(np.int64) for c in ("tree", "left", "right"))
    inner = left >= 0
    if (t["listed"].to_numpy(zero_copy_only=False).astype(bool) & inner).any():
        raise ValueError("splits by lists of categories are not handled")
    roots = np.flatnonzero(np.diff(tree, prepend=-1))
    first = np.repeat(roots, np.diff(roots, append=len(tree)))
    left, right = np.where(inner, first + left, -1), np.where(inner, first + right, -1)
    level, depths, levels = roots, np.zeros(len(roots), np.int64), [roots]
    step = 0
    while len(level := level[inner[level]]):
        step += 1
        depths[np.searchsorted(roots, level, side="right") - 1] = step
        level = np.stack([left[level], right[level]], 1).ravel()
        levels.append(level)
    order = np.concatenate(levels)
    order = order[np.argsort(tree[order], kind="stable")]
    place = np.empty(len(tree), np.int64)
    place[order] = np.arange(len(order))
    counts = np.stack([t["n0"].to_numpy(), t["n1"].to_numpy()], 1).astype(np.float64)
    total = (counts[:, 0] + counts[:, 1])[:, None]
    shares = np.divide(counts, total, out=np.zeros_like(counts), where=total != 0)
    feature, threshold = np.where(inner, t["feature"].to_numpy(), 0), t["threshold"].to_numpy(zero_copy_only=False).astype(np.float64)
    cuts = [np.unique(threshold[inner & (feature == f)]) for f in range(width)]
    short = max((len(c) for c in cuts), default=0) < np.iinfo(np.uint16).max
    cut = np.full(len(tree), np.iinfo(np.uint16 if short else np.int32).max, np.uint16 if short else np.int32)
    for f, c in enumerate(cuts):
        own = inner & (feature == f)
        cut[own] = np.searchsorted(c, threshold[own])
    child = np.where(inner, place[np.where(inner, left, 0)], place) - first
    return Nodes(cuts, feature[order].astype(np.int8 if width < 128 else np.int32), cut[order], child[order].astype(np.int32), shares[order], roots, depths)


def voted(spark: SparkSession, nodes: Nodes):
    """A function of an array of features: the two classes' votes. The arrays reach an executor once, not with every task.

    Called not deterministic, so that filters on its result are not pushed below it, which would run all trees again for each condition.
    """
    sent = spark.sparkContext.broadcast(nodes)

    @F.arrow_udf("array<double>")
    def votes(features):
        import pyarrow as pa

        values = features.flatten().to_numpy(zero_copy_only=False)
        n = len(features)
        out = sent.value.votes(values.reshape(n, -1)) if n else np.zeros((0, 2))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2, dtype=np.int32)), pa.array(out.ravel()))

    return votes.asNondeterministic()


def decided(votes: Column) -> tuple[Column, Column]:
    """Prediction (a tie is the first class) and probability of the second class."""
    a, b = F.get(votes, F.lit(0)), F.get(votes, F.lit(1))
    return F.when(b > a, 1).otherwise(0).cast("int"), F.when(a + b != 0, b / (a + b)).otherwise(b)
