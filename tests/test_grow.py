"""Forests of large tables, grown in two steps, against counts made by hand and against the library's own reading of the saved model."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from latewing.operators import grow, metrics, models
from latewing.operators.forest import read_nodes
from latewing.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES

N, WIDTH = 6000, 5


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 3, N), rng.integers(-50, 50, N), rng.normal(size=N), rng.exponential(size=N) * 1e6, np.full(N, 7)], 1).astype(float)
    y = ((x[:, 2] > 0.3) ^ (x[:, 0] == 1) ^ (rng.random(N) < 0.1)).astype(float)
    return spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "features array<double>, label double").repartition(3).cache()


def forest(**more):
    return RandomForestClassifier(**{**dict(numTrees=4, maxDepth=6, minInstancesPerNode=5, subsamplingRate=0.8, maxBins=40, seed=11, featureSubsetStrategy="all"), **more})


def table(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(f"{path}/stages/*/data").select(
        "treeID", "nodeData.rawCount", F.col("nodeData.impurityStats").cast("array<bigint>"), "nodeData.split.featureIndex",
        F.round(F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)), 9), F.round("nodeData.gain", 9)).collect())


def test_nodes_split_by_counts_and_by_rows_are_the_same(spark, rows, monkeypatch):
    """Wherever the upper nodes end, and however the rows lie in blocks of the same numbers, the trees are the same."""
    one = rows.coalesce(1).cache()
    want = table(spark, grow.grown(forest(), rows, one, WIDTH))
    passes, real = [], grow._split_open
    monkeypatch.setattr(grow, "_split_open", lambda *a: passes.append(len(a[-1])) or real(*a))
    for size in (N // 3, N // 20, 0):
        monkeypatch.setattr(grow, "GROUP_ROWS", size)
        passes.clear()
        assert table(spark, grow.grown(forest(), rows, one, WIDTH)) == want and passes[0] == 4
    passes.clear()
    monkeypatch.setattr(grow, "OPEN_NODES", 5)
    monkeypatch.setattr(grow, "GROUP_ROWS", N // 6)
    assert table(spark, grow.grown(forest(), rows, one, WIDTH)) == want and max(passes) == 5


def test_every_node_holds_its_rows_and_the_best_cut(spark, rows, monkeypatch):
    """A node's counts are those of the drawn rows that reach it; no cut of any feature has a larger gain; leaves are too small, too deep, pure or merged."""
    monkeypatch.setattr(grow, "GROUP_ROWS", 900)
    est, kept = forest(), []
    real = grow.blocks
    monkeypatch.setattr(grow, "blocks", lambda *a: kept.append(a[1]) or kept.append(real(*a)) or kept[1])
    path = grow.grown(est, rows, rows, WIDTH)
    cuts, stored = kept
    r, bins, labels, blocks = grow.rules(est, WIDTH), [], [], []
    for b in stored.collect():
        labels.append(np.frombuffer(b.labels, np.uint8))
        bins.append(np.frombuffer(b.bins, np.uint16).reshape(-1, WIDTH))
        blocks.append(b.block)
    x, y = np.concatenate(bins), np.concatenate(labels)
    assert len(y) == N and [len(c) for c in cuts][0] == 2 and len(cuts[4]) == 0 and all(len(c) <= 39 for c in cuts)
    data = {(d.treeID, d.nodeData.id): d.nodeData for d in spark.read.parquet(f"{path}/stages/*/data").collect()}
    for t in range(4):
        w = np.concatenate([grow._weights(r, t, b, len(z)) for b, z in zip(blocks, labels)]).astype(int)
        assert abs(w.mean() - 0.8) < 0.05 and abs(w.var() - 0.8) < 0.08
        open_ = [(0, np.flatnonzero(w), 0)]
        while open_:
            i, at, depth = open_.pop()
            d = data.pop((t, i))
            n, n1 = w[at].sum(), w[at][y[at] == 1].sum()
            assert (d.rawCount, *d.impurityStats) == (n, n - n1, n1) and d.prediction == float(2 * n1 > n)
            assert d.impurity == pytest.approx(2 * n1 / n * (1 - n1 / n))
            if d.leftChild < 0:
                continue
            gains = []
            for f in range(WIDTH):
                for c in range(len(cuts[f])):
                    left = x[at, f] <= c
                    a, a1 = w[at][left].sum(), w[at][left & (y[at] == 1)].sum()
                    if min(a, n - a) >= 5:
                        gains.append(2 * (n1 * (n - n1) / n - a1 * (a - a1) / a - (n1 - a1) * (n - a - n1 + a1) / (n - a)) / n)
            assert depth < 6 and d.gain == pytest.approx(max(gains)) and d.gain > 0
            c = int(np.searchsorted(cuts[d.split.featureIndex], d.split.leftCategoriesOrThreshold[0]))
            left = x[at, d.split.featureIndex] <= c
            kids = data[t, d.leftChild], data[t, d.rightChild]
            assert not (kids[0].leftChild < 0 and kids[1].leftChild < 0 and kids[0].prediction == kids[1].prediction)
            open_ += [(d.leftChild, at[left], depth + 1), (d.rightChild, at[~left], depth + 1)]
    assert not data


def test_the_library_reads_and_scores_the_model(spark, rows, monkeypatch):
    """Probabilities, importances and quality as of the library's own forest; blocks and draws of features don't change that."""
    from pyspark.ml.functions import array_to_vector

    monkeypatch.setattr(grow, "GROUP_ROWS", 800)
    monkeypatch.setattr(grow, "BLOCK_ROWS", 700)
    est = forest(numTrees=60, featureSubsetStrategy="sqrt")
    rows = rows.withColumn("label", (F.col("features")[2] + F.col("features")[0] / 2 + F.col("features")[1] / 100 > 0.6).cast("double")).cache()
    vectors = rows.select(array_to_vector("features").alias("features"), "label").cache()
    path = grow.grown(est, rows, rows, WIDTH)
    mine, theirs = PipelineModel.load(path).stages[-1], est.fit(vectors)
    assert mine.getNumTrees == 60 and mine.numClasses == 2 and max(t.depth for t in mine.trees) <= 6
    assert np.allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.05)
    area = [metrics.auc_roc(m.transform(vectors).select("label", models.delay_probability("probability").alias("p"))).first()[0] for m in (mine, theirs)]
    assert area[0] == pytest.approx(area[1], abs=0.01) and area[0] > 0.9
    nodes = read_nodes(spark, path, est.uid, WIDTH)
    x = np.array([r.features.toArray() for r in vectors.collect()])
    votes = nodes.votes(x)
    assert np.allclose(votes / votes.sum(1, keepdims=True), [r.probability.toArray() for r in mine.transform(vectors).collect()])


def test_many_values_are_cut_into_equal_shares():
    rng = np.random.default_rng(5)
    x = rng.exponential(size=100_000)
    parts = [grow._shortened(p) for p in np.array_split(x, 7)]
    assert max(len(v) for v, _ in parts) <= grow.SUMMARY and sum(c.sum() for _, c in parts) == len(x)
    cuts = grow._cuts(*grow._shortened(*(np.concatenate(p) for p in zip(*parts))), 400)
    shares = np.diff(np.searchsorted(np.sort(x), cuts), prepend=0, append=len(x))
    assert len(cuts) == 399 and abs(shares / len(x) - 1 / 400).max() < 0.001
    values, counts = grow._shortened(np.array([3.0, 1.0, 3.0, -0.0, 0.0]))
    assert values.tolist() == [0.0, 1.0, 3.0] and counts.tolist() == [2, 1, 2] and grow._cuts(values, counts, 40).tolist() == [0.5, 2.0]
    assert len(grow._cuts(np.array([4.0]), np.array([9]), 40)) == 0


def test_a_large_table_is_not_trained_by_the_librarys_passes(spark, monkeypatch):
    """Above the size the forest comes from counts and grouped rows, saved and loaded like the library's; what only the library does is left to it."""
    from latewing.operators import features
    from latewing.session import run_folder

    n = 3000
    rows = spark.range(n).select(
        "id", *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(500)).cast("int").alias(c) for i, c in enumerate(NUMERIC_FEATURES)],
        *[F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias(c) for c in CATEGORICAL_FEATURES]).withColumn("label", (F.col("distance") > 200).cast("double")).cache()
    monkeypatch.setattr(models, "ROWS_PER_PART", 1000)
    asked, real = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, *a: asked.append(self) or real(self, *a))
    model = models.train_models(rows, ("rf",), rf={"maxDepth": 4, "numTrees": 5})["rf"].model
    assert not asked
    scored = models.predict(model, rows)
    assert scored.count() == n and metrics.auc_roc(scored).first()[0] > 0.9
    path = run_folder(spark, "model")
    models.save_model(model, path)
    models.save_model(model, path)
    again = models.load_model(path)
    assert models.predict(again, rows).exceptAll(scored).isEmpty() and again.classifier.stages[-1].numClasses == 2
    assert models.feature_importance(spark, again).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    models.train_models(rows, ("rf",), rf={"maxDepth": 2, "numTrees": 2, "impurity": "entropy"})
    models.train_models(rows.withColumn("label", F.col("id") % 3), ("rf",), rf={"maxDepth": 2, "numTrees": 2})
    assert len(asked) == 2 and features.fit_encoder(rows, "rate", "label").names()


def test_scoring_gets_the_vectors_rows_as_arrays(spark):
    """Arrays hold what the vectors hold, rows with a missing number are skipped alike, and rows go to the trees without passing a function of vectors."""
    from pyspark.ml.functions import vector_to_array

    from latewing.operators import features

    rows = spark.range(400).select(
        "id", *[F.when((F.col("id") + i) % 50 > 0, F.col("id") * i % 37).cast("double" if i % 2 else "int").alias(c) for i, c in enumerate(NUMERIC_FEATURES)],
        *[F.when(F.col("id") % 7 > 0, F.concat(F.lit("c"), F.col("id") % 5)).alias(c) for c in CATEGORICAL_FEATURES], (F.col("id") % 2).cast("double").alias("label"))
    rows = rows.withColumn("day_of_month", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("day_of_month")))
    train = rows.na.drop()
    enc = features.fit_encoder(train, "rate", "label")
    want = enc.transform(rows).withColumn("features", vector_to_array("features"))
    got = enc.arrays(rows)
    assert 0 < got.count() < 400 and got.select(want.columns).exceptAll(want).isEmpty() and want.exceptAll(got.select(want.columns)).isEmpty()
    model = models.train_models(train, ("rf",), rf={"maxDepth": 2, "numTrees": 2})["rf"].model
    assert "UDF" not in models.predict(model, rows)._jdf.queryExecution().optimizedPlan().toString().replace("pythonUDF", "")
