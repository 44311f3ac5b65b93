"""Training, saving, loading and scoring; one pipeline artefact from raw columns to probability."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from latewing.functions.labels import at_threshold, mapped
from latewing.functions.vectors import delay_probability, vec_get
from latewing.operators import grow
from latewing.operators.features import Encoder, complete_features, fit_encoder
from latewing.operators.forest import decided, read_nodes, saved_stage, voted
from latewing.schema import FRIENDLY_NAMES
from latewing.session import copy_folder, cut_lineage, run_folder

# Training parameters and the bin count of tree models.
LR_PARAMS = dict(maxIter=100, regParam=0.001, elasticNetParam=0.1)
DT_PARAMS = dict(maxDepth=15, minInstancesPerNode=5, minInfoGain=0.0, seed=42)
RF_PARAMS = dict(numTrees=50, maxDepth=15, minInstancesPerNode=5, subsamplingRate=0.8,
                 featureSubsetStrategy="sqrt", seed=42)
MAX_BINS = 400
# Memory for the statistics of one pass: with many bins the default forces a pass over the data per few nodes.
TREE_MEMORY_MB = 512
# Each row keeps the node it has reached in every tree: a pass goes one step down instead of every tree from its root, and tasks get no trees.
NODE_CACHE = dict(cacheNodeIds=True, checkpointInterval=10)
ROWS_PER_PART = 1_000_000
# Eighths of a feature tell alike rows from others.
CELL_BITS = 3


@dataclass
class Scorer:
    """From raw columns to probability: category codes, feature vector, classifier."""

    encoder: Encoder
    path: str                                       # of the saved classifier
    votes: Callable[[str], Column] | None = None    # of a forest: what its trees say to a vector, for batches of rows

    @cached_property
    def classifier(self) -> PipelineModel:
        """The model as it is read back: without the summary of its training, which would carry the session to every task. A large forest's batches of rows do without it."""
        return PipelineModel.load(self.path)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.classifier.transform(self.encoder.transform(df))


@dataclass
class Trained:
    model: Scorer
    seconds: float


def _classifier(kind: str, params: dict):
    if kind == "lr":
        return LogisticRegression(**{**LR_PARAMS, **params})
    tree = {"dt": (DecisionTreeClassifier, DT_PARAMS), "rf": (RandomForestClassifier, RF_PARAMS)}[kind]
    return tree[0](**{"maxBins": MAX_BINS, "maxMemoryInMB": TREE_MEMORY_MB, **NODE_CACHE, **tree[1], **params})


#: What stands for a category: its frequency rank in the linear model, its smoothed delay rate in trees.
ENCODING = {"lr": "code", "dt": "rate", "rf": "rate"}


def among_alike(rows: DataFrame, by: list[str], parts: int) -> DataFrame:
    """All rows in ``parts`` partitions of like size, sorted so that neighbours are alike in every column of ``by``: a Z-order of each column's eighths.

    Neighbours mostly reach the same nodes of a tree, so a task's counts come from the processor's cache; the order means nothing else.
    Rows of one cell are dealt out by a hash of all their columns, so a task that is run again finds the same rows.
    """
    depth = max(1, min(CELL_BITS, 62 // len(by)))
    cuts = rows.agg(*[F.percentile_approx(c, [k / 2**depth for k in range(1, 2**depth)], 1000) for c in by]).first()
    eighths = [sum((F.when(F.col(c) > t, 1).otherwise(0) for t in cut or []), F.lit(0)) for c, cut in zip(by, cuts, strict=True)][:62]
    cell = F.lit(0).cast("bigint")
    for bit in reversed(range(depth)):
        for e in eighths:
            cell = cell * 2 + F.shiftright(e, bit) % 2
    place = F.xxhash64(*[c for c, kind in rows.dtypes if kind != "vector"])
    placed = rows.select("features", "label", cell.alias("_cell"), place.alias("_place"))
    return placed.repartitionByRange(parts, "_cell", "_place").sortWithinPartitions("_cell", "_place").select("features", "label")


def train_models(train: DataFrame, kinds=("lr", "dt", "rf"), **params: dict) -> dict[str, Trained]:
    """Count categories once, then fit each classifier on the encoded rows; ``params`` maps a kind to overrides."""
    base = fit_encoder(train, label="label")
    # Training passes over the rows many times, so they are spread over all cores and kept; lost parts are recomputed.
    cores = train.sparkSession.sparkContext.defaultParallelism
    n = train.count()
    parts = max(cores, math.ceil(n / ROWS_PER_PART))
    out = {}
    for by in dict.fromkeys(ENCODING[k] for k in kinds):
        encoder = replace(base, by=by)
        coded = encoder.transform(train)
        encoded = coded.select("features", "label").repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for kind in (k for k in kinds if ENCODING[k] == by):
                classifier = _classifier(kind, params.get(kind, {}))
                # The library's passes over a large table's forest exchange more counts than its rows are.
                large = kind == "rf" and n > ROWS_PER_PART and grow.rules(classifier, len(encoder.names())) and two_classes(train)
                begin = time.monotonic()
                path = grown(classifier, coded, encoder.names(), parts) if large else None
                fitted = None if large else classifier.fit(encoded)
                seconds = time.monotonic() - begin
                out[kind] = Trained(scorer(encoder, path or saved(PipelineModel([fitted]), train.sparkSession), train.sparkSession), seconds)
        finally:
            encoded.unpersist()
    return {k: out[k] for k in kinds}


def two_classes(rows: DataFrame) -> bool:
    return rows.where(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).isEmpty()


def grown(classifier: RandomForestClassifier, coded: DataFrame, names: list[str], parts: int) -> str:
    """A large table's forest; its rows are dealt in order of likeness, so that a task's reach few of a tree's upper nodes."""
    plain = cut_lineage(coded.select(*[F.col(c).cast("double") for c in names], "label"), "encoded").withColumn("features", F.array(*names))
    return grow.grown(classifier, plain.select("features", "label"), among_alike(plain, names, parts), len(names))


def saved(classifier: PipelineModel, spark: SparkSession) -> str:
    path = run_folder(spark, "fitted")
    classifier.write().save(path)
    return path


def scorer(encoder: Encoder, path: str, spark: SparkSession) -> Scorer:
    """The model whose classifier was saved at ``path``."""
    last = saved_stage(spark, path)
    forest = last["class"].endswith("RandomForestClassificationModel") and last["numClasses"] == 2
    return Scorer(encoder, path, voted(spark, read_nodes(spark, path, last["uid"], last["numFeatures"])) if forest else None)


def save_model(model: Scorer, path: str) -> None:
    """The classifier, and beside it the code table with the kind of encoding."""
    e = model.encoder
    copy_folder(e.codes.sparkSession, model.path, f"{path}/classifier")
    e.codes.withColumn("by", F.lit(e.by)).write.mode("overwrite").parquet(f"{path}/codes")


def load_model(path: str) -> Scorer:
    spark = SparkSession.getActiveSession()
    codes = spark.read.parquet(f"{path}/codes")
    return scorer(Encoder(codes.drop("by"), codes.select("by").first()[0]), f"{path}/classifier", spark)


def predict(model: Scorer, df: DataFrame) -> DataFrame:
    """Input columns plus ``prediction`` (int) and ``p``; the vectors are dropped."""
    keep = [c for c in df.columns if c != "prediction"]
    if model.votes:
        prediction, p = decided(F.col("_votes"))
        return model.encoder.arrays(df).select(*keep, model.votes("features").alias("_votes")).select(
            *keep, prediction.alias("prediction"), p.alias("p"))
    out = model.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                      delay_probability("probability").alias("p"))


def decode_features(encoded: DataFrame, names: list[str], ints: list[str]) -> DataFrame:
    """Vector slots back to named columns; slots listed in ``ints`` become int."""
    cols = [vec_get("features", i).alias(n) for i, n in enumerate(names)]
    out = encoded.select(*[c for c in encoded.columns if c not in names], *cols)
    return out.withColumns({n: F.col(n).cast("int") for n in ints})


def feature_importance(spark: SparkSession, model: Scorer) -> DataFrame:
    """``(feature, name, importance, pct, rank)``; a handful of rows, one per vector slot."""
    names = model.encoder.names()
    values = model.classifier.stages[-1].featureImportances.toArray().tolist()
    order = sorted(range(len(names)), key=lambda i: (-values[i], names[i]))
    rows = [(names[i], float(values[i]), r) for r, i in enumerate(order, 1)]
    df = spark.createDataFrame(rows, "feature string, importance double, rank int")
    return df.withColumns({
        "name": F.coalesce(mapped("feature", FRIENDLY_NAMES), F.col("feature")),
        "pct": F.round(F.col("importance") * 100, 1)})


def top_importance(importance: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most important features and one row for the rest."""
    head = importance.where(F.col("rank") <= k).select("name", "importance", "rank")
    other = importance.agg(
        F.lit("Other").alias("name"),
        (F.lit(1.0) - F.sum(F.when(F.col("rank") <= k, F.col("importance")))).alias("importance"),
        F.lit(k + 1).alias("rank"))
    return head.unionByName(other)


def score_batch(model: Scorer, raw: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A new month of raw rows: cast, drop incomplete rows, predict with the saved encoder."""
    return predict(model, complete_features(raw)).withColumn("flagged", at_threshold("p", threshold))


def encoded_array(encoder: Encoder, df: DataFrame) -> DataFrame:
    return encoder.transform(df).withColumn("features_array", vector_to_array("features"))
