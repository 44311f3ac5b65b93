"""Model quality from scored rows ``(label, prediction, p)``.

Ranking metrics merge equal scores first and then order only the distinct scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from latewing.operators.ordered import CHUNK_ROWS, known_size, running


def confusion(scored: DataFrame) -> DataFrame:
    return scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count"))


def weighted_metrics(scored: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 in one row, from the confusion counts."""
    zero = F.lit(0)
    sides = confusion(scored.where(F.col("label").isNotNull() & F.col("prediction").isNotNull())).select(F.inline(F.array(
        F.struct(F.col("label").cast("double").alias("cls"), F.col("count").alias("support"), zero.cast("bigint").alias("called"),
                 F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(zero).alias("tp")),
        F.struct(F.col("prediction").cast("double").alias("cls"), zero.cast("bigint").alias("support"), F.col("count").alias("called"),
                 zero.cast("bigint").alias("tp")))))
    per = sides.groupBy("cls").agg(*[F.sum(c).cast("double").alias(c) for c in ("support", "called", "tp")])
    precision = F.coalesce(F.try_divide("tp", "called"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    total = F.sum("support")
    return per.agg(
        F.try_divide(F.sum("tp"), total).alias("accuracy"),
        F.try_divide(F.sum(precision * F.col("support")), total).alias("weighted_precision"),
        F.try_divide(F.sum(recall * F.col("support")), total).alias("weighted_recall"),
        F.try_divide(F.sum(f1 * F.col("support")), total).alias("f1"))


def _by_score(scored: DataFrame) -> DataFrame:
    return scored.groupBy("p").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def auc_roc(scored: DataFrame, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Exact area under the ROC curve: the share of (positive, negative) pairs in right order, ties half."""
    scores, rows = known_size(_by_score(scored), rows, chunk_rows)
    ranked = running(scores, [], ["p"], {"below": "neg"}, rows=rows, chunk_rows=chunk_rows)
    wins = F.sum(F.col("pos").cast("double") * (F.col("below") - F.col("neg") + F.col("neg") / 2.0))
    return ranked.agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc_roc"))


def roc_pr_curve(scored: DataFrame, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One point per distinct score, the score being the threshold (p or higher counts as positive)."""
    by_score, rows = known_size(_by_score(scored).withColumn("_down", -F.col("p")), rows, chunk_rows)
    cum = running(by_score, [], ["_down"], {"tp": "pos", "fp": "neg"}, {"_p": "pos", "_q": "neg"}, rows, chunk_rows)
    return cum.select(
        F.col("p").alias("threshold"), "tp", "fp", F.try_divide("fp", "_q").alias("fpr"),
        F.try_divide("tp", "_p").alias("tpr"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        "pos")


def pr_auc(scored: DataFrame, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Average precision: precision at each threshold weighted by the recall gained there."""
    curve = roc_pr_curve(scored, rows, chunk_rows)
    return curve.agg(F.try_divide(F.sum(F.col("precision") * F.col("pos")), F.sum("pos")).alias("pr_auc"))


def binary_report(scored: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the positive class."""
    hit = F.count_if((F.col("label") == 1) & (F.col("prediction") == 1))
    called, real = F.count_if(F.col("prediction") == 1), F.count_if(F.col("label") == 1)
    return scored.agg(
        F.try_divide(hit, called).alias("precision"), F.try_divide(hit, real).alias("recall"),
        F.try_divide(2 * hit, called + real).alias("f1"))


def model_row(name: str, scored: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row ``(model, auc_roc, accuracy, weighted_precision, weighted_recall, f1, train_seconds)``."""
    return weighted_metrics(scored).select(
        F.lit(name).alias("model"), auc_roc(scored).scalar().alias("auc_roc"), "accuracy", "weighted_precision",
        "weighted_recall", "f1", F.lit(seconds).cast("double").alias("train_seconds"))


def compare_models(scored: dict[str, DataFrame], seconds: dict[str, float] | None = None) -> DataFrame:
    """All models side by side, the best by AUC marked."""
    rows = [model_row(name, df, (seconds or {}).get(name)) for name, df in scored.items()]
    table = reduce(DataFrame.unionByName, rows)
    best = table.agg(F.max_by("model", F.struct("auc_roc", "model"))).scalar()
    return table.withColumn("_best", best).withColumn("best", F.col("model") == F.col("_best")).drop("_best")


def overfit_gap(parts: dict[str, tuple[DataFrame, DataFrame]], limit: float = 5.0) -> DataFrame:
    """Training against test accuracy, gap in percentage points, flagged above ``limit``."""
    def accuracy(df: DataFrame):
        return F.avg((F.col("label") == F.col("prediction")).cast("double"))

    rows = [
        train.agg(accuracy(train).alias("train_accuracy")).select(
            F.lit(name).alias("model"), "train_accuracy", test.agg(accuracy(test)).scalar().alias("test_accuracy"))
        for name, (train, test) in parts.items()
    ]
    gap = (F.col("train_accuracy") - F.col("test_accuracy")) * 100
    return reduce(DataFrame.unionByName, rows).withColumns({"gap_points": gap, "overfit": gap > limit})
