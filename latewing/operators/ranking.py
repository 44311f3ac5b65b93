"""Top-k lists; every order ends in a tie-break so that results do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from latewing.functions import labels


def top_k(df: DataFrame, by: str, ties: Sequence[str], k: int, ascending: bool = False) -> DataFrame:
    first = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return df.orderBy(first, *[F.asc(t) for t in ties]).limit(k)


def top1_per_batch(scored: DataFrame, batch: str, ties: Sequence[str]) -> DataFrame:
    """Riskiest row of each batch as a mergeable maximum: one partial result per task and batch, no sorting of a batch.

    Ties go to the smallest key; its (numeric) columns are negated for the comparison.
    """
    rest = [c for c in scored.columns if c != batch]
    order = F.struct("p", *[(-F.col(t)).alias(f"_neg_{t}") for t in ties])
    return scored.groupBy(batch).agg(F.max_by(F.struct(*rest), order).alias("r")).select(batch, "r.*")


def tail_recent(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def limit_filtered(df: DataFrame, cond: Column, order: Sequence[str], n: int) -> DataFrame:
    return df.where(cond).orderBy(*order).limit(n)


def band_confidence(
    scored: DataFrame, lo: float = 0.3, hi: float = 0.7, n: int = 15, order: Sequence[str] = ("event_id",)
) -> DataFrame:
    """First ``n`` rows per confidence band and correctness.

    The rank filter is pushed below the exchange, so each task sends at most ``n`` rows per group.
    """
    marked = scored.withColumns({
        "band": labels.confidence_band("p", lo, hi), "match": labels.correct_word("label", "prediction"),
    }).where(F.col("band").isNotNull())
    w = Window.partitionBy("band", "match").orderBy(*order)
    return marked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def confident_true_positives(scored: DataFrame, p_min: float = 0.6) -> DataFrame:
    return scored.where((F.col("label") == 1) & (F.col("prediction") == 1) & (F.col("p") > p_min))
