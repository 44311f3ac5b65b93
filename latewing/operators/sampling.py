"""Samples and splits that do not depend on how the data is partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from latewing.functions.buckets import key_text, md5_bucket, md5_rank_text

GRAIN = 10_000


def _cut(fraction: float) -> int:
    return round(fraction * GRAIN)


def sample_fraction(df: DataFrame, fraction: float, key: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Bernoulli sample; by a stable key when one is given, else by Spark's generator."""
    if key is None:
        return df.sample(False, fraction, seed)
    return df.where(md5_bucket(key_text(*key), seed, GRAIN) < _cut(fraction))


def sample_stratified(
    df: DataFrame, by: Sequence[str], fraction: float, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """The same share of every stratum; a NULL stratum is a stratum like others."""
    return df.where(md5_bucket(key_text(*by, *key), seed, GRAIN) < _cut(fraction))


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), the first of a seeded shuffle."""
    text = key_text(*key)
    return df.orderBy(md5_rank_text(text, seed), text).limit(n)


def sample_limit(df: DataFrame, fraction: float, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """First ``n`` rows, in key order, of a fraction."""
    return sample_fraction(df, fraction, key, seed).orderBy(*key).limit(n)


def split_random(
    df: DataFrame, share: float = 0.8, key: Sequence[str] | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Disjoint and complete train and test parts."""
    if key is None:
        train, test = df.randomSplit([share, 1 - share], seed)
        return train, test
    bucket = md5_bucket(key_text(*key), seed, GRAIN)
    return df.where(bucket < _cut(share)), df.where(bucket >= _cut(share))


def split_time(df: DataFrame, ts: str, cut) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(ts) < F.lit(cut)), df.where(F.col(ts) >= F.lit(cut))
