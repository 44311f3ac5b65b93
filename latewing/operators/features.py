"""Training set and encoder: category indexes and the feature vector, fitted once and used everywhere."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from latewing.functions.casts import hash_bucket
from latewing.functions.text import period_plain
from latewing.operators import clean
from latewing.operators.ordered import known_size, running
from latewing.operators.sampling import sample_stratified
from latewing.schema import (CATEGORICAL_FEATURES, DOUBLE_FEATURES, INT_FEATURES, NUMERIC_FEATURES, TARGET)
from latewing.session import cut_lineage

def training_rows(flights: DataFrame, key: Sequence[str], fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Stratified by month, operated flights with a valid label, complete rows; ``label`` is a double."""
    feats = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
    extra = [k for k in key if k not in feats]
    # All conditions look at one row, so the hash of the sample comes last: only rows that pass the others pay for it.
    whole = clean.filter_operated_strict(clean.filter_valid_label(flights, TARGET)).na.drop("any", subset=[*feats, TARGET])
    monthly = whole.withColumn("year_month", period_plain("year", "month"))
    return sample_stratified(monthly, ["year_month"], fraction, key, seed).select(
        *feats, *extra, "year", F.col(TARGET).cast("double").alias("label"))


def typed_features(raw: DataFrame) -> DataFrame:
    """Raw text columns to typed lower-case features, by the same casts for files, batches and streams."""
    low = raw.toDF(*[c.lower() for c in raw.columns])
    low = clean.cast_int_via_double(low, INT_FEATURES)
    return clean.cast_double_safe(low, DOUBLE_FEATURES)


def complete_features(raw: DataFrame) -> DataFrame:
    """Typed rows without any missing feature."""
    return typed_features(raw).na.drop("any", subset=[*NUMERIC_FEATURES, *CATEGORICAL_FEATURES])


def prepared_features(raw: DataFrame) -> DataFrame:
    """Complete rows with the hashed codes of their categories and the feature vector: nothing is fitted, so a stream's rows are ready as they come."""
    return assembler().transform(hash_index(complete_features(raw), CATEGORICAL_FEATURES))


def category_codes(df: DataFrame, cols: Sequence[str], label: str | None = None, smoothing: float = 20.0) -> DataFrame:
    """``(column, value, count, code, rate)``: the codes of every category, as a table of any length.

    ``code`` is the frequency rank, ties by value; ``rate`` the mean label, drawn towards the overall one by ``smoothing`` rows. A row
    with a null value holds what an unseen category gets: the last code and the overall rate. One pass over ``df``.
    """
    y = F.lit(0.0) if label is None else F.col(label).cast("double")
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), y.alias("y")) for c in cols])))
    counts = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("count"), F.sum("y").alias("_y"), F.lit(1).alias("_one"), (-F.count(F.lit(1))).alias("_order"))
    counts, rows = known_size(counts, None)
    ranked = running(counts, ["column"], ["_order", "value"], {"_rank": "_one"}, {"_n": "count", "_sum": "_y"}, rows)
    overall = F.try_divide("_sum", "_n")
    seen = ranked.select("column", "value", "count", (F.col("_rank") - 1).cast("double").alias("code"),
                         ((F.col("_y") + smoothing * overall) / (F.col("count") + smoothing)).alias("rate"))
    unseen = counts.groupBy("column").agg(
        F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("count"), F.count(F.lit(1)).cast("double").alias("code"),
        F.try_divide(F.sum("_y"), F.sum("count")).alias("rate"))
    return seen.unionByName(unseen)


@dataclass
class Encoder:
    """Numbers for categories from a code table, by join, and the feature vector.

    ``by`` is the caller's choice, whatever the data's size: "code" (frequency rank) or "rate" (for trees: categories keep few bins).
    """

    codes: DataFrame
    by: str = "code"
    numeric: tuple[str, ...] = NUMERIC_FEATURES
    categorical: tuple[str, ...] = CATEGORICAL_FEATURES

    def names(self) -> list[str]:
        return [*self.numeric, *[f"{c}_indexed" for c in self.categorical]]

    @cached_property
    def unseen(self) -> dict[str, float]:
        """What an unseen category of each column gets: read once for an encoder, not for every batch."""
        return {r.column: r[self.by] for r in self.codes.where("value IS NULL").collect()}

    def coded(self, df: DataFrame) -> DataFrame:
        for c in self.categorical:
            own = self.codes.where((F.col("column") == c) & F.col("value").isNotNull()).select(
                F.col("value").alias(f"_value_{c}"), F.col(self.by).alias(f"{c}_indexed"))
            df = df.join(own, F.col(c) == F.col(f"_value_{c}"), "left").drop(f"_value_{c}").withColumn(
                f"{c}_indexed", F.coalesce(f"{c}_indexed", F.lit(self.unseen.get(c, 0.0))))
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        return assembler(self.numeric, self.categorical).transform(self.coded(df))

    def arrays(self, df: DataFrame) -> DataFrame:
        """The rows of ``transform`` with the vector as an array of doubles, which stays in generated code on its way to batches of rows."""
        whole = self.coded(df).na.drop("any", subset=self.names())
        return whole.withColumn("features", F.array(*[F.col(c).cast("double") for c in self.names()]))


def hash_index(df: DataFrame, cols: Sequence[str], n: int = 10_000) -> DataFrame:
    return df.withColumns({f"{c}_indexed": hash_bucket(c, n) for c in cols})


def assembler(numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES):
    return VectorAssembler(
        inputCols=[*numeric, *[f"{c}_indexed" for c in categorical]], outputCol="features", handleInvalid="skip")


def fit_encoder(
    df: DataFrame, by: str = "code", label: str | None = None, numeric: Sequence[str] = NUMERIC_FEATURES,
    categorical: Sequence[str] = CATEGORICAL_FEATURES,
) -> Encoder:
    """Count the categories of ``df`` and keep their codes as a written table."""
    return Encoder(cut_lineage(category_codes(df, categorical, label), "codes"), by, tuple(numeric), tuple(categorical))
