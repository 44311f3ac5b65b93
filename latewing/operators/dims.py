"""The airline dimension and the joins to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from latewing.functions.text import has_suffix, normalise_code
from latewing.operators.joins import BROADCAST_ROWS, fits_broadcast, key_filter, left_lookup


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; merged map-side, so a key with many copies is no burden."""
    first = F.min(F.struct(*[F.col(c) for c in [*order, *[k for k in keep if k not in order]]])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in keep])


def airline_dimension(codes: DataFrame) -> DataFrame:
    """``(op_unique_carrier, airline_name)``, unique by code: the row without counter suffix wins, then the name."""
    named = codes.select(
        normalise_code("code").alias("op_unique_carrier"), F.trim("description").alias("airline_name"),
        has_suffix("code").alias("had_suffix"))
    return dedup_first(named, ["op_unique_carrier"], ["had_suffix", "airline_name"], ["airline_name"])


def join_carrier_left(flights: DataFrame, dim: DataFrame | None) -> DataFrame:
    """Add ``airline_name``; a code without a name, or no dimension at all, falls back to the code."""
    if dim is None:
        return flights.withColumn("airline_name", F.col("op_unique_carrier"))
    upper = flights.withColumn("op_unique_carrier", F.upper("op_unique_carrier"))
    return left_lookup(upper, dim, ["op_unique_carrier"]).withColumn(
        "airline_name", F.coalesce("airline_name", "op_unique_carrier"))


def dq_unmatched_carrier(flights: DataFrame, dim: DataFrame) -> DataFrame:
    """Codes of the fact table that the dimension does not know."""
    codes = flights.select(F.upper("op_unique_carrier").alias("op_unique_carrier")).distinct()
    return codes.join(dim, "op_unique_carrier", "left_anti")


def join_pred_to_fact(flights: DataFrame, preds: DataFrame, keys: Sequence[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner equi-join of a list of predictions to the fact table: broadcast if measured small.

    For a longer list the fact table first loses what a Bloom filter of the list's keys rules out, before it is exchanged; AQE
    splits hot keys of the join.
    """
    if fits_broadcast(preds, max_rows):
        return flights.join(F.broadcast(preds), list(keys), "inner")
    alike = all(flights.schema[k].dataType == preds.schema[k].dataType for k in keys)
    return (flights.where(key_filter(preds, keys)) if alike else flights).join(preds, list(keys), "inner")


def join_attach_prob(left: DataFrame, preds: DataFrame, keys: Sequence[str], prob: str = "p") -> DataFrame:
    """Left join of the probability back onto a report list, on the keys it was found with."""
    return left.join(preds.select(*keys, prob), list(keys), "left")
