"""Readable tables of scored flights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from latewing.functions.casts import fill_round_int
from latewing.functions.labels import mapped
from latewing.functions.text import clock
from latewing.operators.ranking import confident_true_positives
from latewing.operators.sampling import sample_n
from latewing.schema import MONTH_NAMES, OUTCOME_NAMES, WEEKDAY_NAMES


def readable(scored: DataFrame) -> DataFrame:
    """Outcome names, rounded percentage and match mark."""
    return scored.withColumns({
        "actual_label": mapped(F.col("label").cast("int"), OUTCOME_NAMES),
        "predicted_label": mapped(F.col("prediction").cast("int"), OUTCOME_NAMES),
        "delay_prob_pct": F.round(F.col("p") * 100, 1),
        "is_match": F.col("label") == F.col("prediction"),
    })


def correct_delays(
    scored: DataFrame, key: Sequence[str], p_min: float = 0.6, n: int = 15, seed: int = 42
) -> DataFrame:
    """Confidently predicted real delays with formatted times.

    Scored rows keep their flight columns, so no join back on a non-unique key is needed.
    """
    picked = sample_n(confident_true_positives(scored, p_min), n, key, seed)
    return picked.select(
        mapped("month", MONTH_NAMES).alias("month_name"), "day_of_month",
        mapped("day_of_week", WEEKDAY_NAMES).alias("weekday"), F.col("op_unique_carrier").alias("airline"),
        F.col("origin").alias("from_airport"), F.col("dest").alias("to_airport"), "distance",
        clock("crs_arr_time").alias("sched_arrival"), clock("arr_time").alias("real_arrival"),
        fill_round_int("arr_delay").alias("delay_min"), F.round(F.col("p") * 100, 1).alias("confidence_pct"),
        F.col("label").cast("int").alias("label"))
