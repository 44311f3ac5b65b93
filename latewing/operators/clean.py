"""Casting, filling, filtering and capping of flight rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from latewing.functions import casts
from latewing.operators.quantiles import approx_quantiles, exact_quantiles, one_row


def _present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    have = {c.lower() for c in df.columns}
    return [c for c in cols if c.lower() in have]


def cast_int_via_double(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: casts.int_via_double(c) for c in _present(df, cols)})


def cast_int_direct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: casts.int_direct(c) for c in _present(df, cols)})


def cast_double_safe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: casts.double_or_null(c) for c in _present(df, cols)})


def col_drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def col_rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def col_select_features(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str, extra: Sequence[str] = ()
) -> DataFrame:
    return df.select(*numeric, *categorical, target, *extra)


def fill_null_const(df: DataFrame, cols: Sequence[str], value=0) -> DataFrame:
    return df.na.fill(value, subset=_present(df, cols))


def drop_null_any(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def drop_null_subset(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop("any", subset=list(cols))


def filter_operated_strict(df: DataFrame) -> DataFrame:
    """Neither cancelled nor diverted; an unknown flag drops the row."""
    return df.where((F.col("cancelled") == 0) & (F.col("diverted") == 0))


def filter_operated_lenient(df: DataFrame) -> DataFrame:
    """Neither cancelled nor diverted; an unknown flag counts as 0."""
    zero = F.lit(0)
    return df.where((F.coalesce("cancelled", zero) == 0) & (F.coalesce("diverted", zero) == 0))


def filter_valid_label(df: DataFrame, target: str = "arr_del15") -> DataFrame:
    return df.where(F.col(target).isNotNull() & F.col(target).isin(0, 1))


def coalesce_delay(df: DataFrame, new: str, raw: str, out: str) -> DataFrame:
    """The non-negative delay, or the signed one where that is missing."""
    return df.withColumn(out, F.coalesce(new, raw))


def clip_p99(df: DataFrame, cols: Sequence[str], p: float = 0.99, accuracy: int | None = None, fill: bool = True,
             measured: DataFrame | None = None) -> DataFrame:
    """Add ``<col>_clipped``, capped at a percentile of the column, or of that column of ``measured``, the same rows by a shorter way.

    The percentile is exact unless ``accuracy`` asks for the sketch. With ``fill`` NULL counts as 0 both for the
    percentile and in the output; without it NULL stays NULL.
    """
    measured = df if measured is None else measured
    if fill:
        df, measured = (x.na.fill(0, subset=list(cols)) for x in (df, measured))
    if accuracy is None:
        cap = one_row(exact_quantiles(measured, cols, {"q": p}), cols, "q")
    else:
        cap = measured.agg(F.struct(*[F.percentile_approx(c, float(p), accuracy).alias(c) for c in cols]).alias("q"))
    capped = df.withColumn("_q", cap.scalar())
    return capped.withColumns({
        f"{c.removesuffix('_new')}_clipped": F.when(F.col(c) > F.col(f"_q.{c}"), F.col(f"_q.{c}")).otherwise(F.col(c))
        for c in cols
    }).drop("_q")


def filled_delays(flights: DataFrame) -> DataFrame:
    df = coalesce_delay(flights, "arr_delay_new", "arr_delay", "arr_delay_min")
    df = coalesce_delay(df, "dep_delay_new", "dep_delay", "dep_delay_min")
    return fill_null_const(df, ["arr_delay_new", "dep_delay_new", "arr_delay_min", "dep_delay_min"], 0)


def clean_flights(flights: DataFrame, accuracy: int | None = None, measured: DataFrame | None = None) -> DataFrame:
    """The cleaning chain: coalesce, fill with 0, cap both delays; the caps are those of ``measured``, the same rows, where that is given."""
    return clip_p99(filled_delays(flights), ["arr_delay_new", "dep_delay_new"], accuracy=accuracy, fill=False,
                    measured=None if measured is None else filled_delays(measured))


def approx_p99(df: DataFrame, column: str, accuracy: int = 10000) -> DataFrame:
    return approx_quantiles(df, column, {"p99": 0.99}, accuracy)
