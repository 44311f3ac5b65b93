"""Grouped and one-row aggregates over flights and scores."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from latewing.functions import labels
from latewing.functions.text import period_padded
from latewing.operators.joins import left_lookup
from latewing.operators.quantiles import exact_quantiles, quantiles_of_values, values_of
from latewing.session import cut_lineage


def _n(cond: Column | None = None) -> Column:
    return F.count(F.lit(1)) if cond is None else F.count_if(cond)


def rows_by_month(df: DataFrame) -> DataFrame:
    return df.groupBy("year", "month").agg(_n().alias("count")).orderBy("year", "month")


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[_n(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols])


def _unpivot(row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    return row.select(F.inline(F.array(*structs)))


def null_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, nulls, total, pct)`` from a single pass."""
    row = df.agg(_n().alias("_total"), *[_n(F.col(c).isNull()).alias(c) for c in cols])
    return _unpivot(row, [
        F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"), F.col("_total").alias("total"),
                 (F.col(c) * 100.0 / F.nullif(F.col("_total"), F.lit(0))).cast("double").alias("pct")) for c in cols
    ])


def show_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, type, n, nulls, null_pct, distinct)`` of chosen columns."""
    kinds = dict(df.dtypes)
    row = df.agg(
        _n().alias("_total"), *[_n(F.col(c).isNull()).alias(f"_n_{c}") for c in cols],
        *[F.count_distinct(c).alias(f"_d_{c}") for c in cols])
    return _unpivot(row, [
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col("_total").alias("n"),
                 F.col(f"_n_{c}").alias("nulls"),
                 (F.col(f"_n_{c}") * 100.0 / F.nullif(F.col("_total"), F.lit(0))).cast("double").alias("null_pct"),
                 F.col(f"_d_{c}").alias("distinct")) for c in cols
    ])


def counts_of(df: DataFrame, col: str) -> DataFrame:
    """Distribution of one column."""
    return df.groupBy(col).agg(_n().alias("count")).orderBy(col)


def max_raw_vs_clipped(df: DataFrame) -> DataFrame:
    return df.agg(
        F.max("dep_delay_min").alias("max_dep_raw"), F.max("arr_delay_min").alias("max_arr_raw"),
        F.max("dep_delay_clipped").alias("max_dep_clipped"), F.max("arr_delay_clipped").alias("max_arr_clipped"))


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def summary_stats(df: DataFrame, col: str) -> DataFrame:
    """Mean, sample deviation, minimum, quartiles and maximum in one row."""
    values = values_of(df, [col])
    quartiles = quantiles_of_values(values, QUARTILES).select(F.struct(*QUARTILES))
    base = values.agg(F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return base.withColumn("_q", quartiles.scalar()).select(
        "mean", "std", "min", *[F.col(f"_q.{q}").alias(q) for q in QUARTILES], "max")


def iqr_outliers(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Quartiles, upper fence, and the known values above it."""
    values = values_of(df, [col])
    fence = quantiles_of_values(values, {"q1": 0.25, "q3": 0.75}).select(F.struct("q1", "q3").alias("f"))
    upper = F.col("_f.q3") + k * (F.col("_f.q3") - F.col("_f.q1"))
    return (
        values.withColumn("_f", fence.scalar())
        .agg(F.max("_f.q1").alias("q1"), F.max("_f.q3").alias("q3"), _n(F.col("value") > upper).alias("outliers"), _n().alias("total"))
        .withColumn("iqr", F.col("q3") - F.col("q1"))
        .select("q1", "q3", "iqr", (F.col("q3") + k * F.col("iqr")).alias("upper"), "outliers", "total",
                (F.col("outliers") * F.lit(100.0) / F.nullif(F.col("total"), F.lit(0))).alias("pct"))
    )


def clipped_share(df: DataFrame, col: str, p: float = 0.99) -> DataFrame:
    """Rows above a percentile: count, total, percent."""
    cut = exact_quantiles(df, [col], {"q": p}).select("q").scalar()
    return df.withColumn("_q", cut).agg(
        F.max("_q").alias("cut"), _n(F.col(col) > F.col("_q")).alias("clipped"), _n().alias("total")
    ).withColumn("pct", F.col("clipped") * F.lit(100.0) / F.nullif(F.col("total"), F.lit(0)))


def delay_by_airline(df: DataFrame) -> DataFrame:
    return df.groupBy("airline_name").agg(
        F.mean("dep_delay_clipped").alias("avg_dep_delay"), F.mean("arr_delay_clipped").alias("avg_arr_delay"))


def volume_delay_by_carrier(df: DataFrame) -> DataFrame:
    return df.groupBy("op_unique_carrier").agg(
        _n().alias("flight_count"), F.mean("arr_delay_clipped").alias("avg_arr_delay"))


def share_of_total(agg: DataFrame, count_col: str = "count", dp: int = 1) -> DataFrame:
    """Percent of all rows. The groups are written once, so the total does not run the aggregate again."""
    agg = cut_lineage(agg, "groups")
    total = agg.agg(F.sum(count_col)).scalar()
    return agg.withColumn("pct", F.round(F.col(count_col) * F.lit(100.0) / total, dp))


def status_share(df: DataFrame) -> DataFrame:
    counts = (
        df.where(F.col("arr_delay").isNotNull()).groupBy(labels.status("arr_delay").alias("status"))
        .agg(_n().alias("count"))
    )
    return share_of_total(counts).orderBy(labels.status_rank("status"))


def mean_by(df: DataFrame, by: Sequence[str], col: str = "arr_delay_clipped", out: str = "avg_arr_delay") -> DataFrame:
    return df.groupBy(*by).agg(F.mean(col).alias(out))


def delay_by_month(df: DataFrame) -> DataFrame:
    return mean_by(df, ["year", "month"]).withColumn("period", period_padded("year", "month")).orderBy("year", "month")


def delay_by_season(df: DataFrame) -> DataFrame:
    return mean_by(df.withColumn("season", labels.season("month")), ["year", "season"]).orderBy("year", "season")


def pivot_month_dow(df: DataFrame) -> DataFrame:
    """Weekday by month matrix of the mean capped delay, twelve fixed columns."""
    cube = df.groupBy("day_of_week").pivot("month", list(range(1, 13))).agg(F.mean("arr_delay_clipped"))
    return cube.withColumnsRenamed({str(m): f"m{m}" for m in range(1, 13)})


def pivot_od(od: DataFrame, value: str = "avg_delay") -> DataFrame:
    """Origin by destination matrix of an already ranked, short pair table; its columns are the destinations that occur."""
    od = cut_lineage(od, "pairs")
    dests = [r.dest for r in od.select("dest").distinct().orderBy("dest").collect()]  # no more than there are ranked pairs
    return od.groupBy("origin").pivot("dest", dests).agg(F.first(value))


def matrix_cells(matrix: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """All cells of a matrix as rows, empty ones included."""
    names = [c for c in matrix.columns if c != row]
    return matrix.select(row, F.inline(F.array(*[F.struct(F.lit(c).alias(column), F.col(f"`{c}`").alias(value)) for c in names])))


def _pearson(a: str, b: str) -> Column:
    """NULL, not an error, where one of the columns is constant."""
    return F.try_divide(F.covar_samp(a, b), F.stddev(a) * F.stddev(b))


def corr_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.na.drop(subset=[a, b]).agg(_pearson(a, b).alias("corr"))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long Pearson matrix ``(a, b, corr, strength)`` over complete rows: one pass for the means, one for sums of centred products.

    Plain sums stay in generated code up to 12 columns. A constant column is centred at its value, so its deviation is exactly 0.
    """
    def pair(i: int, j: int) -> str:
        return f"_{min(i, j)}_{max(i, j)}"

    ids, rows = range(len(cols)), df.select(*cols).na.drop()
    centre = rows.agg(F.struct(*[
        F.when(F.min(c) == F.max(c), F.min(c).cast("double")).otherwise(F.mean(c)).alias(f"_{i}") for i, c in enumerate(cols)]).alias("m")).scalar()
    away = rows.select(*[(F.col(c).cast("double") - centre[f"_{i}"]).alias(f"_{i}") for i, c in enumerate(cols)])
    sums = away.agg(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(pair(i, j)) for i, j in combinations_with_replacement(ids, 2)])
    row = sums.select(*[
        F.try_divide(pair(i, j), F.sqrt(pair(i, i)) * F.sqrt(pair(j, j))).alias(pair(i, j)) for i, j in combinations_with_replacement(ids, 2)])
    cells = _unpivot(row, [
        F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.nanvl(F.col(pair(i, j)), F.lit(None)).alias("corr"))
        for i in ids for j in ids
    ])
    return cells.withColumn("strength", labels.correlation_strength("corr"))


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str, dp: int = 6) -> DataFrame:
    """``(a, corr, rank)``: a row per column, by the size of its correlation with the target; ranks are those of a short array."""
    cells = corr_matrix(df, [*cols, target]).where((F.col("b") == target) & (F.col("a") != target))
    rounded = F.round("corr", dp)
    order = F.struct(rounded.isNull().alias("none"), (-F.abs(rounded)).alias("size"), F.col("a").alias("a"), rounded.alias("corr"))
    listed = cells.agg(F.array_sort(F.collect_list(order)).alias("l"))
    return listed.select(F.posexplode("l").alias("at", "x")).select("x.a", "x.corr", (F.col("at") + 1).cast("bigint").alias("rank"))


def cardinality(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    row = df.agg(*[count(c).alias(c) for c in cols])
    return _unpivot(row, [F.struct(F.lit(c).alias("column"), F.col(c).alias("distinct")) for c in cols]).orderBy(
        F.desc("distinct"), "column")


def histogram(df: DataFrame, col: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """Equal-width bins between the column's minimum and maximum, the last one closed."""
    span = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()
    width = (F.col("_s.hi") - F.col("_s.lo")) / float(bins)
    raw = F.when(width == 0, F.lit(0)).otherwise(F.floor((F.col(col) - F.col("_s.lo")) / F.nullif(width, F.lit(0.0))))
    binned = df.where(F.col(col).isNotNull()).withColumn("_s", span).withColumn(
        "bin", F.least(raw, F.lit(bins - 1)).cast("int"))
    keys = [by, "bin"] if by else ["bin"]
    return binned.groupBy(*keys).agg(
        (F.first("_s.lo") + F.col("bin") * F.first(width)).alias("lo"),
        (F.first("_s.lo") + (F.col("bin") + 1) * F.first(width)).alias("hi"), _n().alias("count"))


def histograms(df: DataFrame, cols: Sequence[str], bins: int = 30, by: str | None = None) -> DataFrame:
    """Histograms of several columns, ``(column, [by,] bin, lo, hi, count)``: one pass for all ranges, one for all counts."""
    span = df.agg(F.struct(*[
        F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in cols]).alias("s"))
    cells = df.withColumn("_s", span.scalar()).select(*([by] if by else []), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"), F.col(f"_s.{c}.lo").alias("l"),
                 ((F.col(f"_s.{c}.hi") - F.col(f"_s.{c}.lo")) / float(bins)).alias("w")) for c in cols])))
    raw = F.when(F.col("w") == 0, F.lit(0)).otherwise(F.floor((F.col("v") - F.col("l")) / F.nullif(F.col("w"), F.lit(0.0))))
    keys = ["column", by, "bin"] if by else ["column", "bin"]
    return (
        cells.where(F.col("v").isNotNull()).withColumn("bin", F.least(raw, F.lit(bins - 1)).cast("int"))
        .groupBy(*keys, "l", "w").agg(_n().alias("count"))
        .select(*keys, (F.col("l") + F.col("bin") * F.col("w")).alias("lo"),
                (F.col("l") + (F.col("bin") + 1) * F.col("w")).alias("hi"), "count")
    )


def box_stats(df: DataFrame, by: str, col: str, k: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends and outlier count per group."""
    values = values_of(df, [col], [by])
    q = quantiles_of_values(values, QUARTILES, [by]).drop("column", "total")
    iqr = F.col("q3") - F.col("q1")
    inside = F.col("value").between(F.col("q1") - k * iqr, F.col("q3") + k * iqr)
    return left_lookup(values, q, [by], null_safe=True).groupBy(by, *QUARTILES).agg(
        F.min(F.when(inside, F.col("value"))).alias("lo"), F.max(F.when(inside, F.col("value"))).alias("hi"), _n(~inside).alias("outliers"))


def pred_type_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy(labels.confusion_type("label", "prediction").alias("prediction_type")).agg(
        _n().alias("n"), F.sum(labels.correct_flag("label", "prediction")).alias("correct"),
        F.round(F.mean("p"), 3).alias("avg_p"))


def pred_summary(scored: DataFrame) -> DataFrame:
    right = F.sum(labels.correct_flag("label", "prediction"))
    return scored.agg(_n().alias("total"), right.alias("correct"), (_n() - right).alias("incorrect"),
                      (right * F.lit(1.0) / F.nullif(_n(), F.lit(0))).alias("accuracy"))


def sample_stats(scored: DataFrame) -> DataFrame:
    """Size, percent correct and mean probability of a displayed sample, one decimal."""
    right = F.sum(labels.correct_flag("label", "prediction"))
    return scored.agg(_n().alias("n"), right.alias("correct"),
                      F.round(right * F.lit(100.0) / F.nullif(_n(), F.lit(0)), 1).alias("correct_pct"),
                      F.round(F.mean(F.round(F.col("p") * 100, 1)), 1).alias("avg_pct"))


def prob_stats(scored: DataFrame) -> DataFrame:
    return scored.agg(_n().alias("n"), F.min("p").alias("min_prob"), F.max("p").alias("max_prob"),
                      F.avg("p").alias("avg_prob"))


def row_count_delta(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """``(step_no, step, rows, pct_of_initial)``; each step's condition is added to the ones before, in one pass."""
    keep, sums = F.lit(True), [_n().alias("_s0")]
    for i, cond in enumerate(steps.values(), 1):
        keep = keep & F.coalesce(cond, F.lit(False))
        sums.append(_n(keep).alias(f"_s{i}"))
    return _unpivot(df.agg(*sums), [
        F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"_s{i}").alias("rows"),
                 (F.col(f"_s{i}") * F.lit(100.0) / F.nullif(F.col("_s0"), F.lit(0))).alias("pct_of_initial"))
        for i, name in enumerate(["initial", *steps])
    ])


def delay_rate(df: DataFrame, by: Sequence[str], label: str = "arr_del15") -> DataFrame:
    """Share of late arrivals per group, with the group's size."""
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(_n().alias("flights"), F.avg(label).alias("delay_rate"))


def delay_rate_by_airport(df: DataFrame) -> DataFrame:
    """Both ends of the leg in one pass: each leg counts once as departure and once as arrival."""
    ends = df.select("arr_del15", F.inline(F.array(
        F.struct(F.lit("origin").alias("role"), F.col("origin").alias("airport")),
        F.struct(F.lit("dest").alias("role"), F.col("dest").alias("airport")))))
    return delay_rate(ends, ["role", "airport"])
