"""Percentiles: exact ones by narrowing ranges, approximate ones from Spark's sketches.

Values are never exchanged: tasks send counts of bins, and each round looks only at the values inside the bins that hold the ranks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from latewing.operators.joins import left_lookup
from latewing.session import cut_lineage


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column, value, n)`` over the non-NULL values of several numeric columns, in one pass."""
    if len(columns) == 1:
        rows = df.select(*by, F.lit(columns[0]).alias("column"), F.col(columns[0]).cast("double").alias("value"))
    else:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
        rows = df.select(*by, F.inline(pairs))
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*by, "column", "value").agg(
        F.count(F.lit(1)).alias("n"))


def _rank(total: Column, p: float) -> Column:
    """1-based rank of the discrete quantile: the smallest rank that covers a share ``p``."""
    return F.greatest(total - F.floor(total.cast("double") - F.lit(float(p)) * total), F.lit(1))


BINS = 1024                 # bins of one round over the whole table
GROUP_BINS = 512            # bins of one round for each group
LARGEST = 1.7976931348623157e308


def values_of(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column, value)`` of the non-NULL values of several numeric columns, written once: the rounds read nothing else."""
    if len(columns) == 1:
        rows = df.select(*by, F.lit(columns[0]).alias("column"), F.col(columns[0]).cast("double").alias("value"))
    else:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
        rows = df.select(*by, F.inline(pairs))
    return cut_lineage(rows.where(F.col("value").isNotNull() & ~F.isnan("value")), "values")


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of a value between ``lo`` and ``hi``, which lie in different bins. It never falls as values rise, whatever is rounded."""
    low, high = F.greatest(lo, F.lit(-LARGEST)), F.least(hi, F.lit(LARGEST))
    wide = high - low == float("inf")
    share = F.when(wide, F.try_divide(v / 2 - low / 2, high / 2 - low / 2)).otherwise(F.try_divide(v - low, high - low))
    inner = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1))
    return F.when(v == float("-inf"), -1).when(v == float("inf"), bins).otherwise(inner).cast("int")


def bin_counts(values: DataFrame, intervals: Sequence[dict], bins: int) -> DataFrame:
    """``(i, bin, n, lo, hi)``: how many values of the i-th interval's column each of its bins holds, and their ends."""
    told = []
    for i, t in enumerate(intervals):
        lo, hi = F.lit(t["lo"]), F.lit(t["hi"])
        inside = (F.col("column") == t["column"]) & F.col("value").between(lo, hi)
        told.append(F.when(inside, F.struct(F.lit(i).alias("i"), _bin(F.col("value"), lo, hi, bins).alias("bin"))))
    some = reduce(lambda a, b: a | b, [F.col("value").between(t["lo"], t["hi"]) for t in intervals])
    rows = values.where(some).select("value", F.explode(F.array(*told)).alias("t")).where(F.col("t").isNotNull()).select("value", "t.i", "t.bin")
    return rows.groupBy("i", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def _narrow(values: DataFrame, ps: dict[str, float], bins: int) -> DataFrame:
    """Quantiles of each column by rounds: count the bins of the open intervals, go on inside the bin that holds the rank.

    A round is one pass and exchanges no more than ``bins`` rows a task and quantile. It ends when the bin holds one value. The driver
    keeps an interval for each column and quantile.
    """
    ends = values.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    found = [{"column": e.column, "name": p, "want": max(1, e.n - math.floor(float(e.n) - share * e.n)), "lo": e.lo, "hi": e.hi} for e in ends for p, share in ps.items()]
    while open_ := [t for t in found if t["lo"] < t["hi"]]:
        for c in sorted(bin_counts(values, open_, bins).collect(), key=lambda c: (c.i, c.bin)):
            t = open_[c.i]
            if "next" not in t:
                if t["want"] <= c.n:
                    t["next"] = (c.lo, c.hi)
                else:
                    t["want"] -= c.n
        for t in open_:
            t["lo"], t["hi"] = t.pop("next")
    rows = [(e.column, e.n, *(next(t["lo"] for t in found if t["column"] == e.column and t["name"] == p) for p in ps)) for e in ends]
    return values.sparkSession.createDataFrame(rows, "column string, total bigint" + "".join(f", `{p}` double" for p in ps))


def group_bin_counts(values: DataFrame, intervals: DataFrame, key: Sequence[str], bins: int) -> DataFrame:
    """``(*key, from, to, bin, n, lo, hi)``: how many values each bin of a group's intervals ``from`` .. ``to`` holds, and their ends."""
    asked = intervals.groupBy(*key).agg(F.collect_list(F.struct("from", "to")).alias("asked"))
    told = left_lookup(values, asked, key, null_safe=True).select(*key, "value", F.explode("asked").alias("t")).select(*key, "value", "t.*")
    inside = told.where(F.col("value").between(F.col("from"), F.col("to"))).withColumn("bin", _bin(F.col("value"), F.col("from"), F.col("to"), bins))
    return inside.groupBy(*key, "from", "to", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def _narrow_groups(values: DataFrame, ps: dict[str, float], by: Sequence[str], bins: int) -> DataFrame:
    """The same for the groups of ``by``, whose intervals are a table: a row for each group, column and quantile."""
    key = [*by, "column"]
    ends = cut_lineage(values.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi")), "ends")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), _rank(F.col("total"), p).cast("bigint").alias("want")) for name, p in ps.items()])
    state = ends.select(*key, "total", "lo", "hi", F.inline(wanted))
    while True:
        open_ = state.where(F.col("lo") < F.col("hi"))
        if open_.isEmpty():
            break
        # Quantiles that still share an interval, as all of a group do at first, share its counts.
        wanted = open_.groupBy(*key, "total", F.col("lo").alias("from"), F.col("hi").alias("to")).agg(F.collect_list(F.struct("name", "want")).alias("wants"))
        counts = group_bin_counts(values, wanted, key, bins)
        # At most ``bins`` rows, and two for infinite values, in a window.
        upto = F.sum("n").over(Window.partitionBy(*key, "from", "to").orderBy("bin"))
        told = left_lookup(counts.withColumn("_upto", upto), wanted, [*key, "from", "to"], null_safe=True)
        here = F.filter("wants", lambda w: (F.col("_upto") >= w["want"]) & (F.col("_upto") - F.col("n") < w["want"]))
        hit = told.select(*key, "total", "lo", "hi", (F.col("_upto") - F.col("n")).alias("_below"), F.inline(here))
        narrower = hit.select(*key, "total", "lo", "hi", "name", (F.col("want") - F.col("_below")).alias("want"))
        state = cut_lineage(state.where(F.col("lo") == F.col("hi")).unionByName(narrower), "intervals")
    return state.groupBy(*key, "total").agg(*[F.max(F.when(F.col("name") == p, F.col("lo"))).alias(p) for p in ps])


def quantiles_of_values(values: DataFrame, ps: dict[str, float], by: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """``(*by, column, total, *ps)``: discrete quantiles of a table of ``values_of``, exact whatever the values; no row where there are none."""
    return _narrow_groups(values, ps, by, bins or GROUP_BINS) if by else _narrow(values, ps, bins or BINS)


def exact_quantiles(df: DataFrame, columns: Sequence[str], ps: dict[str, float], by: Sequence[str] = (), bins: int | None = None) -> DataFrame:
    """``(*by, column, total, *ps)`` with discrete quantiles of each column."""
    return quantiles_of_values(values_of(df, columns, by), ps, by, bins)


def approx_quantiles(df: DataFrame, column: str, ps: dict[str, float], accuracy: int = 10000) -> DataFrame:
    """One row of sketch quantiles; the error is at most 1/accuracy of the row count."""
    return df.agg(*[
        F.percentile_approx(column, float(p), accuracy).alias(name) for name, p in ps.items()
    ])


def one_row(quantiles: DataFrame, columns: Sequence[str], p: str) -> DataFrame:
    """Turn ``(column, p)`` rows into one row with a field per column, for use as a scalar."""
    return quantiles.agg(F.struct(*[
        F.max(F.when(F.col("column") == c, F.col(p))).alias(c) for c in columns
    ]).alias("q"))


# --- approximate ranks ----------------------------------------------------------------------------------------------

SKETCH_SIZE = 1000          # about 0.3 % of rank error


def daily_sketches(df: DataFrame, column: str, period: Column, k: int = SKETCH_SIZE) -> DataFrame:
    """``(period, sketch)``: a mergeable quantile sketch of each period, a few kB each, to be stored and merged at will."""
    return df.groupBy(period.alias("period")).agg(F.kll_sketch_agg_double(F.col(column).cast("double"), k).alias("sketch"))


def sketched_rank(df: DataFrame, column: str, sketches: DataFrame, out: str = "pct_rank", steps: int = 1000) -> DataFrame:
    """Share of values below a row's value, in ``steps`` steps, by the sketches of all periods merged: no order of the table.

    The merged sketch gives its quantiles once; a row looks at every 32nd of them, then at the 32 in between.
    """
    shares = F.array(*[F.lit(i / steps) for i in range(1, steps)])
    cuts = sketches.agg(F.kll_merge_agg_double("sketch").alias("s")).select(F.kll_sketch_get_quantile_double("s", shares)).first()[0]
    if cuts is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    v = F.col(column).cast("double")
    block = F.size(F.filter(F.lit(cuts[31::32]), lambda c: c < v))
    rank = F.col("_block") * 32 + F.size(F.filter(F.slice(F.lit(cuts), F.col("_block") * 32 + 1, F.lit(32)), lambda c: c < v))
    return df.withColumn("_block", block).withColumn(out, F.when(v.isNotNull(), rank / F.lit(float(steps)))).drop("_block")
