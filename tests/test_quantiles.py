"""Quantiles by narrowing ranges: any values, no exchange of values, bounded rounds; ranks by sketches."""

import bisect
import math
import random

import pytest
from pyspark.sql import functions as F

from latewing.operators import quantiles
from latewing.operators.quantiles import _bin, bin_counts, daily_sketches, exact_quantiles, sketched_rank, values_of

PS = {"p1": 0.01, "q1": 0.25, "median": 0.5, "p99": 0.99, "all": 1.0}


def expected(values):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    return [v[max(1, len(v) - math.floor(float(len(v)) - p * len(v))) - 1] for p in PS.values()] if v else None


def hard(seed):
    """Ties, spans beyond a double, infinities, values next to each other, NULL and NaN."""
    rnd = random.Random(seed)
    tiny = [math.nextafter(1.0, 2.0), 1.0, math.nextafter(1.0, 0.0), 5e-324, -5e-324, 0.0, -0.0]
    return [rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1) * 10.0 ** rnd.randrange(-6, 6), 7.0, 7.0, 1.7e308, -1.7e308, math.inf, -math.inf, *tiny, None, math.nan])
            for _ in range(500)]


@pytest.mark.parametrize("bins", [16, None])
def test_any_values(spark, bins):
    data = {"hard": hard(1), "same": [3.0] * 50, "one": [2.0], "inf": [math.inf, -math.inf, 1.0], "none": [None, math.nan]}
    rows = [(k, v) for k, some in data.items() for v in some]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: [r[p] for p in PS] for r in exact_quantiles(df, ["x"], PS, ["g"], bins=bins).collect()}
    assert got == {k: e for k, v in data.items() if (e := expected(v)) is not None}
    whole = exact_quantiles(df, ["x"], PS, bins=bins).collect()
    assert [[r[p] for p in PS] for r in whole] == [expected([v for _, v in rows])]
    assert exact_quantiles(df.where("g = 'none'"), ["x"], PS).count() == 0 == exact_quantiles(df.where("g = 'none'"), ["x"], PS, ["g"]).count()


def test_bins_never_fall(spark):
    v = sorted({x for x in hard(2) if x is not None and not math.isnan(x)})
    df = spark.createDataFrame([(x,) for x in v], "x double").coalesce(1)
    for bins in (2, 64, 1024):
        got = [r[0] for r in df.sort("x").select(_bin(F.col("x"), F.lit(v[0]), F.lit(v[-1]), bins)).collect()]
        assert got == sorted(got) and got[0] < got[-1]


def test_values_are_not_exchanged(spark):
    """Tasks send counted bins: below every exchange stands a partial count, and no table is sorted."""
    values = values_of(spark.range(0, 20_000, 1, 8).select(F.rand(1).alias("x")), ["x"])
    plan = bin_counts(values, [{"column": "x", "lo": 0.1, "hi": 0.9}, {"column": "x", "lo": 0.0, "hi": 0.2}], 64)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    below = [lines[i + 1] for i, x in enumerate(lines) if "Exchange" in x]
    assert below and all("HashAggregate" in x and "partial_count" in x for x in below) and "Sort" not in plan
    assert "GreaterThanOrEqual(value,0.0)" in plan.replace(" ", "") or "PushedFilters: [Or" in plan


def test_sketched_rank(spark):
    rnd = random.Random(3)
    v = [rnd.expovariate(1) if rnd.random() > 0.3 else 5.0 for _ in range(5000)]
    df = spark.createDataFrame([(i % 7, x) for i, x in enumerate(v)], "day int, x double")
    sketches = daily_sketches(df, "x", F.col("day"))
    assert sketches.count() == 7
    got = sketched_rank(df, "x", sketches).collect()
    s = sorted(v)
    assert all(abs(r.pct_rank - bisect.bisect_left(s, r.x) / (len(v) - 1)) < 0.01 for r in got)


def test_quantiles_of_a_group_share_their_counts(spark, monkeypatch):
    """The first round counts a group's bins once, however many quantiles are asked for."""
    rows = [(k, float(rnd)) for k in ("a", "b", None) for rnd in random.Random(4).sample(range(10_000), 300)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    rounds = []
    cut = quantiles.left_lookup

    def seen(fact, dim, *args, **kw):
        if "bin" in fact.columns:
            rounds.append(fact.count())
        return cut(fact, dim, *args, **kw)

    monkeypatch.setattr(quantiles, "left_lookup", seen)
    got = {r.g: [r[p] for p in PS] for r in exact_quantiles(df, ["x"], PS, ["g"], bins=16).collect()}
    assert got == {k: expected([x for g, x in rows if g == k]) for k in ("a", "b", None)}
    assert rounds and rounds[0] <= 3 * 18
