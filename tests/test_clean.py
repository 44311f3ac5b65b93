import pytest
from pyspark.sql import functions as F

from latewing.operators import aggregates as agg, clean, sampling
from latewing.operators.quantiles import approx_quantiles, exact_quantiles


@pytest.fixture(scope="module")
def delays(spark):
    return spark.createDataFrame([(i, None if i % 10 == 0 else float(i)) for i in range(1, 201)], "id int, d_new double").cache()


def test_clip_fill_and_no_fill(delays):
    plain = {x.id: x.d_clipped for x in clean.clip_p99(delays, ["d_new"], fill=False).collect()}
    filled = {x.id: x.d_clipped for x in clean.clip_p99(delays, ["d_new"]).collect()}
    assert plain[10] is None and filled[10] == 0.0
    cap = max(v for v in plain.values() if v is not None)
    assert plain[199] == cap and all(v == float(k) for k, v in plain.items() if v is not None and k < cap)
    known = sorted(i for i in range(1, 201) if i % 10)
    assert cap == float(known[-(-len(known) * 99 // 100) - 1])


def test_clip_split_way_and_sketch(delays):
    exact = clean.clip_p99(delays, ["d_new"], fill=False).agg(F.max("d_clipped")).first()[0]
    split = clean.clip_p99(delays, ["d_new"], fill=False).agg(F.max("d_clipped")).first()[0]
    sketch = clean.clip_p99(delays, ["d_new"], fill=False, accuracy=1_000_000).agg(F.max("d_clipped")).first()[0]
    assert exact == split == sketch


def test_approximate_is_close(delays):
    a = approx_quantiles(delays, "d_new", {"m": 0.5}).first().m
    b = exact_quantiles(delays, ["d_new"], {"m": 0.5}).first().m
    assert abs(a - b) <= 1


def test_filters_treat_null_flags_differently(spark):
    df = spark.createDataFrame([(0, 0), (0, None), (1, 0), (None, None)], "cancelled int, diverted int")
    assert clean.filter_operated_strict(df).count() == 1 and clean.filter_operated_lenient(df).count() == 3


def test_casts_ignore_absent_columns(spark):
    df = spark.createDataFrame([("1.0", "2")], "YEAR string, X string")
    assert clean.cast_int_via_double(df, ["YEAR", "MONTH"]).first().YEAR == 1


def test_coalesce_before_fill(spark):
    df = spark.createDataFrame([(None, 5.0), (3.0, -1.0), (None, None)], "n double, r double")
    assert [x.o for x in clean.coalesce_delay(df, "n", "r", "o").collect()] == [5.0, 3.0, None]


def test_row_deltas_are_cumulative(spark):
    df = spark.range(10)
    rows = agg.row_count_delta(df, {"a": F.col("id") >= 5, "b": F.col("id") < 7}).orderBy("step_no").collect()
    assert [(x.step, x.rows) for x in rows] == [("initial", 10), ("a", 5), ("b", 2)]


def test_empty_table_aggregates(spark):
    e = spark.createDataFrame([], "d double, label int, prediction int, p double")
    assert agg.null_audit(e, ["d"]).first().pct is None
    assert agg.summary_stats(e, "d").first().mean is None
    assert agg.pred_summary(e).first().total == 0
    assert agg.histogram(e, "d").count() == 0


def test_constant_column(spark):
    df = spark.range(20).select(F.lit(3.0).alias("a"), F.col("id").cast("double").alias("b"))
    assert agg.histogram(df, "a", 5).collect()[0]["count"] == 20
    r = {(x.a, x.b): x["corr"] for x in agg.corr_matrix(df, ["a", "b"]).collect()}
    assert r["a", "b"] is None and r["b", "b"] == pytest.approx(1.0)


def test_correlations_of_hard_columns(spark):
    """A constant that doubles can't hold, small deviations around a large mean, a null row, NaN, one row, none."""
    x = F.col("id").cast("double")
    df = spark.range(3000).select(
        F.lit(0.1).alias("c"), (x + 1e12).alias("far"), (F.lit(7.0) - 2 * x).alias("down"), F.when(F.col("id") != 5, F.col("id")).alias("n"),
        F.when(F.col("id") == 9, F.lit(float("nan"))).otherwise(x).alias("nan")).repartition(7)
    r = {(x.a, x.b): x["corr"] for x in agg.corr_matrix(df, df.columns).collect()}
    assert r["far", "down"] == pytest.approx(-1.0, abs=1e-12) and r["n", "far"] == pytest.approx(1.0, abs=1e-12)
    assert r["c", "far"] is None and r["c", "c"] is None
    assert r["nan", "far"] == pytest.approx(1.0, abs=1e-12)         # a row with NaN is not complete
    assert all(x["corr"] is None for x in agg.corr_matrix(df.limit(1), ["far", "down"]).collect())
    assert [x["corr"] for x in agg.corr_matrix(df.limit(0), ["far", "down"]).collect()] == [None] * 4


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(4000).select("id", (F.col("id") % 7).alias("g"))
    def ids(d):
        return sorted(x.id for x in d.collect())

    for make in (lambda d: sampling.sample_fraction(d, 0.2, ["id"]), lambda d: sampling.sample_n(d, 15, ["id"]),
                 lambda d: sampling.sample_stratified(d, ["g"], 0.2, ["id"])):
        assert ids(make(df.repartition(3))) == ids(make(df.repartition(8)))
    train, test = sampling.split_random(df, 0.8, ["id"])
    assert sorted(ids(train) + ids(test)) == list(range(4000)) and abs(train.count() / 4000 - 0.8) < 0.03
    null_group = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    assert sampling.sample_stratified(null_group, ["g"], 0.2, ["id"]).where("g IS NULL").count() > 0
    assert sampling.sample_n(df, 9999, ["id"]).count() == 4000
