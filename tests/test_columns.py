"""Edge cases of casts, labels and text functions."""

import math

import pytest
from pyspark.sql import functions as F

from latewing.functions import casts, labels, text
from latewing.functions.vectors import delay_probability, vec_get


def apply(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [x[0] for x in df.orderBy("i").select(expr.alias("o")).collect()]


def test_int_via_double(spark):
    given = ["0.00", "1.00", "1835.0", " 7 ", "", "x", None, "1.9", "-1.9", "1e12", "NaN"]
    assert apply(spark, given, "string", casts.int_via_double("v")) == [0, 1, 1835, 7, None, None, None, 1, -1, None, None]


def test_int_direct(spark):
    assert apply(spark, ["0.00", "1835.0", "1835", " 7 ", ""], "string", casts.int_direct("v")) == [None, None, 1835, 7, None]


def test_double_or_null(spark):
    assert apply(spark, ["1.5", "NaN", "x", None], "string", casts.double_or_null("v")) == [1.5, None, None, None]


def test_fill_round_half_even(spark):
    assert apply(spark, [0.5, 1.5, 2.5, None, -0.4], "double", casts.fill_round_int("v")) == [0, 2, 2, 0, 0]


def test_hash_bucket_range(spark):
    got = apply(spark, ["AA", "", None, "ZZ", "a" * 50], "string", casts.hash_bucket("v"))
    assert all(0 <= b < 10000 for b in got)
    # the smallest int would overflow abs()
    low = spark.range(1).select(F.pmod(F.lit(-(2 ** 31)), F.lit(10000)).alias("b")).first().b
    assert 0 <= low < 10000


def test_status_boundaries(spark):
    got = apply(spark, [-1.0, 0.0, 15.0, 15.01, None], "double", labels.status("v"))
    assert got == ["Early", "On-time", "On-time", "Delayed", None]


def test_season(spark):
    got = apply(spark, [12, 1, 2, 3, 8, 11, None], "int", labels.season("v"))
    assert got == ["Winter"] * 3 + ["Spring", "Summer", "Fall", None]


def test_clock(spark):
    assert apply(spark, [1835, 5, 0, None, 2400], "int", text.clock("v")) == ["18:35", "00:05", "N/A", "N/A", "24:00"]


def test_normalise_code(spark):
    got = apply(spark, ["aa (1)", " DL ", "x(2) ", "B6 (1) x"], "string", text.normalise_code("v"))
    assert got == ["AA", "DL", "X", "B6 (1) X"]


def test_periods(spark):
    df = spark.createDataFrame([(2024, 4), (2024, None), (2024, 12)], "y int, m int")
    rows = df.select(text.period_plain("y", "m").alias("a"), text.period_padded("y", "m").alias("b")).collect()
    assert [tuple(x) for x in rows] == [("2024-4", "2024-04"), (None, None), ("2024-12", "2024-12")]


def test_confidence_band_rounds_first(spark):
    got = apply(spark, [0.30, 0.70, 0.2999, 0.29, 0.71, None], "double", labels.confidence_band("v"))
    assert got == ["low", "low", "low", "high", "high", None]


def test_confusion_type_null(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (0, 1), (1, 0), (None, 1)], "y int, z int")
    got = [x[0] for x in df.select(labels.confusion_type("y", "z")).collect()]
    assert got == ["True Positive", "True Negative", "False Positive", "False Negative", None]


def test_mapped_unknown_is_null(spark):
    assert apply(spark, [1, 99, None], "int", labels.mapped("v", {1: "one"})) == ["one", None, None]


def test_nan_to_null(spark):
    assert apply(spark, [1.0, math.nan, None], "double", casts.nan_to_null("v")) == [1.0, None, None]


def test_vector_access(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense(0.2, 0.8),), (None,)], ["probability"])
    rows = df.select(delay_probability().alias("p"), vec_get("probability", 5).alias("out")).collect()
    assert [x.p for x in rows] == pytest.approx([0.8, 0.0]) and [x.out for x in rows] == [None, None]
