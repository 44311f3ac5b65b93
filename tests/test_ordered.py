"""The split way of ordered computations gives what a plain window gives, and its pieces stay small."""

import random

import pytest
from pyspark.sql import Window, functions as F

from latewing.operators import metrics, trajectory as tr
from latewing.operators.anomaly import flight_features
from latewing.operators.ordered import running, windowed, with_chunk
from latewing.operators.quantiles import exact_quantiles

ROWS, PIECE = 3000, 100


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows belongs to one key; one key is NULL; some keys are tiny; order values repeat."""
    rng = random.Random(7)
    rows = []
    for i in range(ROWS):
        k = "hot" if i % 3 == 0 else rng.choice([None, *map(str, range(120))])
        rows.append((k, rng.randrange(40), i, rng.randrange(100)))
    return spark.createDataFrame(rows, "k string, o int, id int, v bigint").repartition(5).cache()


def as_set(df, cols):
    return sorted(map(repr, (tuple(x) for x in df.select(*cols).collect())))


def test_chunks_grow_and_stay_small(hot):
    df = with_chunk(hot, ["k", "o", "id"], ROWS, PIECE)
    sizes = [x["count"] for x in df.groupBy("_chunk").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 5 * PIECE
    ordered = [x._chunk for x in df.orderBy(F.col("k").asc_nulls_first(), "o", "id").collect()]
    assert ordered == sorted(ordered)


@pytest.mark.parametrize("back,ahead", [(1, 0), (0, 1), (3, 2)])
def test_windowed_equals_plain(hot, back, ahead):
    def cols(w):
        out = {f"b{i}": F.lag("v", i).over(w) for i in range(1, back + 1)}
        out |= {f"a{i}": F.lead("v", i).over(w) for i in range(1, ahead + 1)}
        return out | {"m": F.avg("v").over(w.rowsBetween(-back, ahead))}

    plain = hot.withColumns(cols(Window.partitionBy("k").orderBy("o", "id")))
    split = windowed(hot, ["k"], ["o", "id"], cols, back, ahead, ROWS, PIECE)
    names = ["id", *cols(Window.partitionBy("k").orderBy("o", "id"))]
    assert as_set(split, names) == as_set(plain, names)


@pytest.mark.parametrize("key", [["k"], []])
def test_running_equals_plain(hot, key):
    w = Window.partitionBy(*key).orderBy(*([] if key else [F.col("k").asc_nulls_first()]), "o", "id").rowsBetween(
        Window.unboundedPreceding, 0)
    plain = hot.withColumn("s", F.sum("v").over(w)).withColumn("t", F.sum("v").over(Window.partitionBy(*key)))
    order = ["o", "id"] if key else ["k", "o", "id"]
    split = running(hot, key, order, {"s": "v"}, {"t": "v"}, ROWS, PIECE)
    assert as_set(split, ["id", "s", "t"]) == as_set(plain, ["id", "s", "t"])


def test_exact_quantiles_split(hot):
    ps = {"q1": 0.25, "median": 0.5, "p99": 0.99}
    a = exact_quantiles(hot, ["id", "v"], ps, ["k"])
    b = exact_quantiles(hot, ["id", "v"], ps, ["k"], bins=3)
    cols = ["k", "column", "total", *ps]
    assert as_set(a, cols) == as_set(b, cols)
    ids = sorted(x.id for x in hot.where("k = 'hot'").collect())
    got = a.where("k = 'hot' AND column = 'id'").first()
    assert got.median == ids[-(-len(ids) // 2) - 1] and got.total == len(ids)


def test_ranking_metrics_split(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), rng.randrange(500) / 500, 1) for _ in range(2000)]
    df = spark.createDataFrame(rows, "label int, p double, prediction int").cache()
    assert metrics.auc_roc(df, 2000, 50).first()[0] == pytest.approx(metrics.auc_roc(df, 2000).first()[0], abs=1e-12)
    cols = ["threshold", "tp", "fp", "fpr", "tpr", "precision"]
    assert as_set(metrics.roc_pr_curve(df, 2000, 50), cols) == as_set(metrics.roc_pr_curve(df, 2000), cols)
    # brute force
    pos = [p for y, p, _ in rows if y == 1]
    neg = [p for y, p, _ in rows if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.auc_roc(df).first()[0] == pytest.approx(wins, abs=1e-12)


def test_trajectory_split(spark, sf):
    from latewing.sources.views import trajectory

    e = trajectory(spark, sf)
    n = e.count()
    for fn, cols in [
        (lambda c: tr.reconstruct(e, n, c), ["flight_id", "seq_no", "event_id"]),
        (lambda c: tr.level_segments(e, rows=n, chunk_rows=c), ["flight_id", "segment", "start_us", "end_us", "events"]),
        (lambda c: tr.gap_stats(e, n, c).withColumn("std_gap_s", F.round("std_gap_s", 6)), ["flight_id", "mean_gap_s", "std_gap_s", "max_gap_s"]),
        (lambda c: tr.rolling(e, 5, rows=n, chunk_rows=c).withColumn("roll_std", F.round("roll_std", 6)).withColumn(
            "roll_mean", F.round("roll_mean", 6)), ["event_id", "roll_mean", "roll_std"]),
        (lambda c: flight_features(e, n, c).withColumn("distance_km", F.round("distance_km", 6)).withColumn(
            "std_alt", F.round("std_alt", 6)).withColumn("mean_alt", F.round("mean_alt", 6)),
         ["flight_id", "events", "mean_gap_s", "distance_km", "std_alt", "mean_alt"]),
    ]:
        assert as_set(fn(60), cols) == as_set(fn(10 ** 9), cols)


def test_plain_window_when_no_key_is_large(spark):
    """Many rows but small keys: measured, and left to one exchange."""
    df = spark.range(2000).select((F.col("id") % 100).alias("k"), "id")
    out = windowed(df, ["k"], ["id"], lambda w: {"p": F.lag("id").over(w)}, back=1, rows=2000, chunk_rows=50)
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("p IS NULL").count() == 100
