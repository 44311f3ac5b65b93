import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from latewing.operators import anomaly, features, metrics, models
from latewing.operators.sampling import split_random
from latewing.plans.learning import parts
from latewing.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from latewing.session import run_folder
from latewing.sources.views import FLIGHT_KEY, flights, scored


@pytest.fixture(scope="module")
def data(spark, sf):
    rows = features.training_rows(flights(spark, sf), FLIGHT_KEY, 1.0).cache()
    train, test = split_random(rows, 0.8, FLIGHT_KEY)
    fitted = models.train_models(
        train, lr={"maxIter": 10}, dt={"maxDepth": 4}, rf={"maxDepth": 4, "numTrees": 5})
    return train, test, fitted


def test_metrics_agree_with_evaluators(spark, sf):
    df = scored(spark, sf).select(F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction"), "p").cache()
    mine = metrics.weighted_metrics(df).first()
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    for name, field in (("accuracy", "accuracy"), ("weightedPrecision", "weighted_precision"),
                        ("weightedRecall", "weighted_recall"), ("f1", "f1")):
        assert mine[field] == pytest.approx(ev.evaluate(df, {ev.metricName: name}), abs=1e-12)
    assert mine.weighted_recall == pytest.approx(mine.accuracy, abs=1e-12)
    area = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="p", numBins=0).evaluate(df)
    assert metrics.auc_roc(df).first()[0] == pytest.approx(area, abs=1e-9)


def test_models_score_and_compare(data):
    train, test, fitted = data
    table = metrics.compare_models({k: models.predict(t.model, test) for k, t in fitted.items()},
                                   {k: t.seconds for k, t in fitted.items()}).collect()
    assert len(table) == 3 and sum(x.best for x in table) == 1 and all(0 <= x.accuracy <= 1 for x in table)
    gaps = metrics.overfit_gap({k: (models.predict(t.model, train), models.predict(t.model, test)) for k, t in fitted.items()})
    assert gaps.count() == 3
    n = test.count()
    assert metrics.confusion(models.predict(fitted["rf"].model, test)).agg(F.sum("count")).first()[0] == n


def test_importance_sums_to_one(spark, data):
    df = models.feature_importance(spark, data[2]["rf"].model)
    assert df.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert df.count() == len(NUMERIC_FEATURES) + len(CATEGORICAL_FEATURES)
    top = models.top_importance(df, 3)
    assert top.count() == 4 and top.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_save_load_and_unseen_category(spark, data):
    _, test, fitted = data
    path = run_folder(spark, "m")
    models.save_model(fitted["rf"].model, path)
    again = models.load_model(path)
    strange = test.limit(5).withColumn("origin", F.lit("NOWHERE"))
    assert models.predict(again, strange).count() == 5
    a = models.predict(fitted["rf"].model, test).agg(F.sum("p")).first()[0]
    assert models.predict(again, test).agg(F.sum("p")).first()[0] == pytest.approx(a)


def test_codes_are_the_same_rule_at_every_size(spark):
    df = spark.range(60_000).selectExpr("concat('c', id % 20000 % (1 + id % 19999)) AS origin", "cast(id % 3 = 0 AS double) AS label")
    codes = features.category_codes(df, ["origin"], "label").where("value IS NOT NULL").cache()
    df.createOrReplaceTempView("many")
    want = spark.sql("SELECT origin AS value, row_number() OVER (ORDER BY count(*) DESC, origin) - 1D AS code FROM many GROUP BY 1")
    assert codes.count() > 10_000 and codes.select("value", "code").exceptAll(want).count() == 0 and want.count() == codes.count()
    overall = df.agg(F.avg("label")).first()[0]
    hand = df.groupBy("origin").agg(((F.sum("label") + 20 * overall) / (F.count("*") + 20)).alias("r"))
    assert codes.join(hand, codes.value == hand.origin).where("abs(rate - r) > 1e-9").count() == 0


def test_unseen_categories_get_the_last_code(spark, data):
    train, test, _ = data
    enc = features.fit_encoder(train, label="label")
    n = train.select("origin").distinct().count()
    strange = enc.transform(test.limit(3).withColumn("origin", F.lit("NOWHERE")))
    assert {r.origin_indexed for r in strange.collect()} == {float(n)}


def test_score_batch_drops_incomplete(spark, data):
    model = data[2]["lr"].model
    cols = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
    raw = data[1].select(*[F.col(c).cast("string").alias(c.upper()) for c in cols]).limit(20)
    holes = raw.limit(3).withColumn("MONTH", F.lit("x"))
    assert models.score_batch(model, raw.unionByName(holes)).count() == raw.count()


def test_planted_outliers_rank_on_top(spark):
    base = spark.range(2000).select(
        F.col("id").alias("flight_id"), (F.randn(1) * 1 + 10).alias("a"), (F.randn(2) * 2 + 5).alias("b"), (F.randn(3)).alias("c"))
    odd = spark.createDataFrame([(9001, 40.0, 60.0, 15.0), (9002, -30.0, 5.0, -20.0)], "flight_id bigint, a double, b double, c double")
    df = base.unionByName(odd).cache()
    cols = ["a", "b", "c"]
    top = [x.flight_id for x in anomaly.isolation_forest(df, cols, trees=30, sample=128).orderBy(F.desc("score")).limit(2).collect()]
    assert set(top) == {9001, 9002}
    assert {9001, 9002} <= {x.flight_id for x in anomaly.kmeans_outliers(df, cols, k=2).where("outlier").collect()}
    err = [x.flight_id for x in anomaly.pca_reconstruction(df, cols, 1).orderBy(F.desc("error")).limit(2).collect()]
    assert {9001, 9002} & set(err)
    low = [x.flight_id for x in anomaly.grid_density(df, ["a", "b"]).orderBy("density", "flight_id").limit(4).collect()]
    assert {9001, 9002} <= set(low)


def test_correlated_columns_are_pruned(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), F.rand(5).alias("c"))
    assert anomaly.corr_prune(df, ["a", "b", "c"]) == ["a", "c"]


def test_shuffled_noise_matters_less_than_signal(spark):
    df = spark.range(1500).select("id", F.rand(1).alias("x"), F.rand(2).alias("noise")).withColumn(
        "label", (F.col("x") > 0.5).cast("double")).cache()
    def predict(d):
        return d.select("label", F.col("x").alias("p"))

    for piece in (10 ** 9, 100):
        got = {x.feature: x.importance for x in anomaly.permutation_importance(
            predict, df, ["x", "noise"], ["id"], 1500, chunk_rows=piece).collect()}
        assert got["x"] > 0.3 and got["noise"] == pytest.approx(0.0)


def test_vector_decode(spark):
    df = spark.createDataFrame([(Vectors.dense(4.0, 2.5),)], ["features"])
    assert tuple(models.decode_features(df, ["m", "d"], ["m"]).select("m", "d").first()) == (4, 2.5)


def test_trees_keep_their_rows_nodes(spark, sf, data):
    """A pass over the training rows must not walk every tree from its root."""
    for kind in ("dt", "rf"):
        made = models._classifier(kind, {})
        assert made.getCacheNodeIds() and made.getMaxDepth() == 15 and made.getMaxBins() == models.MAX_BINS
    train = data[0]
    plain = models.train_models(train, ("rf",), rf={"maxDepth": 4, "numTrees": 5, "cacheNodeIds": False})["rf"].model
    assert plain.classifier.stages[-1].toDebugString.split("\n")[1:] == data[2]["rf"].model.classifier.stages[-1].toDebugString.split("\n")[1:]


def test_split_is_made_once(spark, sf):
    """Training and test rows are read from their own folders: no hash of the key is left in their plans."""
    train, test = parts(spark, sf)
    whole = features.training_rows(flights(spark, sf), FLIGHT_KEY)
    a, b = split_random(whole, 0.8, FLIGHT_KEY)
    for mine, same in ((train, a), (test, b)):
        assert "md5" not in mine._jdf.queryExecution().toString()
        assert mine.count() == same.count() and mine.exceptAll(same).isEmpty()


def test_forest_scores_are_the_models_and_made_once(spark, data):
    """Every row's probability and prediction equal those of the classifier itself, and conditions on them don't run the trees again."""
    train, test, fitted = data
    model = fitted["rf"].model
    whole = models.train_models(train, ("rf",), rf={"numTrees": 7, "maxDepth": 12, "minInstancesPerNode": 1})["rf"].model
    for m in (model, whole):
        rows = test.unionByName(test.limit(5).withColumn("origin", F.lit("NOWHERE")))
        plain = m.transform(rows).select(*test.columns, F.col("prediction").cast("int").alias("prediction"), models.delay_probability("probability").alias("p"))
        mine = models.predict(m, rows)
        assert mine.count() == plain.count() > 0 and mine.exceptAll(plain).isEmpty()
    asked = models.predict(model, test).where(F.col("p").between(0, 1) & F.col("prediction").isin(0, 1)).select("label", "p", "prediction")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("BatchEvalPython") == 1 and "rawPrediction" not in plan
    path = run_folder(spark, "model")
    models.save_model(whole, path)
    assert models.predict(models.load_model(path), test).exceptAll(models.predict(whole, test)).isEmpty()


def test_rows_of_a_large_table_train_among_alike_ones(spark, monkeypatch):
    """Every row once, in parts of like size though most rows are of one cell, neighbours alike; the forest that is trained on them has learned."""
    n = 4000
    rows = spark.range(n).select(
        F.col("id"), *[F.when(F.col("id") % 4 > 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000))).cast("int").alias(c) for i, c in enumerate(NUMERIC_FEATURES)],
        *[F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias(c) for c in CATEGORICAL_FEATURES])
    rows = rows.withColumn("label", (F.col("distance") > 500).cast("double")).repartition(3).cache()
    coded = features.fit_encoder(rows, "rate", "label").transform(rows).cache()
    names = [*NUMERIC_FEATURES, *[f"{c}_indexed" for c in CATEGORICAL_FEATURES]]
    dealt = [[(x.label, *x.features) for x in p] for p in models.among_alike(coded, names, 4).rdd.glom().collect()]
    assert sorted(x for p in dealt for x in p) == sorted((x.label, *x.features) for x in coded.select("label", "features").collect())
    assert len(dealt) == 4 and max(map(len, dealt)) < n / 2
    before = [x.features for x in coded.select("features").collect()]
    assert 2 * sum(a[1:] != b[1:] for p in dealt for a, b in zip(p, p[1:])) < sum(a != b for a, b in zip(before, before[1:]))

    seen, real = [], models.among_alike
    monkeypatch.setattr(models, "ROWS_PER_PART", 1000)
    monkeypatch.setattr(models, "among_alike", lambda *a: seen.append(a[1:]) or real(*a))
    model = models.train_models(rows, ("lr", "rf"), lr={"maxIter": 2}, rf={"maxDepth": 4, "numTrees": 5})["rf"].model
    assert len(seen) == 1
    assert metrics.auc_roc(models.predict(model, rows)).first()[0] > 0.9
