"""Queries on the learning pipeline. Models are trained once per session and data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from latewing.functions.vectors import vec_get
from latewing.operators import features, metrics, models
from latewing.operators.sampling import split_random
from latewing.plans.flights import SAMPLE_TEXT, _bucket_sql, flights
from latewing.plans.registry import query, r
from latewing.schema import CATEGORICAL_FEATURES, INT_FEATURES, NUMERIC_FEATURES
from latewing.session import cut_lineage, kept, run_folder
from latewing.sources.views import FLIGHT_KEY

NAMES = {"lr": "Logistic Regression", "dt": "Decision Tree", "rf": "Random Forest"}


def parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows, each written once while the inputs stay the same: passes over them do not hash their keys again."""
    def made() -> tuple[DataFrame, DataFrame]:
        rows = cut_lineage(features.training_rows(flights(spark, sf), FLIGHT_KEY), "training")
        train, test = split_random(rows, 0.8, FLIGHT_KEY)
        return cut_lineage(train, "training"), cut_lineage(test, "test")

    return kept(spark, "training", sf, made)


def fitted(spark: SparkSession, sf: str, kind: str) -> models.Trained:
    train, _ = parts(spark, sf)
    return kept(spark, f"model {kind}", sf, lambda: models.train_models(train, (kind,))[kind])


def test_scores(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Scored test rows, written once: several metrics read them."""
    model, (_, test) = fitted(spark, sf, kind).model, parts(spark, sf)
    return kept(spark, f"scores {kind}", sf, lambda: cut_lineage(models.predict(model, test), "scores"))


def _rank_sql(col: str) -> str:
    return (f"SELECT '{col}' AS \"column\", {col} AS value, CAST(row_number() OVER (ORDER BY count(*) DESC, {col}) - 1 AS DOUBLE) "
            f"AS idx, count(*) AS count FROM flights GROUP BY {col}")


@query("ml_string_index", " UNION ALL ".join(f"({_rank_sql(c)})" for c in CATEGORICAL_FEATURES), "flights")
def _(spark, sf):
    codes = features.category_codes(flights(spark, sf), CATEGORICAL_FEATURES)
    return codes.where("value IS NOT NULL").select("column", "value", F.col("code").alias("idx"), "count")


SLOTS = (*NUMERIC_FEATURES, *[f"{c}_indexed" for c in CATEGORICAL_FEATURES])


@query("ml_assemble", "WITH " + ", ".join(f"r_{c} AS ({_rank_sql(c)})" for c in CATEGORICAL_FEATURES)
       + " SELECT count(*) AS n, " + ", ".join(f"round(sum(f.{c}::DOUBLE), 2) AS {c}" for c in NUMERIC_FEATURES) + ", "
       + ", ".join(f"round(sum(r_{c}.idx), 2) AS {c}_indexed" for c in CATEGORICAL_FEATURES) + " FROM flights f "
       + " ".join(f"JOIN r_{c} ON f.{c} = r_{c}.value" for c in CATEGORICAL_FEATURES), "flights")
def _(spark, sf):
    df = flights(spark, sf)
    coded = models.encoded_array(features.fit_encoder(df), df)
    return coded.agg(F.count(F.lit(1)).alias("n"), *[
        F.round(F.sum(F.get("features_array", F.lit(i))), 2).alias(n) for i, n in enumerate(SLOTS)])


@query("vec_get", "SELECT l_orderkey, l_partkey, l_linenumber, distance, CAST(month AS DOUBLE) AS month, 0.0::DOUBLE AS absent FROM flights",
       "flights")
def _(spark, sf):
    df = features.assembler(["month", "distance"], []).transform(flights(spark, sf))
    return df.select("l_orderkey", "l_partkey", "l_linenumber", vec_get("features", 1).alias("distance"),
                     vec_get("features", 0).alias("month"), vec_get("features", 9, 0.0).alias("absent"))


@query("ml_decode_features", f"SELECT {', '.join(f'CAST(trunc({c}) AS INT) AS {c}' for c in NUMERIC_FEATURES)}, arr_del15 AS label "
       "FROM flights WHERE arr_del15 IS NOT NULL", "flights")
def _(spark, sf):
    df = features.complete_features(flights(spark, sf).where("arr_del15 IS NOT NULL"))
    coded = features.fit_encoder(df).transform(df).select("features", F.col("arr_del15").alias("label"))
    out = models.decode_features(coded, list(SLOTS), list(NUMERIC_FEATURES))
    return out.select(*NUMERIC_FEATURES, "label")


TRAIN_TEXT = SAMPLE_TEXT.replace("concat_ws('|', ", "concat_ws('|', concat(year, '-', month), ", 1)
ML_ROWS = f"""ml_rows AS (SELECT *, {_bucket_sql(SAMPLE_TEXT)} AS b FROM flights WHERE {_bucket_sql(TRAIN_TEXT)} < 2000
  AND arr_del15 IN (0, 1) AND cancelled = 0 AND diverted = 0)"""


@query("ml_training_rows", f"""WITH {ML_ROWS} SELECT year, month, arr_del15::DOUBLE AS label, count(*) AS count
FROM ml_rows GROUP BY 1, 2, 3""", "flights")
def _(spark, sf):
    rows = features.training_rows(flights(spark, sf), FLIGHT_KEY)
    return rows.groupBy("year", "month", "label").agg(F.count(F.lit(1)).alias("count"))


def learned(spark: SparkSession, sf: str, kind: str) -> bool:
    """Whether the model ranks its training rows better than one score for all would, which has an area of a half."""
    model, (train, _) = fitted(spark, sf, kind).model, parts(spark, sf)
    area = kept(spark, f"area {kind}", sf, lambda: metrics.auc_roc(models.predict(model, train)).first()[0])
    return area is not None and area > 0.5


def _register_model(kind: str) -> None:
    @query(f"ml_{kind}", f"""WITH {ML_ROWS} SELECT {', '.join(FLIGHT_KEY)}, arr_del15::DOUBLE AS label, true AS in_range, true AS decided, true AS learned
FROM ml_rows WHERE b >= 8000""", "flights")
    def _(spark, sf):
        """Every test row with its label: a probability in range, a prediction that follows from it, from a model that learned something."""
        return test_scores(spark, sf, kind).select(
            *FLIGHT_KEY, "label", F.col("p").between(0, 1).alias("in_range"),
            ((F.col("prediction") == 1) == (F.col("p") > 0.5)).alias("decided"), F.lit(learned(spark, sf, kind)).alias("learned"))


for _kind in NAMES:
    _register_model(_kind)


@query("ml_predict", f"WITH {ML_ROWS} SELECT arr_del15::DOUBLE AS label, count(*) AS scored_rows FROM ml_rows WHERE b >= 8000 GROUP BY 1",
       "flights")
def _(spark, sf):
    out = test_scores(spark, sf, "rf").where(F.col("p").between(0, 1) & F.col("prediction").isin(0, 1))
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("scored_rows"))


@query("ml_feature_importance", "SELECT 10::BIGINT AS features, 10::BIGINT AS ranks, 1.0::DOUBLE AS total, true AS ordered")
def _(spark, sf):
    """Ten features, each with a rank of its own, importances that add up to one and fall with the rank."""
    table = models.feature_importance(spark, fitted(spark, sf, "rf").model)
    return table.agg(
        F.count_distinct("feature").alias("features"), F.count_distinct("rank").alias("ranks"), F.round(F.sum("importance"), 6).alias("total"),
        (F.array_agg("rank") == F.transform(F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "feature", "rank"))),
                                            lambda x: x["rank"])).alias("ordered"))


@query("topk_feature_importance", "SELECT 6::BIGINT AS rows, 1.0::DOUBLE AS total")
def _(spark, sf):
    top = models.top_importance(models.feature_importance(spark, fitted(spark, sf, "rf").model), 5)
    return top.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("importance"), 6).alias("total"))


@query("ml_compare_models", " UNION ALL ".join(f"SELECT '{n}' AS model, true AS in_range, true AS best_leads" for n in NAMES.values()))
def _(spark, sf):
    """The models' metrics lie in range, and the one marked as best has the largest AUC."""
    table = cut_lineage(metrics.compare_models({name: test_scores(spark, sf, k) for k, name in NAMES.items()},
                                               {name: fitted(spark, sf, k).seconds for k, name in NAMES.items()}), "compared")
    lead = table.agg(F.max("auc_roc")).scalar()
    fair = F.lit(True)
    for c in ("auc_roc", "accuracy", "weighted_precision", "weighted_recall", "f1"):
        fair = fair & F.col(c).between(0, 1)
    return table.withColumn("_lead", lead).select("model", fair.alias("in_range"), (
        ~F.col("best") | (F.col("auc_roc") == F.col("_lead"))).alias("best_leads"))


@query("ml_train_time")
def _(spark, sf):
    return metrics.model_row(NAMES["rf"], test_scores(spark, sf, "rf"), fitted(spark, sf, "rf").seconds).select(
        "model", "train_seconds")


@query("ml_overfit_gap", " UNION ALL ".join(f"SELECT '{n}' AS model, true AS in_range, true AS flagged" for n in NAMES.values()))
def _(spark, sf):
    """Accuracies in range, and the flag set exactly where the gap passes five points."""
    train, _ = parts(spark, sf)
    gaps = metrics.overfit_gap({
        name: (models.predict(fitted(spark, sf, k).model, train), test_scores(spark, sf, k)) for k, name in NAMES.items()})
    return gaps.select("model", (F.col("train_accuracy").between(0, 1) & F.col("test_accuracy").between(0, 1)).alias("in_range"), (
        F.col("overfit") == ((F.col("train_accuracy") - F.col("test_accuracy")) * 100 > 5)).alias("flagged"))


@query("score_batch", "SELECT count(*) AS scored_rows FROM flights", "flights")
def _(spark, sf):
    raw = flights(spark, sf).select(*[F.col(c).cast("string") for c in (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES)])
    out = models.score_batch(fitted(spark, sf, "rf").model, raw)
    return out.where(F.col("p").isNotNull()).agg(F.count(F.lit(1)).alias("scored_rows"))


@query("score_batch_rows")
def _(spark, sf):
    """Prediction and probability of every flight."""
    raw = flights(spark, sf).select(*[F.col(c).cast("string") for c in FLIGHT_KEY if c not in NUMERIC_FEATURES and c not in CATEGORICAL_FEATURES], *[
        F.col(c).cast("string") for c in (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES)])
    return models.score_batch(fitted(spark, sf, "rf").model, raw)


@query("score_batch_distribution", "SELECT count(*) AS total, true AS consistent FROM flights", "flights")
def _(spark, sf):
    raw = flights(spark, sf).select(*[F.col(c).cast("string") for c in (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES)])
    out = models.score_batch(fitted(spark, sf, "rf").model, raw)
    cells = out.groupBy("prediction", "flagged").agg(
        F.count(F.lit(1)).alias("count"), F.bool_and((F.col("flagged") == 1) == (F.col("p") >= 0.5)).alias("fair"))
    return cells.agg(F.sum("count").alias("total"), F.bool_and("fair").alias("consistent"))


def _saved(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the model at hand next to those of its saved and reloaded copy, test rows by agreement."""
    path = run_folder(spark, "model")
    models.save_model(fitted(spark, sf, "rf").model, path)
    mine = test_scores(spark, sf, "rf")
    both = models.predict(models.load_model(path), mine.withColumnRenamed("p", "p_mine").withColumnRenamed(
        "prediction", "prediction_mine"))
    same = (F.col("p") == F.col("p_mine")) & (F.col("prediction") == F.col("prediction_mine"))
    return both.groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("count"))


for _name in ("sink_model", "src_model"):
    query(_name, f"WITH {ML_ROWS} SELECT true AS same, count(*) AS count FROM ml_rows WHERE b >= 8000", "flights")(_saved)

assert set(INT_FEATURES) < set(NUMERIC_FEATURES)
