"""Queries on scored rows: labels, bands, quality metrics, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from latewing.functions import labels
from latewing.operators import aggregates as agg, metrics, ranking, reports
from latewing.plans.flights import PICKED_SQL, REPORT_KEY
from latewing.plans.registry import query, r
from latewing.schema import OUTCOME_NAMES
from latewing.sources import views
from latewing.sources.messages import row_json
from latewing.sources.views import table_rows

KIND = """CASE WHEN label = 1 AND prediction = 1 THEN 'True Positive' WHEN label = 0 AND prediction = 0 THEN 'True Negative'
  WHEN label = 0 AND prediction = 1 THEN 'False Positive' ELSE 'False Negative' END"""


def scored(spark, sf):
    return views.scored(spark, sf)


def n_events(spark, sf):
    return table_rows(spark, sf, "events")


@query("case_confusion_type", f"SELECT event_id, {KIND} AS prediction_type FROM scored", "scored")
def _(spark, sf):
    return scored(spark, sf).select("event_id", labels.confusion_type("label", "prediction").alias("prediction_type"))


@query("flag_correct", """SELECT event_id, CASE WHEN label = prediction THEN 1 ELSE 0 END AS is_correct,
  CASE WHEN label = prediction THEN 'Correct' ELSE 'Wrong' END AS correct FROM scored""", "scored")
def _(spark, sf):
    return scored(spark, sf).select(
        "event_id", labels.correct_flag("label", "prediction").alias("is_correct"),
        labels.correct_word("label", "prediction").alias("correct"))


@query("threshold_label", "SELECT event_id, CASE WHEN p >= 0.45 THEN 1 ELSE 0 END AS flagged FROM scored", "scored")
def _(spark, sf):
    return scored(spark, sf).select("event_id", labels.at_threshold("p", 0.45).alias("flagged"))


@query("band_confidence", """WITH b AS (SELECT event_id, p, CASE WHEN round(p * 100, 1) > 70 OR round(p * 100, 1) < 30
  THEN 'high' ELSE 'low' END AS band, CASE WHEN label = prediction THEN 'Correct' ELSE 'Wrong' END AS match FROM scored),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY band, match ORDER BY event_id) AS INT) AS rn FROM b)
SELECT event_id, p, band, match, rn FROM n WHERE rn <= 15""", "scored")
def _(spark, sf):
    return ranking.band_confidence(scored(spark, sf)).select("event_id", "p", "band", "match", "rn")


@query("filter_confident_tp", "SELECT event_id, p FROM scored WHERE label = 1 AND prediction = 1 AND p > 0.6", "scored")
def _(spark, sf):
    return ranking.confident_true_positives(scored(spark, sf)).select("event_id", "p")


@query("agg_pred_type_summary", f"""SELECT {KIND} AS prediction_type, count(*) AS n,
  CAST(sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(avg(p), 3) AS avg_p
FROM scored GROUP BY 1""", "scored")
def _(spark, sf):
    return agg.pred_type_summary(scored(spark, sf))


@query("agg_pred_summary", """SELECT count(*) AS total, count(*) FILTER (label = prediction) AS correct,
  count(*) FILTER (label <> prediction) AS incorrect,
  count(*) FILTER (label = prediction)::DOUBLE / count(*) AS accuracy FROM scored""", "scored")
def _(spark, sf):
    return agg.pred_summary(scored(spark, sf))


@query("agg_sample_stats", """SELECT count(*) AS n, count(*) FILTER (label = prediction) AS correct,
  round(count(*) FILTER (label = prediction) * 100.0::DOUBLE / count(*), 1) AS correct_pct,
  round(avg(round(p * 100, 1)), 1) AS avg_pct FROM scored""", "scored")
def _(spark, sf):
    return agg.sample_stats(scored(spark, sf))


@query("agg_prob_stats", """SELECT day, count(*) AS n, min(p) AS min_prob, max(p) AS max_prob, round(avg(p), 6) AS avg_prob
FROM scored GROUP BY 1""", "scored")
def _(spark, sf):
    return scored(spark, sf).groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.min("p").alias("min_prob"), F.max("p").alias("max_prob"),
        F.round(F.avg("p"), 6).alias("avg_prob"))


@query("agg_prob_stats_all", """SELECT count(*) AS n, min(p) AS min_prob, max(p) AS max_prob, round(avg(p), 6) AS avg_prob
FROM scored""", "scored")
def _(spark, sf):
    return agg.prob_stats(scored(spark, sf)).withColumn("avg_prob", F.round("avg_prob", 6))


@query("topk_riskiest", """SELECT l_orderkey, l_partkey, l_linenumber, op_unique_carrier, origin, dest, distance, p
FROM flight_scores ORDER BY p DESC, l_orderkey, l_partkey, l_linenumber, op_unique_carrier, distance LIMIT 10""",
       "flight_scores")
def _(spark, sf):
    rows = views.flight_scores(spark, sf).select(*REPORT_KEY, "origin", "dest", "p")
    return ranking.top_k(rows, "p", REPORT_KEY, 10)


@query("top1_per_batch", """SELECT day, event_id, user_id, p, label FROM (SELECT *, row_number() OVER (PARTITION BY day
  ORDER BY p DESC, event_id) AS rn FROM scored) WHERE rn = 1""", "scored")
def _(spark, sf):
    rows = scored(spark, sf).select("day", "event_id", "user_id", "p", "label")
    return ranking.top1_per_batch(rows, "day", ["event_id"])


@query("tail_recent", "SELECT event_id, day, p FROM scored ORDER BY day DESC, event_id DESC LIMIT 100", "scored")
def _(spark, sf):
    return ranking.tail_recent(scored(spark, sf).select("event_id", "day", "p"), ["day", "event_id"], 100)


@query("limit_filtered", "SELECT event_id, label, prediction, p FROM scored WHERE label = prediction ORDER BY event_id LIMIT 20",
       "scored")
def _(spark, sf):
    rows = scored(spark, sf).select("event_id", "label", "prediction", "p")
    return ranking.limit_filtered(rows, F.col("label") == F.col("prediction"), ["event_id"], 20)


@query("ml_confusion", "SELECT label, prediction, count(*) AS count FROM scored GROUP BY 1, 2", "scored")
def _(spark, sf):
    return metrics.confusion(scored(spark, sf))


@query("ml_metrics_weighted", """WITH c AS (SELECT k AS cls, count(*) FILTER (label = k) AS support,
    count(*) FILTER (prediction = k) AS called, count(*) FILTER (label = k AND prediction = k) AS tp
  FROM scored, (VALUES (0), (1)) v(k) GROUP BY k),
m AS (SELECT *, tp / called AS pr, tp / support AS rc FROM c)
SELECT round(sum(tp)::DOUBLE / sum(support), 6) AS accuracy, round(sum(pr * support) / sum(support), 6) AS weighted_precision,
  round(sum(rc * support) / sum(support), 6) AS weighted_recall,
  round(sum(2 * pr * rc / (pr + rc) * support) / sum(support), 6) AS f1 FROM m""", "scored")
def _(spark, sf):
    return metrics.weighted_metrics(scored(spark, sf)).select(
        r("accuracy", 6), r("weighted_precision", 6), r("weighted_recall", 6), r("f1", 6))


@query("ml_auc_roc", """WITH g AS (SELECT p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM scored GROUP BY 1), c AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below FROM g)
SELECT round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 8) AS auc_roc FROM c""", "scored")
def _(spark, sf):
    return metrics.auc_roc(scored(spark, sf), n_events(spark, sf)).select(r("auc_roc", 8))


CURVE = """g AS (SELECT p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1),
c AS (SELECT p, pos, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
    sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g WINDOW w AS (ORDER BY p DESC))"""


@query("ml_roc_pr_curve", f"""WITH {CURVE} SELECT p AS threshold, tp, fp, round(fp / nn::DOUBLE, 8) AS fpr,
  round(tp / np::DOUBLE, 8) AS tpr, round(tp / (tp + fp)::DOUBLE, 8) AS precision FROM c""", "scored")
def _(spark, sf):
    return metrics.roc_pr_curve(scored(spark, sf), n_events(spark, sf)).select(
        "threshold", "tp", "fp", r("fpr", 8), r("tpr", 8), r("precision", 8))


@query("p_pr_auc", f"""WITH {CURVE}, a AS (SELECT sum(tp / (tp + fp)::DOUBLE * pos) / sum(pos)::DOUBLE AS pr_auc FROM c),
b AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS h, count(*) FILTER (prediction = 1) AS k,
  count(*) FILTER (label = 1) AS n FROM scored)
SELECT round(h::DOUBLE / k, 6) AS precision, round(h::DOUBLE / n, 6) AS recall, round(2.0::DOUBLE * h / (k + n), 6) AS f1,
  round(pr_auc, 6) AS pr_auc FROM a, b""", "scored")
def _(spark, sf):
    rows = scored(spark, sf)
    area = metrics.pr_auc(rows, n_events(spark, sf)).scalar()
    return metrics.binary_report(rows).withColumn("pr_auc", area).select(
        r("precision", 6), r("recall", 6), r("f1", 6), r("pr_auc", 6))


@query("sink_json_row", """SELECT event_id, user_id, event_type, p, prediction FROM scored""", "scored")
def _(spark, sf):
    lines = scored(spark, sf).select(row_json("event_id", "user_id", "event_type", "p", "prediction").alias("json"))
    shape = "event_id bigint, user_id bigint, event_type string, p double, prediction int"
    return lines.select(F.from_json("json", shape).alias("d")).select("d.*")


@query("json_emit", """SELECT op_unique_carrier AS carrier, origin, dest AS destination, crs_dep_time AS scheduled_departure,
  CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction, p AS delay_probability FROM flight_scores""", "flight_scores")
def _(spark, sf):
    from latewing.streaming.scoring import ALERT_SCHEMA, alert_fields

    lines = alert_fields(views.flight_scores(spark, sf), 0.5).select(row_json("*").alias("json"))
    return lines.select(F.from_json("json", ALERT_SCHEMA).alias("d")).select("d.*")


@query("map_outcomes", """SELECT event_id, CASE label WHEN 0 THEN 'On-time' ELSE 'Delayed' END AS actual_label,
  CASE prediction WHEN 0 THEN 'On-time' ELSE 'Delayed' END AS predicted_label, round(p * 100, 1) AS delay_prob_pct,
  label = prediction AS is_match FROM scored""", "scored")
def _(spark, sf):
    assert set(OUTCOME_NAMES) == {0, 1}
    return reports.readable(scored(spark, sf)).select(
        "event_id", "actual_label", "predicted_label", "delay_prob_pct", "is_match")


CLOCK = "CASE WHEN {0} = 0 OR {0} IS NULL THEN 'N/A' ELSE printf('%02d:%02d', {0} // 100, {0} % 100) END"


@query("report_correct_delays", f"""WITH {PICKED_SQL}
SELECT strftime(make_date(2024, month, 1), '%b') AS month_name, day_of_month,
  CASE day_of_week WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed' WHEN 4 THEN 'Thu' WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat'
    ELSE 'Sun' END AS weekday, op_unique_carrier AS airline, origin AS from_airport, dest AS to_airport, distance,
  {CLOCK.format('crs_arr_time')} AS sched_arrival, {CLOCK.format('crs_dep_time')} AS real_arrival,
  CAST(round_even(coalesce(arr_delay, 0), 0) AS INT) AS delay_min, round(p * 100, 1) AS confidence_pct, label FROM picked""",
       "flight_scores")
def _(spark, sf):
    rows = views.flight_scores(spark, sf).withColumn("arr_time", F.col("crs_dep_time"))
    return reports.correct_delays(rows, REPORT_KEY)
