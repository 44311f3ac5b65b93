"""Queries on flights: casts, filters, joins, aggregates, rankings, samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from latewing.functions import casts, labels, text
from latewing.functions.buckets import key_text, md5_bucket
from latewing.operators import aggregates as agg, clean, dims, ranking, sampling
from latewing.operators.quantiles import exact_quantiles
from latewing.plans.registry import query, r
from latewing.schema import CATEGORICAL_FEATURES, MONTH_NAMES, NUMERIC_FEATURES, WEEKDAY_NAMES
from latewing.session import cut_lineage, kept, run_folder, settings, stored_bytes
from latewing.sources import views
from latewing.sources.files import dealt, read_parquet, union_by_name, write_parquet
from latewing.sources.views import FLIGHT_KEY, table, table_rows


def flights(spark: SparkSession, sf: str) -> DataFrame:
    return views.flights(spark, sf)


def n_flights(spark: SparkSession, sf: str) -> int:
    return table_rows(spark, sf, "lineitem")


# A join whose smaller side is at most this in every partition is hashed: line items are not sorted for it and don't spill.
SMALL_SIDE_HASHED = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "16m"}
PART_BYTES = 16 << 20       # of stored line items and orders in a partition of their join, about a million rows


def joined_in_parts(spark: SparkSession, sf: str) -> dict[str, str]:
    """Settings for jobs that join whole flights and write them: as many partitions as the tables need, where the session has fewer.

    A partition's smaller side stays below the bound for hashing and its rows fit a task's memory, so the size doesn't make them spill.
    """
    size = sum(stored_bytes(spark, f"{sf}/{t}.parquet") for t in ("lineitem", "orders"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    return {**SMALL_SIDE_HASHED, "spark.sql.shuffle.partitions": str(parts)}


def _clean_table(spark: SparkSession, sf: str) -> str:
    out = run_folder(spark, "clean")
    # Short legs are dealt out by month; names, delays and caps are added in the task that writes them.
    legs = dealt(views.legs(spark, sf))
    with settings(spark, joined_in_parts(spark, sf)):
        write_parquet(clean.clean_flights(views.flights(spark, sf, legs), measured=flights(spark, sf)), out, deal=False)
    return out


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned flight table, partitioned by year and month; written once while its inputs stay the same."""
    return read_parquet(spark, kept(spark, "clean", sf, lambda: _clean_table(spark, sf)))


def airlines(spark: SparkSession, sf: str) -> DataFrame:
    return dims.airline_dimension(views.carriers(spark, sf))


def named(spark: SparkSession, sf: str) -> DataFrame:
    return dims.join_carrier_left(cleaned(spark, sf), airlines(spark, sf))


def raw_text(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with one free text column: prices, priorities, padded keys."""
    o = table(spark, sf, "orders")
    raw = (
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("string"))
        .when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))
        .otherwise(F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.lit(" ")))
    )
    return o.select("o_orderkey", raw.alias("raw"))


RAW_SQL = """raw_text AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS VARCHAR)
  WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE concat(' ', CAST(o_orderkey AS VARCHAR), ' ') END AS raw
  FROM orders)"""
KEY = ", ".join(FLIGHT_KEY)


# --- casts and projections ------------------------------------------------------------------------------------------

@query("cast_int_via_double", f"""WITH {RAW_SQL}
SELECT o_orderkey, CAST(trunc(TRY_CAST(trim(raw) AS DOUBLE)) AS INT) AS raw FROM raw_text""")
def _(spark, sf):
    return clean.cast_int_via_double(raw_text(spark, sf), ["raw"])


@query("cast_int_direct", f"""WITH {RAW_SQL}
SELECT o_orderkey, CASE WHEN regexp_full_match(trim(raw), '-?[0-9]+') THEN TRY_CAST(trim(raw) AS INT) END AS raw
FROM raw_text""")
def _(spark, sf):
    return clean.cast_int_direct(raw_text(spark, sf), ["raw"])


@query("cast_double_safe", f"WITH {RAW_SQL} SELECT o_orderkey, TRY_CAST(trim(raw) AS DOUBLE) AS raw FROM raw_text")
def _(spark, sf):
    return clean.cast_double_safe(raw_text(spark, sf), ["raw"])


@query("col_drop", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(spark, sf):
    return clean.col_drop(table(spark, sf, "orders"), ["o_totalprice", "o_orderdate", "o_orderpriority", "absent"])


@query("col_rename", "SELECT code AS op_unique_carrier, description AS airline_name FROM carriers", "carriers")
def _(spark, sf):
    return clean.col_rename(
        views.carriers(spark, sf), {"code": "op_unique_carrier", "description": "airline_name"})


@query("col_select_features", f"SELECT {', '.join([*NUMERIC_FEATURES, *CATEGORICAL_FEATURES])}, arr_del15, year "
       "FROM flights", "flights")
def _(spark, sf):
    return clean.col_select_features(flights(spark, sf), NUMERIC_FEATURES, CATEGORICAL_FEATURES, "arr_del15", ["year"])


@query("fill_null_const", f"SELECT {KEY}, coalesce(arr_delay_new, 0) AS arr_delay_new, "
       "coalesce(dep_delay_new, 0) AS dep_delay_new FROM flights", "flights")
def _(spark, sf):
    filled = clean.fill_null_const(flights(spark, sf), ["arr_delay_new", "dep_delay_new", "carrier_delay"])
    return filled.select(*FLIGHT_KEY, "arr_delay_new", "dep_delay_new")


@query("coalesce_delay", f"SELECT {KEY}, coalesce(arr_delay_new, arr_delay) AS arr_delay_min FROM flights", "flights")
def _(spark, sf):
    out = clean.coalesce_delay(flights(spark, sf), "arr_delay_new", "arr_delay", "arr_delay_min")
    return out.select(*FLIGHT_KEY, "arr_delay_min")


@query("clip_p99", f"SELECT {KEY}, arr_delay_clipped, dep_delay_clipped FROM clean", "clean")
def _(spark, sf):
    out = clean.clip_p99(flights(spark, sf), ["arr_delay_new", "dep_delay_new"])
    return out.select(*FLIGHT_KEY, "arr_delay_clipped", "dep_delay_clipped")


@query("case_status", f"""SELECT {KEY}, CASE WHEN arr_delay < 0 THEN 'Early' WHEN arr_delay <= 15 THEN 'On-time'
  ELSE 'Delayed' END AS status FROM flights WHERE arr_delay IS NOT NULL""", "flights")
def _(spark, sf):
    return flights(spark, sf).na.drop(subset=["arr_delay"]).select(*FLIGHT_KEY, labels.status("arr_delay").alias("status"))


SEASON = """CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month IN (3, 4, 5) THEN 'Spring'
  WHEN month IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"""


@query("case_season", f"SELECT month, {SEASON} AS season, count(*) AS count FROM flights GROUP BY 1, 2", "flights")
def _(spark, sf):
    return flights(spark, sf).groupBy("month", labels.season("month").alias("season")).agg(
        F.count(F.lit(1)).alias("count"))


@query("map_labels", """SELECT month, day_of_week, strftime(make_date(2024, month, 1), '%b') AS month_name,
  CASE day_of_week WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tue' WHEN 3 THEN 'Wed' WHEN 4 THEN 'Thu' WHEN 5 THEN 'Fri'
    WHEN 6 THEN 'Sat' ELSE 'Sun' END AS weekday, count(*) AS count FROM flights GROUP BY ALL""", "flights")
def _(spark, sf):
    return flights(spark, sf).groupBy(
        "month", "day_of_week", labels.mapped("month", MONTH_NAMES).alias("month_name"),
        labels.mapped("day_of_week", WEEKDAY_NAMES).alias("weekday")).agg(F.count(F.lit(1)).alias("count"))


# --- filters --------------------------------------------------------------------------------------------------------

@query("drop_null_any", f"SELECT {KEY} FROM flights WHERE diverted IS NOT NULL AND arr_delay IS NOT NULL", "flights")
def _(spark, sf):
    return clean.drop_null_any(flights(spark, sf).select(*FLIGHT_KEY))


@query("drop_null_subset", f"""SELECT {KEY}, dep_delay FROM flights WHERE origin IS NOT NULL AND dest IS NOT NULL
  AND arr_delay IS NOT NULL AND dep_delay IS NOT NULL""", "flights")
def _(spark, sf):
    kept = clean.drop_null_subset(flights(spark, sf), ["origin", "dest", "arr_delay", "dep_delay"])
    return kept.select(*FLIGHT_KEY, "dep_delay")


@query("filter_operated_strict", f"SELECT {KEY} FROM flights WHERE cancelled = 0 AND diverted = 0", "flights")
def _(spark, sf):
    return clean.filter_operated_strict(flights(spark, sf)).select(*FLIGHT_KEY)


@query("filter_operated_lenient", f"SELECT {KEY} FROM flights WHERE cancelled = 0 AND coalesce(diverted, 0) = 0",
       "flights")
def _(spark, sf):
    return clean.filter_operated_lenient(flights(spark, sf)).select(*FLIGHT_KEY)


@query("filter_valid_label", f"SELECT {KEY}, arr_del15 FROM flights WHERE arr_del15 IN (0, 1)", "flights")
def _(spark, sf):
    return clean.filter_valid_label(flights(spark, sf)).select(*FLIGHT_KEY, "arr_del15")


# --- dimension and joins --------------------------------------------------------------------------------------------

@query("win_dedup_first", "SELECT op_unique_carrier, airline_name FROM airlines", "airlines")
def _(spark, sf):
    return airlines(spark, sf)


@query("join_carrier_left", f"""SELECT {', '.join('f.' + c for c in FLIGHT_KEY)},
  coalesce(a.airline_name, f.op_unique_carrier) AS airline_name
FROM flights f LEFT JOIN airlines a ON upper(f.op_unique_carrier) = a.op_unique_carrier""", ("flights", "airlines"))
def _(spark, sf):
    return dims.join_carrier_left(flights(spark, sf), airlines(spark, sf)).select(*FLIGHT_KEY, "airline_name")


@query("join_carrier_absent", f"SELECT {KEY}, op_unique_carrier AS airline_name FROM flights", "flights")
def _(spark, sf):
    return dims.join_carrier_left(flights(spark, sf), None).select(*FLIGHT_KEY, "airline_name")


@query("dq_unmatched_carrier", """SELECT DISTINCT op_unique_carrier FROM flights f
WHERE NOT EXISTS (SELECT 1 FROM airlines a WHERE a.op_unique_carrier = f.op_unique_carrier)""",
       ("flights", "airlines"))
def _(spark, sf):
    return dims.dq_unmatched_carrier(flights(spark, sf), airlines(spark, sf))


PRED_KEYS = ("month", "day_of_month", "day_of_week", "crs_dep_time", "distance")
REPORT_KEY = ("l_orderkey", "l_partkey", "l_linenumber", "op_unique_carrier", "distance")
REPORT_TEXT = "concat_ws('|', l_orderkey, l_partkey, l_linenumber, op_unique_carrier, CAST(distance AS VARCHAR))"
PICKED_SQL = f"""picked AS (SELECT *, {REPORT_TEXT} AS kt FROM flight_scores
  WHERE label = 1 AND prediction = 1 AND p > 0.6 ORDER BY md5(concat({REPORT_TEXT}, '#42')), kt LIMIT 15)"""


def picked(spark, sf):
    return sampling.sample_n(
        ranking.confident_true_positives(views.flight_scores(spark, sf)), 15, REPORT_KEY)


@query("join_pred_to_fact", f"""WITH {PICKED_SQL}
SELECT {', '.join('f.' + c for c in FLIGHT_KEY)}, f.crs_arr_time FROM flights f
JOIN picked p USING (month, day_of_month, day_of_week, crs_dep_time, distance)""", ("flights", "flight_scores"))
def _(spark, sf):
    joined = dims.join_pred_to_fact(flights(spark, sf), picked(spark, sf).select(*PRED_KEYS), PRED_KEYS)
    return joined.select(*FLIGHT_KEY, "crs_arr_time")


@query("join_pred_to_fact_long", f"""WITH p AS (SELECT DISTINCT {', '.join(PRED_KEYS)} FROM flight_scores WHERE p >= 0.9)
SELECT {', '.join('f.' + c for c in FLIGHT_KEY)}, f.crs_arr_time FROM flights f JOIN p USING ({', '.join(PRED_KEYS)})""", ("flights", "flight_scores"))
def _(spark, sf):
    """A list that is joined as a long one, whatever its length: filtered by its keys' bits, then by an exchange."""
    preds = cut_lineage(views.flight_scores(spark, sf).where("p >= 0.9").select(*PRED_KEYS).distinct(), "list")
    return dims.join_pred_to_fact(flights(spark, sf), preds, PRED_KEYS, max_rows=0).select(*FLIGHT_KEY, "crs_arr_time")


@query("join_attach_prob", f"""WITH {PICKED_SQL}
SELECT f.month, f.day_of_month, f.day_of_week, f.distance, f.origin, f.dest, f.arr_delay, q.p FROM flights f
JOIN picked p USING (month, day_of_month, day_of_week, crs_dep_time, distance)
LEFT JOIN picked q ON f.month = q.month AND f.day_of_month = q.day_of_month AND f.day_of_week = q.day_of_week
  AND f.distance = q.distance""", ("flights", "flight_scores"))
def _(spark, sf):
    preds = cut_lineage(picked(spark, sf), "picked")
    found = dims.join_pred_to_fact(flights(spark, sf), preds.select(*PRED_KEYS), PRED_KEYS).select(
        "month", "day_of_month", "day_of_week", "distance", "origin", "dest", "arr_delay")
    return dims.join_attach_prob(found, preds, ["month", "day_of_month", "day_of_week", "distance"])


# --- aggregates -----------------------------------------------------------------------------------------------------

@query("agg_rows_by_month", "SELECT year, month, count(*) AS count FROM flights GROUP BY 1, 2", "flights")
def _(spark, sf):
    return agg.rows_by_month(flights(spark, sf))


AUDIT = ("arr_del15", "cancelled", "diverted")


@query("agg_null_counts", "SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS {c}_nulls" for c in AUDIT)
       + " FROM flights", "flights")
def _(spark, sf):
    return agg.null_counts(flights(spark, sf), AUDIT)


@query("agg_null_audit", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS total, "
    f"round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*)::DOUBLE, 4) AS pct FROM flights" for c in AUDIT), "flights")
def _(spark, sf):
    return agg.null_audit(flights(spark, sf), AUDIT).select("column", "nulls", "total", r("pct"))


@query("agg_value_counts", "SELECT arr_del15, count(*) AS count FROM flights GROUP BY 1", "flights")
def _(spark, sf):
    return agg.counts_of(flights(spark, sf), "arr_del15")


@query("agg_max_raw_vs_clipped", """SELECT max(dep_delay_min) AS max_dep_raw, max(arr_delay_min) AS max_arr_raw,
  max(dep_delay_clipped) AS max_dep_clipped, max(arr_delay_clipped) AS max_arr_clipped FROM clean""", "clean")
def _(spark, sf):
    return agg.max_raw_vs_clipped(cleaned(spark, sf))


@query("agg_summary_stats", """SELECT round(avg(dep_delay_new), 4) AS mean, round(stddev_samp(dep_delay_new), 4) AS std,
  min(dep_delay_new) AS min, quantile_disc(dep_delay_new, 0.25) AS q1, quantile_disc(dep_delay_new, 0.5) AS median,
  quantile_disc(dep_delay_new, 0.75) AS q3, max(dep_delay_new) AS max FROM clean""", "clean")
def _(spark, sf):
    filled = clean.fill_null_const(flights(spark, sf), ["dep_delay_new"])
    out = agg.summary_stats(filled, "dep_delay_new")
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("agg_percentile", """SELECT quantile_disc(dep_delay, 0.5) AS p50, quantile_disc(dep_delay, 0.9) AS p90,
  quantile_disc(dep_delay, 0.99) AS p99, count(dep_delay) AS total FROM flights""", "flights")
def _(spark, sf):
    return exact_quantiles(flights(spark, sf), ["dep_delay"], {"p50": 0.5, "p90": 0.9, "p99": 0.99}).drop("column")


@query("agg_percentile_by_carrier", """SELECT op_unique_carrier, quantile_disc(distance, 0.5) AS p50,
  quantile_disc(distance, 0.99) AS p99, count(distance) AS total FROM flights GROUP BY 1""", "flights")
def _(spark, sf):
    return exact_quantiles(flights(spark, sf), ["distance"], {"p50": 0.5, "p99": 0.99}, ["op_unique_carrier"]).drop("column")


@query("agg_percentile_approx", "SELECT count(dep_delay_new) AS n, true AS within FROM flights", "flights")
def _(spark, sf):
    """The sketch's value and whether its rank is as exact as its accuracy promises."""
    df, accuracy = flights(spark, sf).where(F.col("dep_delay_new").isNotNull()), 10_000
    v = df.withColumn("v", clean.approx_p99(df, "dep_delay_new", accuracy).scalar())
    ranks = v.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("dep_delay_new") < F.col("v")).cast("double")).alias("below"),
                  F.avg((F.col("dep_delay_new") <= F.col("v")).cast("double")).alias("upto"))
    return ranks.select("n", ((F.col("below") <= 0.99 + 1 / accuracy) & (F.col("upto") >= 0.99 - 1 / accuracy)).alias("within"))


@query("agg_iqr_outliers", """WITH q AS (SELECT quantile_disc(dep_delay_new, 0.25) AS q1,
  quantile_disc(dep_delay_new, 0.75) AS q3 FROM clean)
SELECT q1, q3, q3 - q1 AS iqr, q3 + 1.5 * (q3 - q1) AS upper,
  count(*) FILTER (dep_delay_new > q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS total,
  round(100.0::DOUBLE * count(*) FILTER (dep_delay_new > q3 + 1.5 * (q3 - q1)) / count(*), 4) AS pct
FROM clean, q GROUP BY q1, q3""", "clean")
def _(spark, sf):
    filled = clean.fill_null_const(flights(spark, sf), ["dep_delay_new"])
    out = agg.iqr_outliers(filled, "dep_delay_new")
    return out.withColumn("pct", F.round("pct", 4))


@query("agg_clipped_share", """WITH q AS (SELECT quantile_disc(dep_delay_min, 0.99) AS cut FROM clean)
SELECT cut, count(*) FILTER (dep_delay_min > cut) AS clipped, count(*) AS total,
  round(100.0::DOUBLE * count(*) FILTER (dep_delay_min > cut) / count(*), 4) AS pct FROM clean, q GROUP BY cut""", "clean")
def _(spark, sf):
    out = agg.clipped_share(cleaned(spark, sf), "dep_delay_min")
    return out.withColumn("pct", F.round("pct", 4))


NAMED_SQL = """named AS (SELECT c.*, coalesce(a.airline_name, c.op_unique_carrier) AS airline_name
  FROM clean c LEFT JOIN airlines a ON c.op_unique_carrier = a.op_unique_carrier)"""


@query("agg_delay_by_airline", f"""WITH {NAMED_SQL} SELECT airline_name, round(avg(dep_delay_clipped), 4) AS avg_dep_delay,
  round(avg(arr_delay_clipped), 4) AS avg_arr_delay FROM named GROUP BY 1""", ("clean", "airlines"))
def _(spark, sf):
    out = agg.delay_by_airline(named(spark, sf))
    return out.select("airline_name", r("avg_dep_delay"), r("avg_arr_delay")).orderBy(
        F.desc("avg_arr_delay"), "airline_name")


@query("topk_airlines_by_delay", f"""WITH {NAMED_SQL} SELECT airline_name, round(avg(dep_delay_clipped), 4) AS avg_dep_delay,
  round(avg(arr_delay_clipped), 4) AS avg_arr_delay FROM named GROUP BY 1 ORDER BY avg(arr_delay_clipped) DESC, 1 LIMIT 10""",
       ("clean", "airlines"))
def _(spark, sf):
    best = ranking.top_k(agg.delay_by_airline(named(spark, sf)), "avg_arr_delay", ["airline_name"], 10)
    return best.select("airline_name", r("avg_dep_delay"), r("avg_arr_delay"))


VOLUME = """SELECT op_unique_carrier, count(*) AS flight_count, round(avg(arr_delay_clipped), 4) AS avg_arr_delay
FROM clean GROUP BY 1"""


def volume(spark, sf):
    return agg.volume_delay_by_carrier(cleaned(spark, sf))


@query("agg_volume_delay_by_carrier", VOLUME, "clean")
def _(spark, sf):
    return volume(spark, sf).withColumn("avg_arr_delay", F.round("avg_arr_delay", 4))


@query("topk_carriers_by_flights", VOLUME + " ORDER BY count(*) DESC, 1 LIMIT 10", "clean")
def _(spark, sf):
    best = ranking.top_k(volume(spark, sf), "flight_count", ["op_unique_carrier"], 10)
    return best.withColumn("avg_arr_delay", F.round("avg_arr_delay", 4))


@query("topk_carriers_by_delay", VOLUME + " ORDER BY avg(arr_delay_clipped) DESC, 1 LIMIT 10", "clean")
def _(spark, sf):
    best = ranking.top_k(volume(spark, sf), "avg_arr_delay", ["op_unique_carrier"], 10)
    return best.withColumn("avg_arr_delay", F.round("avg_arr_delay", 4))


@query("agg_status_share", """WITH s AS (SELECT CASE WHEN arr_delay < 0 THEN 'Early' WHEN arr_delay <= 15 THEN 'On-time'
  ELSE 'Delayed' END AS status, count(*) AS count FROM flights WHERE arr_delay IS NOT NULL GROUP BY 1)
SELECT status, count, round(count * 100.0::DOUBLE / sum(count) OVER (), 1) AS pct FROM s""", "flights")
def _(spark, sf):
    return agg.status_share(flights(spark, sf))


@query("win_share_of_total", """WITH s AS (SELECT op_unique_carrier, count(*) AS count FROM flights GROUP BY 1)
SELECT op_unique_carrier, count, round(count * 100.0::DOUBLE / sum(count) OVER (), 3) AS pct FROM s""", "flights")
def _(spark, sf):
    counts = flights(spark, sf).groupBy("op_unique_carrier").agg(F.count(F.lit(1)).alias("count"))
    return agg.share_of_total(counts, dp=3)


@query("agg_delay_by_dow", "SELECT day_of_week, round(avg(arr_delay_clipped), 4) AS avg_arr_delay FROM clean GROUP BY 1",
       "clean")
def _(spark, sf):
    return agg.mean_by(cleaned(spark, sf), ["day_of_week"]).select("day_of_week", r("avg_arr_delay")).orderBy("day_of_week")


@query("agg_delay_by_month", """SELECT year, month, printf('%d-%02d', year, month) AS period,
  round(avg(arr_delay_clipped), 4) AS avg_arr_delay FROM clean GROUP BY 1, 2""", "clean")
def _(spark, sf):
    return agg.delay_by_month(cleaned(spark, sf)).select("year", "month", "period", r("avg_arr_delay"))


@query("agg_delay_by_season", f"""SELECT year, {SEASON} AS season, round(avg(arr_delay_clipped), 4) AS avg_arr_delay
FROM clean GROUP BY 1, 2""", "clean")
def _(spark, sf):
    return agg.delay_by_season(cleaned(spark, sf)).select("year", "season", r("avg_arr_delay"))


OD = "SELECT origin, dest, round(avg(arr_delay_clipped), 4) AS avg_delay FROM clean GROUP BY 1, 2"


def od(spark, sf):
    return agg.mean_by(cleaned(spark, sf), ["origin", "dest"], out="avg_delay")


@query("agg_delay_by_od", OD, "clean")
def _(spark, sf):
    return od(spark, sf).withColumn("avg_delay", F.round("avg_delay", 4))


@query("topk_od", OD + " ORDER BY avg(arr_delay_clipped) DESC, 1, 2 LIMIT 50", "clean")
def _(spark, sf):
    best = ranking.top_k(od(spark, sf), "avg_delay", ["origin", "dest"], 50)
    return best.withColumn("avg_delay", F.round("avg_delay", 4))


@query("pivot_od", f"""WITH t AS ({OD} ORDER BY avg(arr_delay_clipped) DESC, 1, 2 LIMIT 50)
SELECT o.origin, d.dest, t.avg_delay FROM (SELECT DISTINCT origin FROM t) o CROSS JOIN (SELECT DISTINCT dest FROM t) d
LEFT JOIN t ON t.origin = o.origin AND t.dest = d.dest""", "clean")
def _(spark, sf):
    best = ranking.top_k(od(spark, sf), "avg_delay", ["origin", "dest"], 50)
    return agg.matrix_cells(agg.pivot_od(best.withColumn("avg_delay", F.round("avg_delay", 4))), "origin", "dest", "avg_delay")


@query("pivot_month_dow", "SELECT day_of_week, " + ", ".join(
    f"round(avg(CASE WHEN month = {m} THEN arr_delay_clipped END), 4) AS m{m}" for m in range(1, 13))
    + " FROM clean GROUP BY 1", "clean")
def _(spark, sf):
    return agg.pivot_month_dow(cleaned(spark, sf)).select("day_of_week", *[r(f"m{m}") for m in range(1, 13)])


@query("agg_corr_pair", "SELECT round(corr(dep_delay_clipped, arr_delay_clipped), 6) AS corr FROM clean", "clean")
def _(spark, sf):
    return agg.corr_pair(cleaned(spark, sf), "dep_delay_clipped", "arr_delay_clipped").select(r("corr", 6))


CORR = (*NUMERIC_FEATURES, "arr_del15")
CORR_FILTER = "arr_del15 IS NOT NULL AND cancelled = 0 AND diverted = 0"


@query("agg_corr_matrix", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM flights WHERE {CORR_FILTER}" for a in CORR for b in CORR)
    + """) SELECT a, b, round(corr, 6) AS corr, CASE WHEN abs(corr) > 0.3 THEN 'Strong' WHEN abs(corr) > 0.1 THEN 'Moderate'
  WHEN corr IS NOT NULL THEN 'Weak' END AS strength FROM c""", "flights")
def _(spark, sf):
    rows = clean.filter_operated_strict(clean.filter_valid_label(flights(spark, sf)))
    return agg.corr_matrix(rows, CORR).withColumn("corr", F.round("corr", 6))


@query("agg_corr_target", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, corr({a}, arr_del15) AS corr FROM flights WHERE {CORR_FILTER}" for a in NUMERIC_FEATURES)
    + ") SELECT a, round(corr, 6) AS corr, row_number() OVER (ORDER BY abs(round(corr, 6)) DESC NULLS LAST, a) AS rank FROM c", "flights")
def _(spark, sf):
    """Each feature's correlation with the label, strongest first."""
    rows = clean.filter_operated_strict(clean.filter_valid_label(flights(spark, sf)))
    return agg.corr_with_target(rows, NUMERIC_FEATURES, "arr_del15")


@query("agg_cardinality", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\" FROM flights" for c in CATEGORICAL_FEATURES), "flights")
def _(spark, sf):
    return agg.cardinality(flights(spark, sf), CATEGORICAL_FEATURES)


def _hist_sql(source: str, col: str, bins: int, by: str | None = None) -> str:
    group = f"{by}, " if by else ""
    return f"""WITH b AS (SELECT min({col}) AS lo, (max({col}) - min({col})) / {bins}.0::DOUBLE AS w FROM {source}),
x AS (SELECT {group}CAST(least(floor(({col} - lo) / w), {bins - 1}) AS INT) AS bin, lo, w FROM {source}, b
  WHERE {col} IS NOT NULL)
SELECT {group}bin, round(min(lo) + bin * min(w), 4) AS lo, round(min(lo) + (bin + 1) * min(w), 4) AS hi,
  count(*) AS count FROM x GROUP BY {group}bin"""


@query("agg_histogram", _hist_sql("clean", "dep_delay_clipped", 50), "clean")
def _(spark, sf):
    return agg.histogram(cleaned(spark, sf), "dep_delay_clipped", 50).withColumns(
        {"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


@query("agg_histogram_raw", _hist_sql("clean", "dep_delay_min", 50), "clean")
def _(spark, sf):
    return agg.histogram(cleaned(spark, sf), "dep_delay_min", 50).withColumns(
        {"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


@query("agg_histogram_by_class", _hist_sql("flights", "distance", 30, "arr_del15"), "flights")
def _(spark, sf):
    return agg.histogram(flights(spark, sf), "distance", 30, "arr_del15").withColumns(
        {"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


SHAPES = ("distance", "crs_dep_time", "crs_arr_time", "crs_elapsed_time", "month", "day_of_week")


@query("agg_histogram_features", " UNION ALL ".join(
    f"(SELECT '{c}' AS \"column\", * FROM ({_hist_sql('flights', c, 30, 'arr_del15')}))" for c in SHAPES), "flights")
def _(spark, sf):
    return agg.histograms(flights(spark, sf), SHAPES, 30, "arr_del15").withColumns(
        {"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


@query("agg_box_stats", """WITH q AS (SELECT op_unique_carrier, quantile_disc(arr_delay_clipped, 0.25) AS q1,
  quantile_disc(arr_delay_clipped, 0.5) AS median, quantile_disc(arr_delay_clipped, 0.75) AS q3 FROM clean GROUP BY 1),
x AS (SELECT c.op_unique_carrier, q1, median, q3, arr_delay_clipped AS v,
  arr_delay_clipped BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok
  FROM clean c JOIN q ON c.op_unique_carrier = q.op_unique_carrier)
SELECT op_unique_carrier, q1, median, q3, min(v) FILTER (ok) AS lo, max(v) FILTER (ok) AS hi,
  count(*) FILTER (NOT ok) AS outliers FROM x GROUP BY 1, 2, 3, 4""", "clean")
def _(spark, sf):
    return agg.box_stats(cleaned(spark, sf), "op_unique_carrier", "arr_delay_clipped")


@query("agg_row_count_delta", """SELECT 0 AS step_no, 'initial' AS step, count(*) AS rows, 100.0::DOUBLE AS pct_of_initial
FROM flights UNION ALL
SELECT 1, 'delays known', count(*) FILTER (arr_delay IS NOT NULL AND dep_delay IS NOT NULL),
  round(100.0::DOUBLE * count(*) FILTER (arr_delay IS NOT NULL AND dep_delay IS NOT NULL) / count(*), 4) FROM flights UNION ALL
SELECT 2, 'operated', count(*) FILTER (arr_delay IS NOT NULL AND dep_delay IS NOT NULL AND cancelled = 0 AND diverted = 0),
  round(100.0::DOUBLE * count(*) FILTER (arr_delay IS NOT NULL AND dep_delay IS NOT NULL AND cancelled = 0 AND diverted = 0)
    / count(*), 4) FROM flights""", "flights")
def _(spark, sf):
    steps = {"delays known": F.col("arr_delay").isNotNull() & F.col("dep_delay").isNotNull(),
             "operated": (F.col("cancelled") == 0) & (F.col("diverted") == 0)}
    return agg.row_count_delta(flights(spark, sf), steps).withColumn("pct_of_initial", F.round("pct_of_initial", 4))


@query("show_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*) AS n, count(*) FILTER ({c} IS NULL) AS nulls, "
    f"round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 4) AS null_pct, count(DISTINCT {c}) AS \"distinct\" "
    "FROM flights" for c, t in (("month", "int"), ("origin", "string"), ("arr_delay", "double"), ("diverted", "int"))),
    "flights")
def _(spark, sf):
    out = agg.show_profile(flights(spark, sf), ["month", "origin", "arr_delay", "diverted"])
    return out.withColumn("null_pct", F.round("null_pct", 4))


# --- announced findings ---------------------------------------------------------------------------------------------

@query("agg_delay_rate_by_airport", """SELECT role, airport, count(*) AS flights, round(avg(arr_del15), 6) AS delay_rate FROM (
  SELECT 'origin' AS role, origin AS airport, arr_del15 FROM flights UNION ALL
  SELECT 'dest', dest, arr_del15 FROM flights) WHERE arr_del15 IS NOT NULL GROUP BY 1, 2""", "flights")
def _(spark, sf):
    return agg.delay_rate_by_airport(flights(spark, sf)).withColumn("delay_rate", F.round("delay_rate", 6))


@query("agg_delay_rate_by_daypart", """SELECT CASE WHEN crs_dep_time < 600 THEN 'night' WHEN crs_dep_time < 1200 THEN 'morning'
  WHEN crs_dep_time < 1800 THEN 'afternoon' ELSE 'evening' END AS day_part, CAST(crs_dep_time // 100 AS BIGINT) AS hour,
  count(*) AS flights, round(avg(arr_del15), 6) AS delay_rate FROM flights WHERE arr_del15 IS NOT NULL GROUP BY 1, 2""", "flights")
def _(spark, sf):
    df = flights(spark, sf).withColumns(
        {"day_part": labels.day_part("crs_dep_time"), "hour": F.floor(F.col("crs_dep_time") / 100)})
    return agg.delay_rate(df, ["day_part", "hour"]).withColumn("delay_rate", F.round("delay_rate", 6))


@query("agg_delay_rate_by_dow", """SELECT day_of_week, day_of_week >= 6 AS weekend, count(*) AS flights,
  round(avg(arr_del15), 6) AS delay_rate FROM flights WHERE arr_del15 IS NOT NULL GROUP BY 1, 2""", "flights")
def _(spark, sf):
    df = flights(spark, sf).withColumn("weekend", F.col("day_of_week") >= 6)
    return agg.delay_rate(df, ["day_of_week", "weekend"]).withColumn("delay_rate", F.round("delay_rate", 6))


@query("agg_delay_rate_by_airline", """WITH g AS (SELECT coalesce(a.airline_name, f.op_unique_carrier) AS airline_name,
  count(*) AS flights, avg(arr_del15) AS rate FROM flights f LEFT JOIN airlines a ON f.op_unique_carrier = a.op_unique_carrier
  WHERE arr_del15 IS NOT NULL GROUP BY 1)
SELECT airline_name, flights, round(rate, 6) AS delay_rate, CASE WHEN rate < 0.15 THEN 'reliable' WHEN rate > 0.25
  THEN 'unreliable' ELSE 'middle' END AS band FROM g""", ("flights", "airlines"))
def _(spark, sf):
    df = dims.join_carrier_left(flights(spark, sf), airlines(spark, sf))
    rates = agg.delay_rate(df, ["airline_name"]).withColumn("band", labels.rate_band("delay_rate"))
    return rates.withColumn("delay_rate", F.round("delay_rate", 6))


# --- sets and ordering ----------------------------------------------------------------------------------------------

@query("union_by_name", f"""SELECT {KEY}, NULL::DOUBLE AS dep_delay, 'x' AS cancellation_code FROM flights WHERE cancelled = 1
UNION ALL SELECT {KEY}, dep_delay, NULL FROM flights WHERE cancelled = 0""", "flights")
def _(spark, sf):
    f = flights(spark, sf)
    off = f.where("cancelled = 1").select(*reversed(FLIGHT_KEY), F.lit("x").alias("cancellation_code"))
    flown = f.where("cancelled = 0").select(*FLIGHT_KEY, "dep_delay")
    return union_by_name([off, flown])


@query("distinct_rows", "SELECT DISTINCT year, month FROM flights", "flights")
def _(spark, sf):
    return flights(spark, sf).select("year", "month").distinct()


@query("sort_by_key", """SELECT DISTINCT f.op_unique_carrier, coalesce(a.airline_name, f.op_unique_carrier) AS airline_name
FROM flights f LEFT JOIN airlines a ON f.op_unique_carrier = a.op_unique_carrier ORDER BY 1""", ("flights", "airlines"))
def _(spark, sf):
    codes = flights(spark, sf).select("op_unique_carrier").distinct()
    return dims.join_carrier_left(codes, airlines(spark, sf)).orderBy("op_unique_carrier")


# --- scalar functions -----------------------------------------------------------------------------------------------

@query("str_normalise_code", r"""SELECT code, upper(trim(regexp_replace(code, '\s*\(\d+\)\s*$', ''))) AS normal FROM carriers""",
       "carriers")
def _(spark, sf):
    return views.carriers(spark, sf).select("code", text.normalise_code("code").alias("normal"))


@query("str_trim_name", "SELECT code, trim(description) AS name FROM carriers", "carriers")
def _(spark, sf):
    return views.carriers(spark, sf).select("code", F.trim("description").alias("name"))


@query("str_concat_period", "SELECT concat(year, '-', month) AS year_month, count(*) AS count FROM flights GROUP BY 1", "flights")
def _(spark, sf):
    return flights(spark, sf).groupBy(text.period_plain("year", "month").alias("year_month")).agg(
        F.count(F.lit(1)).alias("count"))


@query("str_zero_pad", "SELECT printf('%d-%02d', year, month) AS period, count(*) AS count FROM flights GROUP BY 1", "flights")
def _(spark, sf):
    return flights(spark, sf).groupBy(text.period_padded("year", "month").alias("period")).agg(
        F.count(F.lit(1)).alias("count"))


@query("time_hhmm_format", """SELECT crs_dep_time, CASE WHEN crs_dep_time = 0 THEN 'N/A'
  ELSE printf('%02d:%02d', crs_dep_time // 100, crs_dep_time % 100) END AS clock, count(*) AS count FROM flights GROUP BY 1""",
       "flights")
def _(spark, sf):
    return flights(spark, sf).groupBy("crs_dep_time", text.clock("crs_dep_time").alias("clock")).agg(
        F.count(F.lit(1)).alias("count"))


@query("math_round", f"SELECT {KEY}, round(distance, 1) AS d1, round(p * 100, 1) AS pct FROM flight_scores", "flight_scores")
def _(spark, sf):
    return views.flight_scores(spark, sf).select(
        *FLIGHT_KEY, F.round("distance", 1).alias("d1"), F.round(F.col("p") * 100, 1).alias("pct"))


@query("math_fill_round_int", f"SELECT {KEY}, CAST(round_even(coalesce(dep_delay / 2, 0), 0) AS INT) AS half FROM flights",
       "flights")
def _(spark, sf):
    return flights(spark, sf).select(*FLIGHT_KEY, casts.fill_round_int(F.col("dep_delay") / 2).alias("half"))


@query("math_hash_bucket", """SELECT op_unique_carrier, count(*) AS count, 1::BIGINT AS buckets, true AS in_range
FROM flights GROUP BY 1""", "flights")
def _(spark, sf):
    """Rows of each carrier: all in one bucket between 0 and 9,999."""
    b = flights(spark, sf).select("op_unique_carrier", casts.hash_bucket("op_unique_carrier").alias("bucket"))
    return b.groupBy("op_unique_carrier").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("bucket").alias("buckets"), F.bool_and(
        F.col("bucket").between(0, 9999)).alias("in_range"))


@query("ml_hash_index", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count, 1::BIGINT AS codes, true AS in_range FROM flights GROUP BY 2"
    for c in CATEGORICAL_FEATURES), "flights")
def _(spark, sf):
    from latewing.operators.features import hash_index

    coded = hash_index(flights(spark, sf), CATEGORICAL_FEATURES)
    long = coded.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(c).alias("value"), F.col(f"{c}_indexed").alias("code")) for c in CATEGORICAL_FEATURES])))
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("code").alias("codes"), F.bool_and(
        F.col("code").between(0, 9999)).alias("in_range"))


# --- samples and splits ---------------------------------------------------------------------------------------------

SAMPLE_KEY = FLIGHT_KEY
SAMPLE_TEXT = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in SAMPLE_KEY) + ")"


def _bucket_sql(text_sql: str, buckets: int = 10_000) -> str:
    return f"CAST(CAST('0x' || substr(md5(concat({text_sql}, '#42')), 1, 8) AS BIGINT) % {buckets} AS INT)"


def keyed(spark, sf):
    return flights(spark, sf).select(*SAMPLE_KEY, "year", "month")


@query("md5_buckets", f"SELECT {_bucket_sql(SAMPLE_TEXT, 100)} AS bucket, count(*) AS count FROM flights GROUP BY 1", "flights")
def _(spark, sf):
    return keyed(spark, sf).groupBy(md5_bucket(key_text(*SAMPLE_KEY)).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


@query("sample_fraction", f"SELECT {KEY} FROM flights WHERE {_bucket_sql(SAMPLE_TEXT)} < 500", "flights")
def _(spark, sf):
    return sampling.sample_fraction(keyed(spark, sf), 0.05, SAMPLE_KEY).select(*FLIGHT_KEY)


STRATUM_TEXT = SAMPLE_TEXT.replace("concat_ws('|', ", "concat_ws('|', year, month, ", 1)


@query("sample_stratified", f"SELECT year, month, {KEY} FROM flights WHERE {_bucket_sql(STRATUM_TEXT)} < 2000", "flights")
def _(spark, sf):
    return sampling.sample_stratified(keyed(spark, sf), ["year", "month"], 0.2, SAMPLE_KEY)


@query("sample_n", f"SELECT {KEY} FROM flights ORDER BY md5(concat({SAMPLE_TEXT}, '#42')), {SAMPLE_TEXT} LIMIT 10", "flights")
def _(spark, sf):
    return sampling.sample_n(keyed(spark, sf), 10, SAMPLE_KEY).select(*FLIGHT_KEY)


@query("sample_limit", "SELECT event_id, p FROM scored WHERE "
       + _bucket_sql("CAST(event_id AS VARCHAR)") + " < 100 ORDER BY event_id LIMIT 50", "scored")
def _(spark, sf):
    return sampling.sample_limit(views.scored(spark, sf), 0.01, 50, ["event_id"]).select("event_id", "p")


@query("split_random", f"SELECT {KEY}, CASE WHEN {_bucket_sql(SAMPLE_TEXT)} < 8000 THEN 'train' ELSE 'test' END AS part "
       "FROM flights", "flights")
def _(spark, sf):
    train, test = sampling.split_random(keyed(spark, sf), 0.8, SAMPLE_KEY)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).select(
        *FLIGHT_KEY, "part")


@query("split_time", """SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'train' ELSE 'test' END AS part
FROM events""")
def _(spark, sf):
    cut = F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    train, test = sampling.split_time(table(spark, sf, "events").select("event_id", "ts"), "ts", cut)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).select(
        "event_id", "part")
