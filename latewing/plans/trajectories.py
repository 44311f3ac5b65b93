"""Queries on event trajectories and anomaly flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from latewing.operators import anomaly as an, mining, models, neighbours, routes, trajectory as tr
from latewing.operators.aggregates import corr_matrix
from latewing.operators.quantiles import daily_sketches, exact_quantiles, sketched_rank
from latewing.plans.learning import fitted, parts
from latewing.plans.registry import query, r
from latewing.schema import CATEGORICAL_FEATURES, EXPECTED_EVENTS, NUMERIC_FEATURES
from latewing.session import cut_lineage, kept
from latewing.sources import views
from latewing.sources.views import FLIGHT_KEY, table_rows


def events(spark, sf) -> DataFrame:
    return views.trajectory(spark, sf)


def n(spark, sf) -> int:
    return table_rows(spark, sf, "events")


def km_sql(a1: str, o1: str, a2: str, o2: str) -> str:
    return (f"(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({a2} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) "
            f"* pow(sin(radians({o2} - {o1}) / 2), 2)))))")


KM = km_sql("prev_lat", "prev_lon", "lat", "lon")
T = "t AS (SELECT *, epoch_us(ts) AS us FROM trajectory)"
S = T + """, s AS (SELECT *, lag(us) OVER w AS prev_us, lag(event_type) OVER w AS prev_type, lag(event_type, 2) OVER w AS prev2_type,
  lag(lat) OVER w AS prev_lat, lag(lon) OVER w AS prev_lon, lag(altitude) OVER w AS prev_alt, lead(us) OVER w AS next_us,
  lead(lat) OVER w AS next_lat, lead(lon) OVER w AS next_lon,
  row_number() OVER w AS seq_no FROM t WINDOW w AS (PARTITION BY flight_id ORDER BY us, event_id))"""
V = "trajectory"


@query("p_reconstruct", f"WITH {S} SELECT flight_id, seq_no, us, event_id, event_type FROM s", V)
def _(spark, sf):
    return tr.reconstruct(events(spark, sf), n(spark, sf))


@query("p_info_json", "SELECT event_id, CAST(json_extract(info, '$.k') AS INT) AS k FROM trajectory", V)
def _(spark, sf):
    return tr.parse_info(events(spark, sf)).select("event_id", F.col("info_fields.k").alias("k"))


@query("p_airport_pair", f"""WITH {T}, j AS (SELECT *, CAST(json_extract(info, '$.k') AS INT) AS k FROM t)
SELECT flight_id, first(k ORDER BY us, event_id) AS origin_ref, last(k ORDER BY us, event_id) AS dest_ref FROM j
WHERE k IS NOT NULL GROUP BY 1""", V)
def _(spark, sf):
    return tr.airport_pair(events(spark, sf))


@query("p_duration", f"WITH {T} SELECT flight_id, (max(us) - min(us)) / 1e6 AS duration_s, count(*) AS events FROM t GROUP BY 1", V)
def _(spark, sf):
    return tr.duration(events(spark, sf))


@query("p_ground_taxi_time", f"""WITH {S} SELECT flight_id,
  coalesce(sum(us - prev_us) FILTER (prev_type = 'purchase' AND event_type = 'error'), 0) / 1e6 AS landing_to_parking_s,
  coalesce(sum(us - prev_us) FILTER (prev_type = 'click' AND event_type = 'signup'), 0) / 1e6 AS taxi_to_take_off_s
FROM s GROUP BY 1""", V)
def _(spark, sf):
    return tr.ground_taxi_time(events(spark, sf), n(spark, sf))


@query("p_phase_time", f"""WITH {S} SELECT flight_id, event_type, coalesce(sum(next_us - us), 0) / 1e6 AS seconds FROM s
GROUP BY 1, 2""", V)
def _(spark, sf):
    return tr.phase_time(events(spark, sf), n(spark, sf))


@query("p_level_segments", f"""WITH {S}, f AS (SELECT *, CASE WHEN event_type = 'view' AND prev_type IS DISTINCT FROM 'view'
  THEN 1 ELSE 0 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY flight_id ORDER BY us, event_id) AS segment FROM f)
SELECT flight_id, CAST(segment AS BIGINT) AS segment, min(us) AS start_us, max(us) AS end_us, count(*) AS events FROM g
WHERE event_type = 'view' GROUP BY 1, 2""", V)
def _(spark, sf):
    return tr.level_segments(events(spark, sf), rows=n(spark, sf))


@query("p_gap_stats", f"""WITH {S} SELECT flight_id, sum(us - prev_us) / 1e6 / count(prev_us) AS mean_gap_s,
  round(stddev_samp((us - prev_us) / 1e6), 3) AS std_gap_s, max(us - prev_us) / 1e6 AS max_gap_s FROM s GROUP BY 1""", V)
def _(spark, sf):
    return tr.gap_stats(events(spark, sf), n(spark, sf)).withColumn("std_gap_s", F.round("std_gap_s", 3))


@query("p_haversine_distance", f"WITH {S} SELECT flight_id, round(coalesce(sum({KM}), 0), 3) AS distance_km FROM s GROUP BY 1", V)
def _(spark, sf):
    return tr.path_length(events(spark, sf), n(spark, sf)).withColumn("distance_km", F.round("distance_km", 3))


@query("p_altitude_profile", f"""WITH {S}, x AS (SELECT *, CASE WHEN us > prev_us THEN (altitude - prev_alt) / ((us - prev_us) / 6e7) END AS rate
  FROM s)
SELECT flight_id, max(altitude) AS max_alt, round(avg(altitude), 4) AS mean_alt, round(stddev_samp(altitude), 4) AS std_alt,
  round(max(rate) FILTER (rate > 0), 4) AS max_climb_per_min, round(min(rate) FILTER (rate < 0), 4) AS max_descent_per_min,
  round(avg(abs(rate)), 4) AS mean_abs_rate_per_min, round(stddev_samp(altitude) FILTER (event_type = 'view'), 4) AS cruise_std
FROM x GROUP BY 1""", V)
def _(spark, sf):
    out = tr.altitude_profile(events(spark, sf), n(spark, sf))
    return out.select("flight_id", "max_alt", *[r(c) for c in (
        "mean_alt", "std_alt", "max_climb_per_min", "max_descent_per_min", "mean_abs_rate_per_min")], r(F.sqrt("cruise_var"), 4, "cruise_std"))


@query("p_fl_crossings", f"WITH {S} SELECT flight_id, " + ", ".join(
    f"count(*) FILTER (prev_alt < {h} AND altitude >= {h}) AS {name}_up, "
    f"count(*) FILTER (prev_alt >= {h} AND altitude < {h}) AS {name}_down" for name, h in tr.FLIGHT_LEVELS.items())
    + " FROM s GROUP BY 1", V)
def _(spark, sf):
    return tr.level_crossings(events(spark, sf), rows=n(spark, sf))


@query("p_sinuosity", f"""WITH {S}, e AS (SELECT flight_id, coalesce(sum({KM}), 0) AS distance_km,
  first(lat ORDER BY us, event_id) AS a1, first(lon ORDER BY us, event_id) AS o1, last(lat ORDER BY us, event_id) AS a2,
  last(lon ORDER BY us, event_id) AS o2 FROM s GROUP BY 1),
d AS (SELECT *, {km_sql('a1', 'o1', 'a2', 'o2')} AS direct_km FROM e)
SELECT flight_id, round(distance_km, 3) AS distance_km, round(direct_km, 3) AS direct_km,
  round(CASE WHEN direct_km > 0 THEN distance_km / direct_km END, 4) AS sinuosity FROM d""", V)
def _(spark, sf):
    out = tr.sinuosity(events(spark, sf), n(spark, sf))
    return out.select("flight_id", r("distance_km", 3), r("direct_km", 3), r("sinuosity", 4))


def _bearing(a1, o1, a2, o2):
    y = f"sin(radians({o2} - {o1})) * cos(radians({a2}))"
    x = (f"cos(radians({a1})) * sin(radians({a2})) - sin(radians({a1})) * cos(radians({a2})) * cos(radians({o2} - {o1}))")
    return f"((degrees(atan2({y}, {x})) + 360.0::DOUBLE) % 360.0::DOUBLE)"


@query("p_direction_changes", f"""WITH {S}, b AS (SELECT flight_id, abs({_bearing('prev_lat', 'prev_lon', 'lat', 'lon')}
  - {_bearing('lat', 'lon', 'next_lat', 'next_lon')}) AS d FROM s)
SELECT flight_id, count(*) FILTER (d IS NOT NULL AND least(d, 360 - d) > 45) AS turns FROM b GROUP BY 1""", V)
def _(spark, sf):
    return tr.direction_changes(events(spark, sf), rows=n(spark, sf))


@query("p_event_counts", "SELECT flight_id, " + ", ".join(
    f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in EXPECTED_EVENTS) + ", count(*) FILTER (event_type IS NULL OR event_type NOT IN ("
    + ", ".join(f"'{k}'" for k in EXPECTED_EVENTS) + ")) AS n_other FROM trajectory GROUP BY 1", V)
def _(spark, sf):
    return tr.event_counts(events(spark, sf))


@query("p_unusual_altitude", f"""WITH {S}, o AS (SELECT *, abs(altitude - floor(altitude / 1000 + 0.5) * 1000) AS off FROM s)
SELECT flight_id, round(max(off), 4) AS max_off, count(*) FILTER (off > 300) AS events_off,
  coalesce(sum(next_us - us) FILTER (off > 300), 0) / 1e6 AS seconds_off FROM o GROUP BY 1""", V)
def _(spark, sf):
    return tr.unusual_altitude(events(spark, sf), rows=n(spark, sf)).withColumn("max_off", F.round("max_off", 4))


@query("p_go_around", """SELECT flight_id, count(*) FILTER (event_type = 'signup') AS take_offs,
  count(*) FILTER (event_type = 'purchase') AS landings,
  count(*) FILTER (event_type = 'signup') > 1 OR count(*) FILTER (event_type = 'purchase') > 1 AS go_around
FROM trajectory GROUP BY 1""", V)
def _(spark, sf):
    return tr.go_arounds(events(spark, sf))


def by_day(spark, sf) -> DataFrame:
    """One flight per user and day, so that flights differ in the events they show."""
    return events(spark, sf).withColumn("flight_id", F.concat_ws("/", "flight_id", F.to_date("ts")))


DAILY = "d AS (SELECT concat(flight_id, '/', CAST(CAST(ts AS DATE) AS VARCHAR)) AS flight_id, event_type, event_id, ts FROM trajectory)"


@query("p_missing_events", f"WITH {DAILY} SELECT flight_id, concat_ws(',', " + ", ".join(
    f"CASE WHEN NOT bool_or(event_type = '{k}') THEN '{k}' END" for k in EXPECTED_EVENTS) + """) AS missing,
  CAST(5 - count(DISTINCT event_type) AS INT) AS n_missing FROM d GROUP BY 1""", V)
def _(spark, sf):
    out = tr.missing_events(by_day(spark, sf))
    return out.withColumn("missing", F.array_join("missing", ","))


@query("p_long_hold", f"""WITH {S} SELECT flight_id, event_id, prev_type AS prev_event_type, (us - prev_us) / 1e6 AS gap_s FROM s
WHERE us - prev_us > 21600000000 AND prev_type IN ('click', 'error')""", V)
def _(spark, sf):
    return tr.long_hold(events(spark, sf), 6 * 3600.0, rows=n(spark, sf))


@query("p_bad_order", f"""WITH {S} SELECT flight_id, count(*) FILTER (concat(prev_type, '>', event_type) IN ('error>purchase', 'purchase>view'))
  AS violations FROM s GROUP BY 1""", V)
def _(spark, sf):
    return tr.bad_order(events(spark, sf), [("error", "purchase"), ("purchase", "view")], n(spark, sf))


@query("p_ngrams", f"""WITH {S} SELECT 2 AS n, concat(prev_type, '>', event_type) AS gram, count(*) AS count FROM s
WHERE prev_type IS NOT NULL GROUP BY 2 UNION ALL
SELECT 3, concat(prev2_type, '>', prev_type, '>', event_type), count(*) FROM s WHERE prev2_type IS NOT NULL GROUP BY 2""", V)
def _(spark, sf):
    e, rows = events(spark, sf), n(spark, sf)
    return tr.ngram_counts(e, 2, rows).withColumn("n", F.lit(2)).unionByName(
        tr.ngram_counts(e, 3, rows).withColumn("n", F.lit(3)))


@query("p_rare_sequences", f"""WITH {S}, g AS (SELECT flight_id, concat(prev2_type, '>', prev_type, '>', event_type) AS gram FROM s
  WHERE prev2_type IS NOT NULL), c AS (SELECT gram, count(DISTINCT flight_id) AS flights, count(*) AS count FROM g GROUP BY 1)
SELECT * FROM c WHERE flights < 0.35 * (SELECT count(DISTINCT flight_id) FROM s)""", V)
def _(spark, sf):
    return tr.rare_sequences(events(spark, sf), 3, 0.35, n(spark, sf))


def mined_sql(share: float, length: int) -> str:
    """All patterns of daily flights up to a length with their supports, whether frequent, and whether all parts are."""
    out = [f"""{DAILY}, q AS (SELECT flight_id, event_type, row_number() OVER (PARTITION BY flight_id ORDER BY epoch_us(ts), event_id) AS i FROM d),
z AS (SELECT greatest(1, CAST(ceil({share} * count(DISTINCT flight_id)) AS BIGINT)) AS least FROM q)"""]
    for k in range(1, length + 1):
        tables = "q AS q1" + "".join(f" JOIN q AS q{j} ON q{j}.flight_id = q1.flight_id AND q{j}.i > q{j - 1}.i" for j in range(2, k + 1))
        kinds = ", ".join(f"q{j}.event_type AS e{j}" for j in range(1, k + 1))
        out.append(f"o{k} AS (SELECT DISTINCT q1.flight_id, {kinds} FROM {tables})")
        names = [f"e{j}" for j in range(1, k + 1)]
        whole = "concat_ws('>', " + ", ".join(names) + ")"
        parts = " AND ".join(f"concat_ws('>', {', '.join(names[:j] + names[j + 1:])}) IN (SELECT pattern FROM m{k - 1} WHERE frequent)" for j in range(k)) if k > 1 else "true"
        out.append(f"m{k} AS (SELECT *, flights >= (SELECT least FROM z) AS frequent FROM (SELECT {whole} AS pattern, {k} AS length, count(*) AS flights, "
                   f"bool_and({parts}) AS tight FROM o{k} GROUP BY ALL))")
    return ", ".join(out) + ", m AS (" + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(1, length + 1)) + " )"


def mined(spark, sf):
    return kept(spark, "mined", sf, lambda: mining.mine(by_day(spark, sf), 0.02, 4, n(spark, sf)))


@query("p_sequence_mining", f"""WITH {mined_sql(0.02, 4)} SELECT pattern, length, flights, NOT frequent AS rare FROM m WHERE frequent OR tight""", V)
def _(spark, sf):
    """Frequent sequences with gaps, and the rare ones that are frequent in all their parts."""
    m = mined(spark, sf)
    both = mining.frequent_patterns(m).withColumn("rare", F.lit(False)).unionByName(mining.rare_patterns(m).withColumn("rare", F.lit(True)))
    return both.withColumn("pattern", F.array_join("pattern", ">"))


@query("p_rare_flights", f"""WITH {mined_sql(0.02, 4)}, f AS (""" + " UNION ALL ".join(
    f"SELECT flight_id, concat_ws('>', {', '.join(f'e{j}' for j in range(1, k + 1))}) AS pattern FROM o{k}" for k in range(1, 5)) + """)
SELECT flight_id, count(*) AS patterns, min(flights) AS rarest FROM f JOIN m USING (pattern) WHERE tight AND NOT frequent GROUP BY 1""", V)
def _(spark, sf):
    m = mined(spark, sf)
    return mining.rare_flights(m, cut_lineage(mining.rare_patterns(m), "rare"))


STARTS = f"""{T}, p AS (SELECT flight_id, (max(us) - min(us)) / 1e6 AS duration_s, count(*) AS events,
  first(CAST(hour(ts) AS INT) ORDER BY us, event_id) AS start_hour, first(event_type ORDER BY us, event_id) AS first_type
  FROM t GROUP BY 1)"""


@query("p_seq_len_vs_peers", f"""WITH {STARTS} SELECT flight_id, events, first_type,
  round(events - avg(events) OVER (PARTITION BY first_type), 6) AS excess FROM p""", V)
def _(spark, sf):
    out = tr.length_vs_peers(tr.starts(events(spark, sf)), ["first_type"])
    return out.select("flight_id", "events", "first_type", r("excess", 6))


@query("p_markov", f"""WITH {S} SELECT prev_type AS prev_event_type, event_type, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY prev_type)::DOUBLE, 8) AS prob FROM s WHERE prev_type IS NOT NULL GROUP BY 1, 2""", V)
def _(spark, sf):
    return tr.transition_probabilities(events(spark, sf), n(spark, sf)).withColumn("prob", F.round("prob", 8))


@query("p_markov_likelihood", f"""WITH {S}, m AS (SELECT prev_type, event_type,
  count(*) / sum(count(*)) OVER (PARTITION BY prev_type)::DOUBLE AS prob FROM s WHERE prev_type IS NOT NULL GROUP BY 1, 2)
SELECT flight_id, count(*) AS steps, round(sum(ln(prob)), 6) AS log_likelihood, round(sum(ln(prob)) / count(*), 6) AS mean_log_prob
FROM s JOIN m USING (prev_type, event_type) GROUP BY 1""", V)
def _(spark, sf):
    return tr.markov_likelihood(events(spark, sf), n(spark, sf)).select(
        "flight_id", "steps", r("log_likelihood", 6), r("mean_log_prob", 6))


@query("p_peer_zscore", f"""WITH {STARTS} SELECT flight_id, round((duration_s - avg(duration_s) OVER ())
  / nullif(stddev_samp(duration_s) OVER (), 0), 6) AS z_fleet, round((duration_s - avg(duration_s) OVER h)
  / nullif(stddev_samp(duration_s) OVER h, 0), 6) AS z_hour FROM p WINDOW h AS (PARTITION BY start_hour)""", V)
def _(spark, sf):
    fleet = tr.peer_zscore(tr.starts(events(spark, sf)), "duration_s", out="z_fleet")
    both = tr.peer_zscore(fleet, "duration_s", ["start_hour"], "z_hour")
    return both.select("flight_id", r("z_fleet", 6), r("z_hour", 6))


@query("p_percent_rank", f"""WITH {STARTS} SELECT flight_id, events, percent_rank() OVER (ORDER BY events) AS pct_rank FROM p""", V)
def _(spark, sf):
    out = tr.percent_rank(tr.starts(events(spark, sf)).withColumn("size", F.col("events").cast("double")), "size",
                          rows=n(spark, sf))
    return out.select("flight_id", "events", "pct_rank")


@query("p_sketched_rank", f"""WITH {STARTS} SELECT flight_id, events, percent_rank() OVER (ORDER BY duration_s) AS pct_rank, true AS close FROM p""", V)
def _(spark, sf):
    """The rank by merged daily sketches is at most a hundredth and two flights off the exact one."""
    e = events(spark, sf)
    flights = cut_lineage(tr.starts(e).join(e.groupBy("flight_id").agg(F.to_date(F.min("ts")).alias("day")), "flight_id"), "starts")
    days = cut_lineage(daily_sketches(flights, "duration_s", F.col("day")), "sketches")
    both = tr.percent_rank(sketched_rank(flights, "duration_s", days, "near"), "duration_s", rows=n(spark, sf))
    bound = 0.01 + 2 / max(1, flights.count())
    return both.select("flight_id", "events", "pct_rank", (F.abs(F.col("near") - F.col("pct_rank")) <= bound).alias("close"))


@query("p_rolling", f"""WITH {T} SELECT flight_id, event_id, round(avg(altitude) OVER w, 4) AS roll_mean,
  round(stddev_samp(altitude) OVER w, 4) AS roll_std FROM t WINDOW w AS (PARTITION BY flight_id ORDER BY us, event_id
  ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""", V)
def _(spark, sf):
    return tr.rolling(events(spark, sf), 5, rows=n(spark, sf)).select("flight_id", "event_id", r("roll_mean"), r("roll_std"))


@query("p_event_rate", """SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type, count(*) AS events FROM trajectory
GROUP BY 1, 2""", V)
def _(spark, sf):
    return tr.event_rate(events(spark, sf))


@query("p_temporal_patterns", """SELECT CAST(hour(ts) AS INT) AS hour, hour(ts) >= 22 OR hour(ts) < 6 AS night, count(*) AS events,
  count(DISTINCT flight_id) AS flights FROM trajectory GROUP BY 1, 2""", V)
def _(spark, sf):
    return tr.temporal_patterns(events(spark, sf))


@query("p_daily_counts", """SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT flight_id) AS flights FROM trajectory
GROUP BY 1""", V)
def _(spark, sf):
    return tr.daily_counts(events(spark, sf))


@query("p_dq_report", f"""WITH {DAILY}, c AS (SELECT count(*) - 1 AS extra FROM d GROUP BY flight_id, event_type),
f AS (SELECT count(*) FILTER (event_type = 'signup') AS a, count(*) FILTER (event_type = 'purchase') AS b FROM d GROUP BY flight_id)
SELECT count(*) AS events, count(*) FILTER (event_id % 97 = 0) AS missing_values, count(*) FILTER (event_id % 89 = 0) AS corrupt_info,
  (SELECT CAST(sum(extra) AS BIGINT) FROM c) AS duplicates, (SELECT count(*) FROM f) AS flights,
  (SELECT count(*) FROM f WHERE a = 0 OR b = 0) AS incomplete_flights FROM d""", V)
def _(spark, sf):
    """Some events without an altitude, some with an ``info`` that is cut off."""
    broken = by_day(spark, sf).withColumns({
        "altitude": F.when(F.col("event_id") % 97 != 0, F.col("altitude")), "info": F.when(F.col("event_id") % 89 == 0, '{"k":').otherwise(F.col("info"))})
    return tr.dq_report(broken, ["flight_id", "event_type"])


@query("p_teleport", f"""WITH {S}, x AS (SELECT *, {KM} AS km, CASE WHEN us > prev_us THEN {KM} / ((us - prev_us) / 3.6e9) END AS kmh FROM s)
SELECT flight_id, event_id, round(km, 4) AS km, round(kmh, 3) AS kmh FROM x WHERE kmh > 2000""", V)
def _(spark, sf):
    return tr.teleports(events(spark, sf), 2000.0, n(spark, sf)).select("flight_id", "event_id", r("km", 4), r("kmh", 3))


@query("p_dedup_events", f"WITH {DAILY} SELECT flight_id, event_type, min(event_id) AS event_id, count(*) AS copies FROM d GROUP BY 1, 2", V)
def _(spark, sf):
    return tr.dedup_events(by_day(spark, sf), ["flight_id", "event_type"])


# --- flight features and anomalies ----------------------------------------------------------------------------------

FEATS = f"""{S}, feats AS (SELECT flight_id, count(*) AS events, (max(us) - min(us)) / 1e6 AS duration_s,
  coalesce(sum(us - prev_us) / 1e6 / count(prev_us), 0) AS mean_gap_s, coalesce(max(us - prev_us) / 1e6, 0) AS max_gap_s,
  coalesce(sum({KM}), 0) AS distance_km, max(altitude) AS max_alt, avg(altitude) AS mean_alt,
  coalesce(stddev_samp(altitude), 0) AS std_alt, count(*) FILTER (event_type = 'signup') AS take_offs,
  count(*) FILTER (event_type = 'purchase') AS landings, count(DISTINCT event_type) AS kinds FROM s GROUP BY 1)"""


def feats(spark, sf) -> DataFrame:
    """The flight feature table, written once while the inputs stay the same: every detector reads it several times."""
    return kept(spark, "feats", sf, lambda: cut_lineage(an.flight_features(events(spark, sf), n(spark, sf)), "feats"))


@query("p_flight_features", f"""WITH {FEATS} SELECT flight_id, events, duration_s, mean_gap_s, max_gap_s, round(distance_km, 3) AS distance_km,
  max_alt, round(mean_alt, 4) AS mean_alt, round(std_alt, 4) AS std_alt, take_offs, landings, CAST(kinds AS INT) AS kinds FROM feats""", V)
def _(spark, sf):
    return an.flight_features(events(spark, sf), n(spark, sf)).withColumns({
        "distance_km": F.round("distance_km", 3), "mean_alt": F.round("mean_alt", 4), "std_alt": F.round("std_alt", 4)})


@query("p_interaction", f"WITH {FEATS} SELECT flight_id, max_alt * duration_s AS max_alt_x_duration_s FROM feats", V)
def _(spark, sf):
    return an.interaction(feats(spark, sf), [("max_alt", "duration_s")]).select("flight_id", "max_alt_x_duration_s")


@query("p_standardise", f"""WITH {FEATS} SELECT flight_id, {', '.join(
    f'round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0), 5) AS {c}' for c in an.FEATURES)} FROM feats""", V)
def _(spark, sf):
    return an.standardise(feats(spark, sf), an.FEATURES).select("flight_id", *[r(c, 5) for c in an.FEATURES])


@query("p_feature_corr", f"WITH {FEATS}, c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM feats" for a in an.FEATURES for b in an.FEATURES)
    + """) SELECT a, b, round(corr, 6) AS corr, CASE WHEN abs(corr) > 0.3 THEN 'Strong' WHEN abs(corr) > 0.1 THEN 'Moderate'
  WHEN corr IS NOT NULL THEN 'Weak' END AS strength FROM c""", V)
def _(spark, sf):
    return corr_matrix(feats(spark, sf), an.FEATURES).withColumn("corr", F.round("corr", 6))


def prune_sql(limit: float) -> str:
    """Which features stay, decided in their order from the matrix: one common table expression a feature."""
    cells = ", ".join(f"corr({a}, {b}) AS r_{i}_{j}" for j, b in enumerate(an.FEATURES) for i, a in enumerate(an.FEATURES[:j]))
    out = [f"{FEATS}, k0 AS (SELECT *, true AS s0 FROM (SELECT {cells} FROM feats))"]
    for j in range(1, len(an.FEATURES)):
        apart = " AND ".join(f"(NOT s{i} OR coalesce(abs(r_{i}_{j}) <= {limit}, true))" for i in range(j))
        out.append(f"k{j} AS (SELECT *, {apart} AS s{j} FROM k{j - 1})")
    rows = " UNION ALL ".join(f"SELECT {j} AS position, '{c}' AS feature, s{j} AS stays FROM k{len(an.FEATURES) - 1}" for j, c in enumerate(an.FEATURES))
    return f"WITH {', '.join(out)} SELECT position, feature FROM ({rows}) WHERE stays"


@query("p_corr_prune", prune_sql(0.8), V)
def _(spark, sf):
    """The features that stay, with their places in the list."""
    names = an.corr_prune(feats(spark, sf), an.FEATURES, 0.8)
    return spark.createDataFrame([(i, c) for i, c in enumerate(an.FEATURES) if c in names], "position int, feature string")


FLAGS = f"""{FEATS}, q AS (SELECT quantile_disc(duration_s, 0.95) AS qd, quantile_disc(max_alt, 0.95) AS qa FROM feats),
flags AS (SELECT flight_id, duration_s > qd AS long_duration, max_alt > qa AS extreme_altitude, landings > 15 AS go_around,
  kinds < 5 AS missing_events, max_gap_s > 172800 AS long_hold FROM feats, q)"""
N_FLAGS = " + ".join(f"{k}::INT" for k in an.RULES)


def flags(spark, sf) -> DataFrame:
    return an.rule_flags(feats(spark, sf), 0.95, 15, 172800.0)


@query("p_rule_anomalies", f"WITH {FLAGS} SELECT *, {N_FLAGS} AS n_flags FROM flags", V)
def _(spark, sf):
    return flags(spark, sf)


@query("p_anomaly_taxonomy", f"WITH {FLAGS} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, count(*) FILTER ({k}) AS flights FROM flags" for k in an.RULES) + ") WHERE flights > 0", V)
def _(spark, sf):
    return an.taxonomy_counts(flags(spark, sf))


# --- routes, holdings, aborted take-offs ----------------------------------------------------------------------------

POINTS, USUAL = 6, 4


def frechet_sql(points: int, candidates: int) -> str:
    """The dynamic programme of the discrete Fréchet distance, one common table expression a diagonal."""
    at = [f"(({i} * (n - 1)) // {points - 1} + 1)" for i in range(points)]
    ends = ", ".join(f"max(lat) FILTER (seq_no = {x}) AS a{i}, max(lon) FILTER (seq_no = {x}) AS o{i}" for i, x in enumerate(at))
    gaps = ", ".join(f"{km_sql(f'f.a{i}', f'f.o{i}', f'c.a{j}', f'c.o{j}')} AS d_{i}_{j}" for i in range(points) for j in range(points))
    out = [f"""{S}, ends AS (SELECT flight_id, {ends} FROM (SELECT *, count(*) OVER (PARTITION BY flight_id) AS n FROM s) GROUP BY 1),
region AS (SELECT flight_id, first(k ORDER BY us, event_id) // 50 AS origin, last(k ORDER BY us, event_id) // 50 AS dest
  FROM (SELECT *, CAST(json_extract(info, '$.k') AS INT) AS k FROM t) WHERE k IS NOT NULL GROUP BY 1),
f AS (SELECT * FROM ends JOIN region USING (flight_id)),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin, dest ORDER BY md5(concat(flight_id, '#42')), flight_id) AS cn FROM f) WHERE cn <= {candidates}),
g0 AS (SELECT *, d_0_0 AS c_0_0 FROM (SELECT f.flight_id, f.origin, f.dest, c.flight_id AS cid, {gaps} FROM f JOIN cand c ON f.origin = c.origin AND f.dest = c.dest))"""]
    for k in range(1, 2 * points - 1):
        cols = []
        for i in range(max(0, k - points + 1), min(k, points - 1) + 1):
            j = k - i
            before = [f"c_{a}_{b}" for a, b in ((i - 1, j), (i - 1, j - 1), (i, j - 1)) if a >= 0 and b >= 0]
            cols.append(f"greatest(d_{i}_{j}, least({', '.join(before)})) AS c_{i}_{j}")
        out.append(f"g{k} AS (SELECT *, {', '.join(cols)} FROM g{k - 1})")
    last = f"g{2 * points - 2}"
    out.append(f"""km AS (SELECT flight_id, origin, dest, cid, c_{points - 1}_{points - 1} AS km FROM {last}),
usual AS (SELECT origin, dest, arg_min(cid, (mean, cid)) AS usual FROM (SELECT origin, dest, cid, avg(km) AS mean FROM km GROUP BY ALL) GROUP BY 1, 2),
route AS (SELECT k.flight_id, k.origin, k.dest, u.usual, k.km AS deviation_km FROM km k JOIN usual u ON k.origin = u.origin AND k.dest = u.dest AND k.cid = u.usual)""")
    return ", ".join(out)


def route(spark, sf) -> DataFrame:
    """Deviations between regions of fifty airports: the test table has a flight or none between two airports."""
    e, rows = events(spark, sf), n(spark, sf)
    region = tr.airport_pair(e).selectExpr("flight_id", "origin_ref div 50 AS origin", "dest_ref div 50 AS dest")
    flights = cut_lineage(routes.paths(e, POINTS, rows).join(region, "flight_id"), "paths")
    return routes.route_deviation(flights, ["origin", "dest"], POINTS, USUAL)


@query("p_route_deviation", f"WITH {frechet_sql(POINTS, USUAL)} SELECT flight_id, origin, dest, usual, round(deviation_km, 6) AS deviation_km FROM route", V)
def _(spark, sf):
    return route(spark, sf).withColumn("deviation_km", F.round("deviation_km", 6)).withColumns({c: F.col(c).cast("int") for c in ("origin", "dest")})


def bearing_sql(a1: str, o1: str, a2: str, o2: str) -> str:
    y = f"sin(radians({o2} - {o1})) * cos(radians({a2}))"
    x = f"cos(radians({a1})) * sin(radians({a2})) - sin(radians({a1})) * cos(radians({a2})) * cos(radians({o2} - {o1}))"
    return f"fmod(degrees(atan2({y}, {x})) + 360, 360)"


BACK, NEAR_KM = 6, 3000.0
LOOPS = " OR ".join(
    f"coalesce({km_sql(f'lag(lat, {j}) OVER w', f'lag(lon, {j}) OVER w', 'lat', 'lon')} <= {NEAR_KM} AND us - lag(us, {j}) OVER w <= 864000000000 "
    f"AND abs(lag(turned, 1) OVER w - lag(turned, {j}) OVER w) >= 300, false)" for j in range(2, BACK + 1))
HOLDS = f"""b AS (SELECT *, coalesce(fmod({bearing_sql('lat', 'lon', 'next_lat', 'next_lon')} - {bearing_sql('prev_lat', 'prev_lon', 'lat', 'lon')} + 540, 360) - 180, 0) AS turn FROM s),
c AS (SELECT *, sum(turn) OVER (PARTITION BY flight_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS turned FROM b),
l AS (SELECT *, {LOOPS} AS closes FROM c WINDOW w AS (PARTITION BY flight_id ORDER BY us, event_id)),
holds AS (SELECT flight_id, count(*) FILTER (closes) AS loops, sum(turn) AS turned, max(abs(turned)) AS widest FROM l GROUP BY 1)"""


def holds(spark, sf) -> DataFrame:
    return routes.holding_patterns(events(spark, sf), NEAR_KM, 300.0, BACK, 864_000.0, n(spark, sf))


@query("p_cumulated_turns", f"WITH {S}, {HOLDS} SELECT flight_id, event_id, round(turn, 5) AS turn, round(turned, 5) AS turned FROM c", V)
def _(spark, sf):
    return routes.cumulated_turns(events(spark, sf), n(spark, sf)).select("flight_id", "event_id", r("turn", 5), r("turned", 5))


@query("p_holding_patterns", f"WITH {S}, {HOLDS} SELECT flight_id, loops, round(turned, 5) AS turned, round(widest, 5) AS widest FROM holds", V)
def _(spark, sf):
    return holds(spark, sf).select("flight_id", "loops", r("turned", 5), r("widest", 5))


@query("p_aborted_take_offs", f"""WITH {S} SELECT flight_id, count(*) FILTER (prev_type = 'signup' AND event_type IN ('click', 'error')) AS aborted FROM s GROUP BY 1""", V)
def _(spark, sf):
    return routes.aborted_take_offs(events(spark, sf), rows=n(spark, sf))


ROUTE_RULES = ("route_deviation", "holding", "aborted_take_off")


@query("p_trajectory_taxonomy", f"""WITH {frechet_sql(POINTS, USUAL)}, {HOLDS}, q AS (SELECT quantile_disc(deviation_km, 0.9) AS far FROM route),
a AS (SELECT flight_id, count(*) FILTER (prev_type = 'signup' AND event_type IN ('click', 'error')) AS aborted FROM s GROUP BY 1)
SELECT flight_id, concat_ws(',', CASE WHEN deviation_km > far THEN 'route_deviation' END, CASE WHEN loops > 3 THEN 'holding' END,
  CASE WHEN aborted > 8 THEN 'aborted_take_off' END) AS kinds FROM holds JOIN a USING (flight_id) LEFT JOIN route USING (flight_id), q""", V)
def _(spark, sf):
    """Kinds of anomaly in where a flight went; flights that have none are listed too."""
    far = cut_lineage(route(spark, sf), "routes")
    cut = exact_quantiles(far, ["deviation_km"], {"q": 0.9}).select("q").scalar()
    away = far.withColumn("q", cut).select("flight_id", (F.col("deviation_km") > F.col("q")).alias("route_deviation"))
    told = holds(spark, sf).join(routes.aborted_take_offs(events(spark, sf), rows=n(spark, sf)), "flight_id").join(away, "flight_id", "left")
    flags = told.select("flight_id", "route_deviation", (F.col("loops") > 3).alias("holding"), (F.col("aborted") > 8).alias("aborted_take_off"))
    return an.taxonomy(flags, ROUTE_RULES).withColumn("kinds", F.array_join("kinds", ","))


@query("p_inject_anomalies", f"""WITH {T}, b AS (SELECT *, CAST(CAST('0x' || substr(md5(concat(flight_id, '#42')), 1, 8) AS BIGINT) % 100 AS INT)
  AS bucket, min(us) OVER (PARTITION BY flight_id) AS first_us FROM t)
SELECT flight_id, event_id, CASE WHEN bucket < 5 THEN 2 * us - first_us ELSE us END AS us,
  CASE WHEN bucket < 5 THEN 'stretched' WHEN bucket < 10 THEN 'dropped' END AS injected FROM b
WHERE NOT (bucket >= 5 AND bucket < 10 AND event_type = 'purchase')""", V)
def _(spark, sf):
    return an.inject_anomalies(events(spark, sf)).select("flight_id", "event_id", "us", "injected")


PLANTED = -1


def with_planted(f: DataFrame) -> DataFrame:
    """The flights and one more, eight deviations off in every feature, up and down in turn: no detector may miss it."""
    odd = f.agg(*[(F.avg(c) + F.stddev(c) * (8 if i % 2 else -8)).cast(f.schema[c].dataType).alias(c) for i, c in enumerate(an.FEATURES)])
    return f.select("flight_id", *an.FEATURES).unionByName(odd.withColumn("flight_id", F.lit(PLANTED).cast(f.schema["flight_id"].dataType)))


#: ``fair``: flagged exactly by the method's own rule, and for the planted flight also flagged and before all others.
SCORED_ONCE = f"SELECT flight_id, true AS scored, false AS planted, true AS fair FROM trajectory GROUP BY 1 UNION ALL SELECT {PLANTED}, true, true, true"


def judged(out: DataFrame, score: str, scored, due) -> DataFrame:
    first = out.where(F.col("flight_id") != PLANTED).agg(F.max(score)).scalar()
    planted = F.col("flight_id") == PLANTED
    leads = ~planted | ((F.col(score) > F.col("_first")) & F.col("outlier"))
    return out.withColumn("_first", first).select("flight_id", scored.alias("scored"), planted.alias("planted"), ((F.col("outlier") == due) & leads).alias("fair"))


@query("p_kmeans_outliers", SCORED_ONCE, V)
def _(spark, sf):
    """Small clusters and far flights are flagged, no others."""
    out = cut_lineage(an.kmeans_outliers(with_planted(feats(spark, sf)), normal=feats(spark, sf)), "kmeans")
    far = out.agg(F.struct(F.avg("distance").alias("m"), F.stddev("distance").alias("s"), F.count("distance").alias("n"))).scalar()
    small = F.col("cluster_size") < 0.01 * F.col("f.n")
    due = (F.col("distance") > F.col("f.m") + 3 * F.col("f.s")) | small
    return judged(out.withColumn("f", far), "distance", F.col("distance") >= 0, due)


@query("p_isolation_forest", SCORED_ONCE, V)
def _(spark, sf):
    """Scores in (0, 1); no unflagged flight scores above a flagged one."""
    out = an.isolation_forest(with_planted(feats(spark, sf)), contamination=0.1)
    low = out.agg(F.max(F.when(~F.col("outlier"), F.col("score")))).scalar()
    return judged(out.withColumn("low", low), "score", (F.col("score") > 0) & (F.col("score") < 1), F.col("score") > F.col("low"))


@query("p_pca_recon", SCORED_ONCE, V)
def _(spark, sf):
    """More components never leave a larger error; the largest errors are flagged."""
    f = with_planted(feats(spark, sf))
    less, more = (an.pca_reconstruction(f, k=k, normal=feats(spark, sf)) for k in (3, 5))
    both = cut_lineage(less.join(more.withColumnRenamed("error", "finer"), "flight_id"), "errors")
    cut = exact_quantiles(both, ["error"], {"q": 0.9}).select("q").scalar()
    flagged = both.withColumn("q", cut).withColumn("outlier", F.col("error") > F.col("q"))
    return judged(flagged, "error", (F.col("error") >= 0) & (F.col("finer") <= F.col("error") + 1e-9), F.col("error") > F.col("q"))


@query("p_grid_density", f"""WITH {FEATS}, z AS (SELECT flight_id, floor((duration_s - avg(duration_s) OVER ()) / stddev_samp(duration_s) OVER () / 0.5) AS x,
  floor((max_alt - avg(max_alt) OVER ()) / stddev_samp(max_alt) OVER () / 0.5) AS y FROM feats),
c AS (SELECT x, y, count(*) AS k FROM z GROUP BY 1, 2)
SELECT z.flight_id, CAST(sum(c.k) AS BIGINT) AS density FROM z JOIN c ON abs(z.x - c.x) <= 1 AND abs(z.y - c.y) <= 1 GROUP BY 1""", V)
def _(spark, sf):
    return an.grid_density(feats(spark, sf), ["duration_s", "max_alt"])


def knn_sql(k: int) -> str:
    """Exact neighbours over all standardised features, and the local outlier factor."""
    z = ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0) AS {c}" for c in an.FEATURES)
    gap = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in an.FEATURES)
    return f"""{FEATS}, z AS (SELECT flight_id, {z} FROM feats),
pairs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY distance, neighbour) AS rank FROM (
  SELECT a.flight_id, b.flight_id AS neighbour, sqrt({gap}) AS distance FROM z a JOIN z b ON a.flight_id != b.flight_id)) WHERE rank <= {k}),
far AS (SELECT flight_id, max(distance) AS k_distance FROM pairs GROUP BY 1),
dense AS (SELECT p.flight_id, count(*) / greatest(sum(greatest(p.distance, f.k_distance)), 1e-9) AS density
  FROM pairs p JOIN far f ON f.flight_id = p.neighbour GROUP BY 1),
lof AS (SELECT p.flight_id, string_agg(p.neighbour, ',' ORDER BY p.rank) AS neighbours, avg(d.density) / any_value(o.density) AS lof, any_value(o.density) AS density
  FROM pairs p JOIN dense d ON d.flight_id = p.neighbour JOIN dense o ON o.flight_id = p.flight_id GROUP BY 1)"""


@query("p_knn_density", f"""WITH {knn_sql(10)} SELECT flight_id, neighbours, round(k_distance, 6) AS k_distance, round(density, 6) AS density, round(lof, 6) AS lof
FROM lof JOIN far USING (flight_id)""", V)
def _(spark, sf):
    out = neighbours.local_outliers(feats(spark, sf), an.FEATURES, 10)
    return out.select("flight_id", F.array_join("neighbours", ",").alias("neighbours"), r("k_distance", 6), r("density", 6), r("lof", 6))


@query("p_ensemble_vote", f"""WITH {FLAGS}, v AS (SELECT flight_id, {N_FLAGS} AS k FROM flags)
SELECT flight_id, CAST(k AS BIGINT) AS votes, k >= 2 AS anomalous FROM v""", V)
def _(spark, sf):
    f = cut_lineage(flags(spark, sf), "flags")
    return an.ensemble_vote({k: f.select("flight_id", F.col(k).alias("flag")) for k in an.RULES})


@query("p_method_vote", f"""WITH {FLAGS} SELECT flight_id, {N_FLAGS} >= 2 AS rules, false AS planted, true AS adds_up FROM flags
UNION ALL SELECT {PLANTED}, false, true, true""", V)
def _(spark, sf):
    """Flights flagged by rules, clusters, reconstruction error, local density and forest, each with a vote; two are enough.

    ``adds_up``: the votes are those of the written flags; the planted flight has at least two of them.
    """
    f = with_planted(feats(spark, sf))
    error = cut_lineage(an.pca_reconstruction(f, normal=feats(spark, sf)), "errors")
    lof = cut_lineage(neighbours.local_outliers(f, an.FEATURES, 10), "factors")
    far = exact_quantiles(error, ["error"], {"q": 0.9}).select("q").scalar()
    lonely = exact_quantiles(lof, ["lof"], {"q": 0.9}).select("q").scalar()
    broken = reduce(lambda a, b: a + b, [F.col(k).cast("int") for k in an.RULES])
    flag = lambda c: F.coalesce(c, F.lit(False)).alias("flag")
    rules = flags(spark, sf).select("flight_id", flag(broken >= 2))
    methods = {
        "rules": rules.unionByName(f.where(F.col("flight_id") == PLANTED).select("flight_id", F.lit(False).alias("flag"))),
        "clusters": an.kmeans_outliers(f, normal=feats(spark, sf)).select("flight_id", flag(F.col("outlier"))),
        "error": error.withColumn("q", far).select("flight_id", flag(F.col("error") > F.col("q"))),
        "density": lof.withColumn("q", lonely).select("flight_id", flag(F.col("lof") > F.col("q"))),
        "forest": an.isolation_forest(f, contamination=0.1).select("flight_id", flag(F.col("outlier"))),
    }
    methods = {k: cut_lineage(df, k) for k, df in methods.items()}
    votes, own = an.ensemble_vote(methods), methods["rules"].withColumnRenamed("flag", "rules")
    for k in ("clusters", "error", "density", "forest"):
        own = own.join(methods[k].withColumnRenamed("flag", k), "flight_id")
    planted, total = F.col("flight_id") == PLANTED, reduce(lambda a, b: a + b, [F.col(k).cast("int") for k in methods])
    right = (F.col("votes") == total) & (F.col("anomalous") == (total >= 2)) & (~planted | F.col("anomalous"))
    return own.join(votes, "flight_id").select("flight_id", "rules", planted.alias("planted"), right.alias("adds_up"))


@query("p_permutation_importance", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, true AS in_range, true AS adds_up" for c in (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES)))
def _(spark, sf):
    model, test = fitted(spark, sf, "rf").model, parts(spark, sf)[1]
    cols = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
    out = an.permutation_importance(lambda df: models.predict(model, df), test, cols, FLIGHT_KEY, table_rows(spark, sf, "lineitem"))
    return out.select("feature", (F.col("auc_roc").between(0, 1) & F.col("base_auc").between(0, 1)).alias("in_range"), (
        F.abs(F.col("base_auc") - F.col("auc_roc") - F.col("importance")) < 1e-12).alias("adds_up"))


def _period(e: DataFrame, first: bool, rows: int) -> DataFrame:
    cut = F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    part = e.where(F.col("ts") < cut) if first else e.where(F.col("ts") >= cut)
    marked = an.rule_flags(cut_lineage(an.flight_features(part, rows), "period"), 0.9)
    return marked.select("flight_id", F.col("long_duration").alias("flag"))


@query("p_stability", """WITH d AS (SELECT flight_id, ts < TIMESTAMP '2024-01-16' AS early, epoch_us(max(ts)) - epoch_us(min(ts)) AS us
  FROM trajectory GROUP BY 1, 2),
q AS (SELECT early, quantile_disc(us, 0.9) AS cut FROM d GROUP BY 1),
f AS (SELECT flight_id, bool_or(d.early) AS a, bool_or(NOT d.early) AS b FROM d JOIN q ON d.early = q.early WHERE us > cut GROUP BY 1)
SELECT count(*) FILTER (a) AS flagged_a, count(*) FILTER (b) AS flagged_b, count(*) FILTER (a AND b) AS in_both, count(*) AS in_any,
  count(*) FILTER (a AND b)::DOUBLE / nullif(count(*), 0) AS jaccard FROM f""", V)
def _(spark, sf):
    e, rows = events(spark, sf), n(spark, sf)
    return an.stability([_period(e, True, rows), _period(e, False, rows)])
