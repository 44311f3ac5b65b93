"""Queries that replay the shared tables as streams until everything is processed, then read the result tables."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from latewing.operators import models, ranking
from latewing.operators.features import prepared_features
from latewing.plans.files import message_sql, route_messages
from latewing.plans.flights import KEY, flights, joined_in_parts
from latewing.plans.learning import SLOTS, fitted
from latewing.plans.registry import query, r
from latewing.schema import CATEGORICAL_FEATURES, INT_FEATURES, NUMERIC_FEATURES
from latewing.session import kept, run_folder, settings
from latewing.sources import views
from latewing.sources.messages import parse_messages
from latewing.sources.views import FLIGHT_KEY
from latewing.streaming import events as ev, scoring

#: Rows of a file to be replayed: small beside a micro-batch, whose size is bounded by bytes, and many enough for all cores.
FILE_ROWS = 50_000


def as_files(df: DataFrame, label: str) -> str:
    """Write a table as files to be replayed."""
    out = run_folder(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", FILE_ROWS).parquet(out)
    return out


def replay(df: DataFrame, label: str) -> DataFrame:
    return scoring.replay(df.sparkSession, as_files(df, label), df.schema, None)


def in_event_time(df: DataFrame, label: str, slices: int = 8) -> str:
    """Files whose order is that of event time, as a live source's: a slice of time each, one written after the other.

    The last one holds a single event long after all others, as a source that has come to its end would send: it closes all windows.
    """
    out = run_folder(df.sparkSession, label)
    lo, hi = df.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        df.write.parquet(out)
        return out
    width = (hi - lo) / slices
    for i in range(slices):
        here = F.col("ts") >= F.lit(lo + i * width)
        df.where(here & (F.col("ts") < F.lit(lo + (i + 1) * width)) if i < slices - 1 else here).write.mode("append").parquet(out)
    last = df.limit(1).withColumns({"ts": F.lit(hi + timedelta(days=CLOSING_DAYS)).cast(df.schema["ts"].dataType), "event_id": F.lit(CLOSING).cast("bigint")})
    last.coalesce(1).write.mode("append").parquet(out)
    return out


CLOSING, CLOSING_DAYS = -1, 30


def closing_time(spark, sf):
    """The time of the closing event; results from then on are its own."""
    return events_of(spark, sf).agg(F.max("ts").cast("timestamp") + F.expr(f"INTERVAL {CLOSING_DAYS} DAYS")).scalar()


def closing_hour(spark, sf):
    return F.date_trunc("hour", closing_time(spark, sf))


def events_of(spark, sf) -> DataFrame:
    return views.trajectory(spark, sf)


FEATURES = (*NUMERIC_FEATURES, *CATEGORICAL_FEATURES)


def finish(query_handle) -> None:
    query_handle.awaitTermination()


def appended(stream: DataFrame, label: str) -> DataFrame:
    out = run_folder(stream.sparkSession, label)
    finish(ev.start_append(stream, f"{out}/table", f"{out}/checkpoint"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/table")


@query("src_chunk_replay", f"SELECT {KEY} FROM flights", "flights")
def _(spark, sf):
    rows = flights(spark, sf).select(*FLIGHT_KEY)
    return appended(replay(rows, "replay"), "replayed")


def message_stream(spark, sf):
    """The flights' messages, written once while the inputs stay the same."""
    messages = route_messages(spark, sf)

    def written() -> str:
        with settings(spark, joined_in_parts(spark, sf)):
            return as_files(messages, "messages")

    return scoring.replay(spark, kept(spark, "messages", sf, written), messages.schema, None)


@query("st_parse", f"SELECT {message_sql()} FROM flights", "flights")
def _(spark, sf):
    return appended(parse_messages(message_stream(spark, sf)), "parsed")


@query("st_preprocess", f"SELECT {', '.join([*NUMERIC_FEATURES, *CATEGORICAL_FEATURES])} FROM flights", "flights")
def _(spark, sf):
    """Messages cast, completed, coded and assembled in the stream; the numbers are those that the written vectors hold."""
    ready = appended(prepared_features(parse_messages(message_stream(spark, sf))), "prepared")
    return models.decode_features(ready, list(SLOTS), list(INT_FEATURES)).select(*NUMERIC_FEATURES, *CATEGORICAL_FEATURES)


@query("st_output_mode", f"SELECT {message_sql()} FROM flights", "flights")
def _(spark, sf):
    """Rows without aggregation pass in update mode as they do in append mode."""
    out = run_folder(spark, "update")
    finish(ev.start_upsert(parse_messages(message_stream(spark, sf)), f"{out}/table", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/table").drop("batch_id")


@query("st_start_offsets", f"SELECT {KEY} FROM flights", "flights")
def _(spark, sf):
    """Two runs over a growing folder: the second one starts where the checkpoint of the first one ends."""
    rows = flights(spark, sf).select(*FLIGHT_KEY)
    source, out = run_folder(spark, "growing"), run_folder(spark, "resumed")
    for part in (rows.where("cancelled = 1"), rows.where("cancelled = 0")):
        part.write.mode("append").parquet(source)
        finish(ev.start_append(scoring.replay(spark, source, rows.schema, None), f"{out}/table", f"{out}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{out}/table")


def _scored_stream(spark: SparkSession, sf: str) -> str:
    out = run_folder(spark, "scoring")
    model = fitted(spark, sf, "rf").model
    finish(scoring.start_scoring(message_stream(spark, sf), model, out, f"{out}/checkpoint", available_now=True))
    return out


def scored_tables(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A result table of one scoring run over all messages; queries share the run while the inputs stay the same."""
    fitted(spark, sf, "rf")  # kept by itself
    out = kept(spark, "scoring", sf, lambda: _scored_stream(spark, sf))
    return scoring.read_table(spark, out, name)


@query("st_score_foreach_batch", "SELECT origin, dest, count(*) AS scored_rows, true AS agrees FROM flights GROUP BY 1, 2", "flights")
def _(spark, sf):
    """Rows scored in the stream, by route; whether batch scoring and the saved and reloaded model give each the same probability."""
    path = run_folder(spark, "model")
    model = fitted(spark, sf, "rf").model
    models.save_model(model, path)
    raw = flights(spark, sf).select(*[F.col(c).cast("string") for c in FEATURES])
    sides = {"stream": scored_tables(spark, sf, "scored"), "batch": models.score_batch(model, raw), "again": models.score_batch(models.load_model(path), raw)}
    rows = reduce(DataFrame.unionByName, [df.select(*FEATURES, "p", "prediction", F.lit(k).alias("side")) for k, df in sides.items()])
    counts = rows.groupBy(*FEATURES, "p", "prediction").agg(*[F.count_if(F.col("side") == k).alias(k) for k in sides])
    same = (F.col("stream") == F.col("batch")) & (F.col("batch") == F.col("again")) & F.col("p").between(0, 1)
    return counts.groupBy("origin", "dest").agg(F.sum("stream").alias("scored_rows"), F.bool_and(same).alias("agrees"))


@query("st_scored_rows")
def _(spark, sf):
    """Prediction and probability of every message."""
    return scored_tables(spark, sf, "scored").select(*FEATURES, "prediction", "p", "batch_id")


@query("st_batch_metrics", "SELECT count(*) AS records, true AS in_order, true AS once FROM flights", "flights")
def _(spark, sf):
    """The batches' sizes add up to all flights, each batch has one row, and its minimum, mean and maximum are in order."""
    m = scored_tables(spark, sf, "metrics")
    return m.agg(
        F.sum("records_processed").cast("bigint").alias("records"),
        F.bool_and((F.col("min_prob") <= F.col("avg_prob") + 1e-12) & (F.col("avg_prob") <= F.col("max_prob") + 1e-12)).alias("in_order"),
        (F.count_distinct("batch_id") == F.count(F.lit(1))).alias("once"))


@query("st_scoring_totals", "SELECT count(*) AS total_records, true AS mean_agrees FROM flights", "flights")
def _(spark, sf):
    """Batch metrics added up against the scored rows themselves."""
    totals = scoring.running_metrics(scored_tables(spark, sf, "metrics"))
    direct = scored_tables(spark, sf, "scored").agg(F.avg("p")).scalar()
    return totals.select("total_records", (F.abs(F.col("avg_prob") - direct) < 1e-9).alias("mean_agrees"))


@query("st_alerts", "SELECT true AS any_alert, true AS is_maximum")
def _(spark, sf):
    """Each alert's probability is the largest of its batch."""
    alerts = scoring.recent_alerts(scored_tables(spark, sf, "alerts"))
    top = scored_tables(spark, sf, "metrics").select("batch_id", "max_prob")
    joined = alerts.join(top, "batch_id", "left")
    return joined.agg((F.count(F.lit(1)) > 0).alias("any_alert"), F.bool_and(
        F.coalesce(F.abs(F.col("delay_probability") - F.col("max_prob")) < 1e-9, F.lit(False))).alias("is_maximum"))


def daily_metrics(spark, sf):
    return views.scored(spark, sf).groupBy(F.col("day").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("records_processed"), F.min("p").alias("min_prob"), F.max("p").alias("max_prob"),
        F.avg("p").alias("avg_prob"))


@query("st_running_metrics", """SELECT count(DISTINCT day) AS batches, count(*) AS total_records, round(avg(p), 8) AS avg_prob,
  min(p) AS min_prob, max(p) AS max_prob FROM scored""", "scored")
def _(spark, sf):
    """A streaming aggregate over metrics rows, stopped in the middle of the month and started again from its checkpoint."""
    days = daily_metrics(spark, sf)
    source, out = run_folder(spark, "metrics-rows"), run_folder(spark, "running")
    for half in (F.dayofmonth("batch_id") < 16, F.dayofmonth("batch_id") >= 16):
        days.where(half).write.mode("append").parquet(source)
        finish(scoring.start_running(scoring.replay(spark, source, days.schema, None), f"{out}/table", f"{out}/checkpoint"))
    return scoring.current(spark, f"{out}/table").withColumn("avg_prob", F.round("avg_prob", 8)).select(
        "batches", F.col("total_records").cast("bigint").alias("total_records"), "avg_prob", "min_prob", "max_prob")


@query("st_producer_metrics", """SELECT day AS batch_num, count(*) AS records_in_batch,
  CAST(sum(count(*)) OVER (ORDER BY day) AS BIGINT) AS total_sent FROM scored GROUP BY 1""", "scored")
def _(spark, sf):
    days = views.scored(spark, sf).groupBy(F.col("day").alias("batch_num")).agg(
        F.count(F.lit(1)).alias("records_in_batch"))
    return scoring.producer_metrics(days)


ALERT_SQL = """a AS (SELECT day AS ts, event_id AS batch_id, p AS delay_probability, row_number() OVER (PARTITION BY day
  ORDER BY p DESC, event_id) AS rn FROM scored)"""


def daily_alerts(spark, sf):
    rows = views.scored(spark, sf).select("day", "event_id", "p")
    return ranking.top1_per_batch(rows, "day", ["event_id"]).select(
        F.col("day").alias("ts"), F.col("event_id").alias("batch_id"), F.col("p").alias("delay_probability"))


@query("st_prediction_history", f"""WITH {ALERT_SQL} SELECT ts, batch_id, delay_probability FROM a WHERE rn = 1
ORDER BY ts DESC, batch_id DESC LIMIT 100""", "scored")
def _(spark, sf):
    return scoring.recent_alerts(daily_alerts(spark, sf))


@query("st_trend", f"""WITH {ALERT_SQL} SELECT ts, batch_id, delay_probability FROM a WHERE rn = 1
ORDER BY ts DESC, batch_id DESC LIMIT 50""", "scored")
def _(spark, sf):
    return scoring.trend(daily_alerts(spark, sf))


DELAY = "6 hours"


def event_stream(spark, sf, copies: int = 1):
    """Events in the order of their time, a few files a batch, so that the watermark moves on and state goes."""
    one = events_of(spark, sf)
    df = reduce(DataFrame.unionByName, [one] * copies)
    path = kept(spark, f"events x{copies}", sf, lambda: in_event_time(df, "events"))
    return scoring.replay(spark, path, df.schema, 4)


def micros(c: str):
    return F.unix_micros(F.col(c))


@query("st_event_rate", """SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type, count(*) AS events FROM trajectory
GROUP BY 1, 2""", "trajectory")
def _(spark, sf):
    out = run_folder(spark, "rate")
    finish(ev.start_upsert(ev.event_rate(event_stream(spark, sf), "1 hour", DELAY), f"{out}/table", f"{out}/checkpoint"))
    rows = ev.latest(spark, f"{out}/table", ["window_start", "event_type"])
    return rows.where(F.col("window_start") < closing_hour(spark, sf)).select(micros("window_start").alias("window_start"), "event_type", "events")


@query("st_trend_by_hour", """SELECT epoch_us(date_trunc('hour', ts)) AS window_start, count(*) AS alerts, round(avg(value / 100), 8) AS avg_probability, round(max(value / 100), 8) AS max_probability
FROM events WHERE value >= 50 GROUP BY 1""")
def _(spark, sf):
    """Trend of the probabilities of alerts in event time: hourly windows of a stream, each given out once and closed."""
    stream = event_stream(spark, sf).where((F.col("altitude") >= 5000) | (F.col("event_id") == CLOSING)).select("ts", (F.col("altitude") / 10_000).alias("delay_probability"))
    rows = appended(ev.trend(stream, "1 hour", DELAY), "trend").where(F.col("window_start") < closing_hour(spark, sf))
    return rows.select(micros("window_start").alias("window_start"), "alerts", r("avg_probability", 8), r("max_probability", 8))


@query("st_progress", "SELECT count(*) AS records, 0::BIGINT AS dropped, true AS state_shrinks FROM trajectory", "trajectory")
def _(spark, sf):
    """The hourly rate's own progress events: all events read, none late, and fewer rows of state at the end than in between."""
    out = run_folder(spark, "progress")
    handle = ev.start_append(ev.event_rate(event_stream(spark, sf), "1 hour", DELAY), f"{out}/table", f"{out}/checkpoint")
    finish(handle)
    p = scoring.write_progress(spark, handle, f"{out}/progress")
    last = F.max_by("state_rows", "batch_id")
    return p.agg((F.sum("records") - 1).alias("records"), F.sum("dropped").alias("dropped"), (last < F.max("state_rows")).alias("state_shrinks"))


@query("st_session", """WITH g AS (SELECT flight_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh
  FROM trajectory WINDOW w AS (PARTITION BY flight_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY flight_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT flight_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 21600000000 AS session_end, count(*) AS events
FROM s GROUP BY flight_id, n""", "trajectory")
def _(spark, sf):
    """Sessions of a stream: merged in state, given out once the watermark has passed their end; the closing event ends the last ones."""
    rows = appended(ev.sessions(event_stream(spark, sf), "6 hours", DELAY), "sessions").where(F.col("session_start") < closing_time(spark, sf))
    return rows.select("flight_id", micros("session_start").alias("session_start"),
                       micros("session_end").alias("session_end"), "events")


@query("st_dedup", "SELECT event_id, flight_id, event_type, epoch_us(ts) AS ts FROM trajectory", "trajectory")
def _(spark, sf):
    """Every event arrives twice and is kept once."""
    stream = ev.dedup(event_stream(spark, sf, copies=2), ["event_id"], DELAY)
    return appended(stream, "dedup").where(F.col("event_id") != CLOSING).select("event_id", "flight_id", "event_type", micros("ts").alias("ts"))
