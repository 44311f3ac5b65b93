"""Event-time operators on a stream (or table) of events with a ``ts`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def with_event_time(events: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Timestamp with a zone (a watermark needs one) and the watermark, where the frame is a stream."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, delay) if events.isStreaming else out


def event_rate(events: DataFrame, width: str = "1 hour", delay: str = "1 hour", by: Sequence[str] = ("event_type",)):
    """Events per tumbling window."""
    return (
        with_event_time(events, delay).groupBy(F.window("ts", width).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "events")
    )


def trend(alerts: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Number, mean and largest ``delay_probability`` of alerts per window of event time."""
    p = F.col("delay_probability")
    return (
        with_event_time(alerts, delay).groupBy(F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("alerts"), F.avg(p).alias("avg_probability"), F.max(p).alias("max_probability"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "alerts", "avg_probability", "max_probability")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour", key: str = "flight_id"):
    """Activity sessions of a flight: events less than the gap apart.

    Start and end are aggregates, not fields of the window: a later filter on a window field would be pushed below the
    merging of sessions and cut them.
    """
    return (
        with_event_time(events, delay).groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("session_start"), F.max("ts").alias("_last"))
        .select(key, "session_start", (F.col("_last") + F.expr(f"INTERVAL {gap}")).alias("session_end"), "events")
    )


def dedup(events: DataFrame, keys: Sequence[str] = ("event_id",), delay: str = "1 hour") -> DataFrame:
    """First copy of every event; in a stream copies are recognised as long as they arrive within the delay."""
    timed = with_event_time(events, delay)
    return timed.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else timed.dropDuplicates(list(keys))


def start_append(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Append finished rows to a Parquet table."""
    w = stream.writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def start_upsert(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Write changed rows of an aggregation, one folder per batch; ``latest`` gives the current state."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    w = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w).start()


def latest(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of each row of an upsert table; the rank filter works before the exchange, too."""
    table = spark.read.parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return table.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "batch_id")
