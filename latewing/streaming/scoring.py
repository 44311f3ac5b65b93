"""Scoring of flight messages as they arrive.

A micro-batch goes through the same casts and the same saved pipeline as a batch file. Its results are three tables:
scored rows, one metrics row per batch, one alert per batch; the last two are observed while the first is written. Each batch owns the folder ``batch_id=N`` of every table and
overwrites it, so a batch that is run again leaves no duplicates. Errors are not swallowed: a failed batch is retried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from latewing.functions.labels import at_threshold
from latewing.operators.models import Scorer, score_batch
from latewing.operators.ordered import running
from latewing.sources.messages import parse_messages

ALERT_SCHEMA = T.StructType([
    T.StructField("carrier", T.StringType()), T.StructField("origin", T.StringType()),
    T.StructField("destination", T.StringType()), T.StructField("scheduled_departure", T.IntegerType()),
    T.StructField("prediction", T.IntegerType()), T.StructField("delay_probability", T.DoubleType()),
])
TRIGGER_BYTES = 128 << 20   # input of one micro-batch
# Riskiest row of a batch: highest probability, ties by the flight's own fields.
ALERT_TIES = ("op_unique_carrier", "origin", "dest", "crs_dep_time", "month", "day_of_month", "distance")


def alert_fields(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.select(
        F.col("op_unique_carrier").alias("carrier"), "origin", F.col("dest").alias("destination"),
        F.col("crs_dep_time").alias("scheduled_departure"), at_threshold("p", threshold).alias("prediction"),
        F.col("p").alias("delay_probability"))


def replay(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = 1, fmt: str = "parquet", **options
) -> DataFrame:
    """Files of a folder as a stream, oldest first: a few files per micro-batch, or, without a number, TRIGGER_BYTES."""
    bound = {"maxBytesPerTrigger": TRIGGER_BYTES} if files_per_trigger is None else {"maxFilesPerTrigger": files_per_trigger}
    return spark.readStream.format(fmt).schema(schema).options(**{**bound, **options}).load(path)


def check_mode(mode: str) -> str:
    """Scoring has no aggregation, so only these modes apply."""
    if mode not in ("append", "update"):
        raise ValueError("output mode must be append or update")
    return mode


BATCH_METRICS = "records_processed bigint, min_prob double, max_prob double, avg_prob double"


def observed(scored: DataFrame, seen: Observation, threshold: float = 0.5) -> DataFrame:
    """The rows, which tell their number, probabilities and riskiest row to ``seen`` while they are written."""
    riskiest = F.struct((-F.col("p")).alias("p"), *ALERT_TIES)
    shown = dict(zip(ALERT_SCHEMA.fieldNames(), (F.col("op_unique_carrier"), F.col("origin"), F.col("dest"), F.col("crs_dep_time"), at_threshold("p", threshold), F.col("p"))))
    return scored.observe(
        seen, F.count(F.lit(1)).alias("n"), F.min("p").alias("min_prob"), F.max("p").alias("max_prob"), F.avg("p").alias("avg_prob"),
        *[F.min_by(c, riskiest).alias(f"top_{name}") for name, c in shown.items()])


def write_batch(batch: DataFrame, batch_id: int, model: Scorer, threshold: float, out: str) -> None:
    """One micro-batch, one job over its rows: metrics and alert are observed while the scored rows are written."""
    spark, seen = batch.sparkSession, Observation()
    observed(score_batch(model, batch, threshold), seen, threshold).write.mode("overwrite").parquet(f"{out}/scored/batch_id={batch_id}")
    got = seen.get
    some = got["n"] > 0
    metrics = spark.createDataFrame([(got["n"], got["min_prob"], got["max_prob"], got["avg_prob"])] if some else [], BATCH_METRICS)
    alert = spark.createDataFrame([tuple(got[f"top_{f}"] for f in ALERT_SCHEMA.fieldNames())] if some else [], ALERT_SCHEMA)
    for name, df in (("metrics", metrics), ("alerts", alert)):
        df.coalesce(1).withColumn("ts", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/{name}/batch_id={batch_id}")


def start_scoring(
    stream: DataFrame, model: Scorer, out: str, checkpoint: str, threshold: float = 0.5, mode: str = "append",
    available_now: bool = False,
):
    """Start scoring a stream of messages (any stream with a ``value`` column).

    Where a first start begins is a source option; afterwards the checkpoint of this query decides.
    """
    writer = (
        parse_messages(stream).writeStream.outputMode(check_mode(mode)).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, i: write_batch(df, i, model, threshold, out))
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{name}")


def running_metrics(metrics: DataFrame) -> DataFrame:
    """Totals over all batches; the mean is weighted by records."""
    n = F.sum("records_processed")
    return metrics.agg(
        F.count(F.lit(1)).alias("batches"), n.alias("total_records"),
        F.try_divide(F.sum(F.col("avg_prob") * F.col("records_processed")), n).alias("avg_prob"),
        F.min("min_prob").alias("min_prob"), F.max("max_prob").alias("max_prob"))


def start_running(metrics: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Running metrics of a stream of metrics rows: one aggregate over all batches ever seen, its state in the checkpoint.

    Complete mode gives the whole result each time; ``current`` reads the newest. A restart goes on from the checkpoint.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    w = running_metrics(metrics).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The newest result of a query in complete mode; older ones are not read."""
    table = spark.read.parquet(out)
    return table.where(F.col("batch_id") == table.agg(F.max("batch_id")).scalar()).drop("batch_id")


def progress_rows(handle) -> list[tuple]:
    """``(batch_id, rows, state_rows, dropped)`` of a query's latest batches, from its own progress events."""
    out = {}
    for p in handle.recentProgress:
        state = p.stateOperators
        out[p.batchId] = (p.batchId, p.numInputRows, sum(s.numRowsTotal for s in state), sum(s.numRowsDroppedByWatermark for s in state))
    return [out[k] for k in sorted(out)]


PROGRESS = "batch_id bigint, records bigint, state_rows bigint, dropped bigint"


def write_progress(spark: SparkSession, handle, out: str) -> DataFrame:
    """A finished query's progress as a table, a row per batch: nothing is read a second time to count it."""
    spark.createDataFrame(progress_rows(handle), PROGRESS).coalesce(1).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def producer_metrics(batches: DataFrame) -> DataFrame:
    """Running total over a table with one row per sent batch."""
    return running(batches, [], ["batch_num"], {"total_sent": "records_in_batch"})


def recent_alerts(alerts: DataFrame, n: int = 100) -> DataFrame:
    return alerts.orderBy(F.desc("ts"), F.desc("batch_id")).limit(n)


def trend(alerts: DataFrame, n: int = 50) -> DataFrame:
    """Probability over time, newest ``n`` points."""
    return recent_alerts(alerts, n).select("ts", "batch_id", "delay_probability")
