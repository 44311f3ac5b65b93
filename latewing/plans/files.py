"""Queries that write the shared tables through a sink and read them back through a source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from latewing.functions import labels
from latewing.operators import clean
from latewing.plans.flights import KEY, flights
from latewing.plans.registry import query
from latewing.plans.scores import KIND
from latewing.schema import DOUBLE_COLUMNS, FILLED_DELAYS, INT_COLUMNS
from latewing.session import run_folder
from latewing.sources import files, ledger, messages, views
from latewing.sources.views import FLIGHT_KEY, table

WIDE = (*FLIGHT_KEY, "year", "month", "origin", "dest")
INTS = ("l_linenumber", "cancelled", "diverted", "year", "month")
DOUBLES = ("distance", "crs_elapsed_time", "arr_delay", "dep_delay")
LONGS = ("l_orderkey", "l_partkey")


def typed(df: DataFrame) -> DataFrame:
    df = clean.cast_double_safe(clean.cast_int_via_double(df, INTS), DOUBLES)
    return df.withColumns({c: F.col(c).try_cast("bigint") for c in LONGS})


LISTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("src_list", " UNION ALL ".join(f"SELECT '{t}' AS name, true AS listed, count(*) AS rows FROM {t}" for t in LISTED))
def _(spark, sf):
    """Rows of each file as read, by table, and whether the listing shows the same files with the same lengths."""
    found = files.list_files(spark, f"{sf}/*.parquet").select(
        F.regexp_extract("path", r"([^/]+)\.parquet(?:/[^/]*)?$", 1).alias("name"), "length")
    listed = found.groupBy("name").agg(F.sum("length").alias("listed_length"))
    read = reduce(DataFrame.unionByName, [
        spark.read.parquet(f"{sf}/{t}.parquet").groupBy("_metadata.file_path", "_metadata.file_size").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("name", F.lit(t)) for t in LISTED])
    by_table = read.groupBy("name").agg(F.sum("file_size").alias("size"), F.sum("rows").alias("rows"))
    return by_table.join(listed, "name", "left").select("name", F.coalesce(
        F.col("listed_length") == F.col("size"), F.lit(False)).alias("listed"), "rows")


@query("src_parquet", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def _(spark, sf):
    return files.read_parquet(spark, f"{sf}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("src_csv_all_string", f"SELECT {', '.join(WIDE)} FROM flights", "flights")
def _(spark, sf):
    out = run_folder(spark, "csv")
    files.write_csv(flights(spark, sf).select(*WIDE), out)
    return typed(files.read_csv_text(spark, out))


@query("src_csv_quoted", """SELECT concat('s', s_suppkey) AS code, concat(s_name, ' "', s_nationkey, '", Inc.', chr(10), 'Line 2')
  AS description FROM supplier""")
def _(spark, sf):
    out = run_folder(spark, "carriers")
    s = table(spark, sf, "supplier")
    name = F.concat(F.col("s_name"), F.lit(' "'), F.col("s_nationkey").cast("string"), F.lit('", Inc.\nLine 2'))
    s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("Code"), name.alias("Description")).write.option(
        "header", True).option("escape", '"').csv(out)
    return files.read_carrier_csv(spark, out)


IDS = ("l_orderkey", "l_partkey", "l_linenumber")


@query("src_typed_ingest", f"""SELECT {', '.join(IDS)}, op_unique_carrier, crs_elapsed_time, year, month, CASE WHEN l_partkey % 10 <> 3 THEN crs_dep_time END AS crs_dep_time, cancelled, diverted,
  coalesce(arr_delay_new, 0) AS arr_delay_new, CASE WHEN cancelled = 0 THEN dep_delay END AS dep_delay, distance, origin FROM flights""", "flights")
def _(spark, sf):
    """The whole way of monthly files: upper-case CSVs whose columns drift, numbers written as "1.00" or junk, the date
    dropped, columns cast by the lists of the schema, delays filled, written partitioned as Parquet and read back."""
    out = run_folder(spark, "ingest")
    f = flights(spark, sf).withColumn("FL_DATE", F.concat_ws("/", "month", "day_of_month", "year"))
    plain = ("op_unique_carrier", "origin", "distance", "crs_elapsed_time", "arr_delay_new", "dep_delay")
    raw = f.select(*IDS, "FL_DATE", *[F.col(c).alias(c.upper()) for c in plain], *[
        F.concat(F.col(c).cast("string"), F.lit(".00")).alias(c.upper()) for c in ("year", "month", "cancelled", "diverted")],
        F.when(F.col("l_partkey") % 10 == 3, "n/a").otherwise(F.col("crs_dep_time").cast("string")).alias("CRS_DEP_TIME"))
    files.write_csv(raw.where(F.col("CANCELLED") == "1.00").drop("DEP_DELAY"), f"{out}/a")
    files.write_csv(raw.where(F.col("CANCELLED") == "0.00").select(*reversed(raw.columns)), f"{out}/b")
    read = files.read_csv_drifting(spark, [f"{out}/a", f"{out}/b"], corrupt="_corrupt").where("_corrupt IS NULL").drop("_corrupt")
    df = clean.cast_double_safe(clean.cast_int_via_double(read, INT_COLUMNS), DOUBLE_COLUMNS)
    df = clean.fill_null_const(df, FILLED_DELAYS).withColumns({c: F.col(c).try_cast("bigint") for c in LONGS})
    df = df.withColumn("l_linenumber", F.col("l_linenumber").try_cast("int"))
    files.write_parquet(df.toDF(*[c.lower() for c in df.columns]), f"{out}/typed")
    back = files.read_parquet(spark, f"{out}/typed")
    return back.select(*IDS, "op_unique_carrier", "crs_elapsed_time", "year", "month", "crs_dep_time", "cancelled", "diverted",
                       "arr_delay_new", "dep_delay", "distance", "origin")


@query("src_csv_drift_union", f"""SELECT {KEY}, month, NULL::DOUBLE AS dep_delay, origin FROM flights WHERE cancelled = 1
UNION ALL SELECT {KEY}, month, dep_delay, NULL FROM flights WHERE cancelled = 0""", "flights")
def _(spark, sf):
    """Two monthly extracts whose columns differ in order and number, with the date column that is dropped."""
    out = run_folder(spark, "drift")
    f = flights(spark, sf).withColumn("FL_DATE", F.concat_ws("/", "month", "day_of_month", "year"))
    files.write_csv(f.where("cancelled = 1").select("FL_DATE", "month", *FLIGHT_KEY, "origin"), f"{out}/a")
    files.write_csv(f.where("cancelled = 0").select(*reversed(FLIGHT_KEY), "FL_DATE", "dep_delay", "month"), f"{out}/b")
    return typed(files.read_csv_drifting(spark, [f"{out}/a", f"{out}/b"]))


@query("src_csv_incremental", f"SELECT {KEY}, month, CASE WHEN month > 6 THEN origin END AS origin FROM flights", "flights")
def _(spark, sf):
    """Extracts of two halves of a year that arrive one after the other, with other columns; each run takes what is new."""
    inbox, table = run_folder(spark, "inbox"), run_folder(spark, "taken")
    f = flights(spark, sf)
    files.write_csv(f.where("month <= 6").select("month", *FLIGHT_KEY), f"{inbox}/first")
    ledger.take_new(spark, inbox, f"{table}/rows", f"{table}/ledger")
    files.write_csv(f.where("month > 6").select(*reversed(FLIGHT_KEY), "origin", "month"), f"{inbox}/second")
    ledger.take_new(spark, inbox, f"{table}/rows", f"{table}/ledger")
    return typed(ledger.rows(spark, f"{table}/rows")).select(*FLIGHT_KEY, "month", "origin")


@query("sink_parquet", f"SELECT {', '.join(WIDE)} FROM flights", "flights")
def _(spark, sf):
    out = run_folder(spark, "flights")
    files.write_parquet(flights(spark, sf).select(*WIDE), out)
    return files.read_parquet(spark, out)


EXPORT = ("month", "day_of_month", "day_of_week", "crs_dep_time", "crs_arr_time", "distance", "crs_elapsed_time")


@query("sink_csv_predictions", f"""SELECT {', '.join(f'{c} AS {c.upper()}' for c in EXPORT)}, label AS ACTUAL_DELAYED,
  prediction AS PREDICTED_DELAYED, p AS DELAY_PROBABILITY, CASE WHEN label = prediction THEN 1 ELSE 0 END AS PREDICTION_CORRECT,
  {KIND} AS PREDICTION_TYPE FROM flight_scores""", "flight_scores")
def _(spark, sf):
    out = run_folder(spark, "predictions")
    rows = views.flight_scores(spark, sf).withColumns({
        "prediction_correct": labels.correct_flag("label", "prediction"),
        "prediction_type": labels.confusion_type("label", "prediction"),
    }).select(*files.PREDICTION_EXPORT).toDF(*files.PREDICTION_EXPORT.values())
    files.write_csv(rows, out)
    return spark.read.schema(rows.schema).option("header", True).csv(out)


def route_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The flights as JSON messages keyed by route, value as bytes."""
    f = flights(spark, sf).select(*[F.col(c).alias(c.upper()) for c in (
        "op_unique_carrier", "origin", "dest", "crs_dep_time", "crs_arr_time", "crs_elapsed_time", "distance", "month",
        "day_of_month", "day_of_week")])
    return messages.to_messages(f).withColumn("value", F.col("value").cast("binary"))


def message_sql(alias: str = "") -> str:
    numbers = ("crs_dep_time", "crs_arr_time", "crs_elapsed_time", "distance", "month", "day_of_month", "day_of_week")
    return ("op_unique_carrier AS OP_UNIQUE_CARRIER, origin AS ORIGIN, dest AS DEST, "
            + ", ".join(f"CAST({c} AS VARCHAR) AS {c.upper()}" for c in numbers))


@query("sink_kafka", f"SELECT concat(origin, '-', dest) AS key, {message_sql()} FROM flights", "flights")
def _(spark, sf):
    m = route_messages(spark, sf)
    from latewing.schema import MESSAGE_SCHEMA

    return m.select("key", F.from_json(F.col("value").cast("string"), MESSAGE_SCHEMA).alias("d")).select("key", "d.*")


@query("json_parse", f"SELECT {message_sql()} FROM flights", "flights")
def _(spark, sf):
    return messages.parse_messages(route_messages(spark, sf))


@query("bin_to_string", "SELECT concat(origin, '-', dest) AS key, count(*) AS messages FROM flights GROUP BY 1", "flights")
def _(spark, sf):
    keys = route_messages(spark, sf).select(F.col("key").cast("binary").alias("value"))
    return messages.value_text(keys).groupBy(F.col("json").alias("key")).agg(F.count(F.lit(1)).alias("messages"))


@query("null_nan_clean", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    holes = F.when(F.col("o_orderstatus") == "P", F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return messages.clean_nans(o.select("o_orderkey", holes.alias("o_totalprice")))
