"""Views that give the shared tables the shape of flights, carriers, scores and event trajectories.

Each view exists twice: as a DataFrame here and as SQL text in ``SQL`` for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table as it is now."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count from the Parquet footers."""
    return table(spark, sf_dir, name).count()


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their order's date and both nation keys: few and short columns, so that exchanges stay small.

    Customers are joined to the orders first, so the larger line items are exchanged once for the order key and
    once for the supplier, or not at all where the optimizer's size checks allow a broadcast. AQE splits hot keys.
    """
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    trips = o.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_nationkey")
    return (
        li.join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(trips, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate",
                "o_orderdate", "c_nationkey", "s_nationkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    )


def flights(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Line items as flight legs; ``of`` are the same legs dealt out in another way. Names and all that follows from a row come after its exchange."""
    n = table(spark, sf_dir, "nation")
    home = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("origin"))
    away = n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dest"))
    named = (legs(spark, sf_dir) if of is None else of).join(home, "c_nationkey").join(away, "s_nationkey")
    d = F.col("o_orderdate")
    gap = F.datediff("l_shipdate", "o_orderdate").cast("double")
    flown = F.col("l_returnflag") != "R"
    late = gap - (F.col("l_quantity") - 25)
    zero = F.lit(0.0)
    return named.select(
        "l_orderkey", "l_partkey", "l_linenumber", "year", "month", F.dayofmonth(d).alias("day_of_month"),
        (F.weekday(d) + 1).alias("day_of_week"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("op_unique_carrier"), "origin", "dest",
        ((F.col("l_partkey") % 24) * 100 + (F.col("l_linenumber") * 7) % 60).cast("int").alias("crs_dep_time"),
        (((F.col("l_partkey") + 3) % 24) * 100 + (F.col("l_linenumber") * 11) % 60).cast("int").alias("crs_arr_time"),
        (F.col("l_extendedprice") / 50).alias("distance"), (F.col("l_quantity") * 10).alias("crs_elapsed_time"),
        F.when(flown, 0).otherwise(1).alias("cancelled"),
        F.when(F.col("l_tax") == 0.08, 1).when(F.col("l_tax") != 0.0, 0).alias("diverted"),
        F.when(flown, gap).alias("arr_delay"), F.when(flown, late).alias("dep_delay"),
        F.when(flown, F.greatest(gap, zero)).alias("arr_delay_new"),
        F.when(flown, F.greatest(late, zero)).alias("dep_delay_new"),
        F.when(flown, F.when(gap >= 15, 1).otherwise(0)).alias("arr_del15"),
    )


# Columns that together identify a leg for tie-breaks and sampling.
FLIGHT_KEY = ("l_orderkey", "l_partkey", "l_linenumber", "op_unique_carrier", "distance", "crs_elapsed_time",
              "arr_delay", "cancelled", "diverted")


def carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carrier dimension with padding, case, counter suffixes, duplicates and missing codes."""
    s = table(spark, sf_dir, "supplier")
    suffix = F.when(F.col("s_nationkey") < 8, " (1)").otherwise("")
    key = F.col("s_suppkey").cast("string")
    now = s.where("s_acctbal >= 0").select(
        F.concat(F.lit("s"), key, suffix).alias("code"),
        F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("description"))
    old = s.where("s_acctbal >= 5000").select(
        F.concat(F.lit("S"), key, F.lit(" (2)")).alias("code"),
        F.concat(F.lit("Old "), F.col("s_name")).alias("description"))
    return now.unionByName(old)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows: label, probability, prediction."""
    e = table(spark, sf_dir, "events")
    mark = (F.col("event_id") * 37 + F.col("user_id") * 11) % 1000
    return e.select(
        "event_id", "user_id", "event_type", F.to_date("ts").alias("day"),
        F.when(F.col("value") >= 50, 1).otherwise(0).alias("label"), (mark.cast("double") / 1000).alias("p"),
        F.when(mark >= 500, 1).otherwise(0).alias("prediction"),
    )


def flight_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights with a label, a probability and a prediction that need no training."""
    mark = (F.col("l_orderkey") * 37 + F.col("l_partkey") * 11 + F.col("l_linenumber") * 101) % 1000
    f = flights(spark, sf_dir).where(F.col("arr_del15").isNotNull())
    return f.withColumns({
        "label": F.col("arr_del15"), "p": mark.cast("double") / 1000, "prediction": F.when(mark >= 500, 1).otherwise(0),
    })


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as positions of flights; one user is one flight."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("flight_id"), "event_id", "ts", "event_type",
        ((F.col("event_id") * 37) % 360 - 180).cast("double").alias("lon"),
        ((F.col("event_id") * 17) % 120 - 60).cast("double").alias("lat"),
        (F.col("value") * 100).alias("altitude"), F.col("props").alias("info"),
    )


SQL = {
    "flights": """
SELECT l_orderkey, l_partkey, l_linenumber, CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month,
  CAST(day(d) AS INT) AS day_of_month, CAST(isodow(d) AS INT) AS day_of_week,
  concat('S', CAST(l_suppkey AS VARCHAR)) AS op_unique_carrier, origin, dest,
  CAST((l_partkey % 24) * 100 + (l_linenumber * 7) % 60 AS INT) AS crs_dep_time,
  CAST(((l_partkey + 3) % 24) * 100 + (l_linenumber * 11) % 60 AS INT) AS crs_arr_time,
  l_extendedprice / 50 AS distance, l_quantity * 10 AS crs_elapsed_time,
  CASE WHEN rf = 'R' THEN 1 ELSE 0 END AS cancelled,
  CASE WHEN tax = 0.08 THEN 1 WHEN tax = 0.0 THEN NULL ELSE 0 END AS diverted,
  CASE WHEN rf = 'R' THEN NULL ELSE gap END AS arr_delay,
  CASE WHEN rf = 'R' THEN NULL ELSE gap - (l_quantity - 25) END AS dep_delay,
  CASE WHEN rf = 'R' THEN NULL ELSE greatest(gap, CAST(0 AS DOUBLE)) END AS arr_delay_new,
  CASE WHEN rf = 'R' THEN NULL ELSE greatest(gap - (l_quantity - 25), CAST(0 AS DOUBLE)) END AS dep_delay_new,
  CASE WHEN rf = 'R' THEN NULL WHEN gap >= 15 THEN 1 ELSE 0 END AS arr_del15
FROM (SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice,
        o.o_orderdate AS d, CAST(datediff('day', o.o_orderdate, l.l_shipdate) AS DOUBLE) AS gap,
        l.l_returnflag AS rf, l.l_tax AS tax, cn.n_name AS origin, sn.n_name AS dest
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
      JOIN nation cn ON c.c_nationkey = cn.n_nationkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
      JOIN nation sn ON s.s_nationkey = sn.n_nationkey)""",
    "carriers": """
SELECT concat('s', s_suppkey, CASE WHEN s_nationkey < 8 THEN ' (1)' ELSE '' END) AS code,
  concat(' ', s_name, ' ') AS description
FROM supplier WHERE s_acctbal >= 0
UNION ALL
SELECT concat('S', s_suppkey, ' (2)') AS code, concat('Old ', s_name) AS description
FROM supplier WHERE s_acctbal >= 5000""",
    "scored": """
SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS label,
  CAST((event_id * 37 + user_id * 11) % 1000 AS DOUBLE) / 1000 AS p,
  CASE WHEN (event_id * 37 + user_id * 11) % 1000 >= 500 THEN 1 ELSE 0 END AS prediction
FROM events""",
    "trajectory": """
SELECT user_id AS flight_id, event_id, ts, event_type, CAST((event_id * 37) % 360 - 180 AS DOUBLE) AS lon,
  CAST((event_id * 17) % 120 - 60 AS DOUBLE) AS lat, value * 100 AS altitude, props AS info
FROM events""",
}
SQL["flight_scores"] = f"""
SELECT *, arr_del15 AS label,
  CAST((l_orderkey * 37 + l_partkey * 11 + l_linenumber * 101) % 1000 AS DOUBLE) / 1000 AS p,
  CASE WHEN (l_orderkey * 37 + l_partkey * 11 + l_linenumber * 101) % 1000 >= 500 THEN 1 ELSE 0 END AS prediction
FROM ({SQL['flights']}) WHERE arr_del15 IS NOT NULL"""
# The cleaned carrier dimension, one row per code.
SQL["airlines"] = f"""
SELECT op_unique_carrier, airline_name FROM (
  SELECT upper(trim(regexp_replace(code, '\\s*\\(\\d+\\)\\s*$', ''))) AS op_unique_carrier,
    trim(description) AS airline_name,
    row_number() OVER (PARTITION BY upper(trim(regexp_replace(code, '\\s*\\(\\d+\\)\\s*$', '')))
      ORDER BY regexp_matches(code, '\\s*\\(\\d+\\)\\s*$'), trim(description)) AS rn
  FROM ({SQL['carriers']})) WHERE rn = 1"""
# Flights after filling and capping at the exact 99th percentile.
SQL["clean"] = f"""
SELECT * EXCLUDE (arr_delay_new, dep_delay_new),
  coalesce(arr_delay_new, 0) AS arr_delay_new, coalesce(dep_delay_new, 0) AS dep_delay_new,
  coalesce(arr_delay_new, arr_delay, 0) AS arr_delay_min, coalesce(dep_delay_new, dep_delay, 0) AS dep_delay_min,
  least(coalesce(arr_delay_new, 0), (SELECT quantile_disc(coalesce(arr_delay_new, 0), 0.99) FROM ({SQL['flights']})))
    AS arr_delay_clipped,
  least(coalesce(dep_delay_new, 0), (SELECT quantile_disc(coalesce(dep_delay_new, 0), 0.99) FROM ({SQL['flights']})))
    AS dep_delay_clipped
FROM ({SQL['flights']})"""
