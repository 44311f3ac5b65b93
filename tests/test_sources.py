import json
import math
from itertools import takewhile

import pytest
from pyspark.sql import functions as F

from latewing.operators.features import typed_features
from latewing.session import run_folder
from latewing.sources import files, messages


def put(path, text):
    path.write_text(text)
    return str(path)


def test_drifting_headers(spark, tmp_path):
    a = put(tmp_path / "a.csv", "YEAR,MONTH,FL_DATE,DUP\n2024,4,x,1\n2024,5,y,\n")
    b = put(tmp_path / "b.csv", "MONTH,YEAR,TAXI_OUT\n6,2024,9.0\n7,2024,8.5\n")
    c = put(tmp_path / "c.csv", "YEAR,MONTH,FL_DATE,DUP\n2025,1,z,0\n")
    df = files.read_csv_drifting(spark, [a, b, c])
    assert sorted(df.columns) == ["DUP", "MONTH", "TAXI_OUT", "YEAR"]
    rows = {(x.YEAR, x.MONTH): (x.DUP, x.TAXI_OUT) for x in df.collect()}
    assert rows == {("2024", "4"): ("1", None), ("2024", "5"): (None, None), ("2024", "6"): (None, "9.0"),
                    ("2024", "7"): (None, "8.5"), ("2025", "1"): ("0", None)}
    with pytest.raises(FileNotFoundError):
        files.read_csv_drifting(spark, [])


def test_quoted_carriers(spark, tmp_path):
    p = put(tmp_path / "c.csv", 'Code,Description\nAA,"Foo ""X"", Inc."\nBB,"two\nlines"\n')
    got = {x.code: x.description for x in files.read_carrier_csv(spark, p).collect()}
    assert got == {"AA": 'Foo "X", Inc.', "BB": "two\nlines"}


def test_list_files(spark, tmp_path):
    put(tmp_path / "a.csv", "x\n1\n")
    put(tmp_path / "b.csv", "x\n")
    got = {x.path.rsplit("/", 1)[1]: x.length for x in files.list_files(spark, f"{tmp_path}/*.csv").collect()}
    assert got == {"a.csv": 4, "b.csv": 2}
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, f"{tmp_path}/*.none")


def test_parquet_partitions_prune(spark):
    out = run_folder(spark, "t")
    df = spark.range(100).select("id", (F.lit(2024)).alias("year"), (F.col("id") % 3).cast("int").alias("month"))
    files.write_parquet(df, out)
    back = files.read_parquet(spark, out)
    assert back.count() == 100
    plan = back.where("month = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_from_rows_keeps_nulls(spark):
    df = files.from_rows(spark, [("a", None), (None, 2)], "s string, i int")
    assert [tuple(x) for x in df.collect()] == [("a", None), (None, 2)]


def test_messages(spark):
    df = spark.createDataFrame([("JFK", "LAX", 1835.0, math.nan), (None, "SFO", None, 2.0)],
                               "ORIGIN string, DEST string, CRS_DEP_TIME double, DISTANCE double")
    rows = messages.to_messages(df).collect()
    assert [x.key for x in rows] == ["JFK-LAX", "-SFO"]
    assert json.loads(rows[0].value) == {"ORIGIN": "JFK", "DEST": "LAX", "CRS_DEP_TIME": 1835.0, "DISTANCE": None}


def test_message_parse_and_shared_cast(spark):
    df = spark.createDataFrame([(b'{bad',), (b'{"CRS_DEP_TIME":1835.0,"ORIGIN":"JFK"}',)], "value binary")
    got = typed_features(messages.parse_messages(df)).collect()
    assert got[0].crs_dep_time is None and got[0].origin is None
    assert got[1].crs_dep_time == 1835 and got[1].origin == "JFK"


def test_kafka_options(spark):
    o = messages.kafka_read_options("h:9092", "flight-data", "latest")
    assert o["startingOffsets"] == "latest" and o["subscribe"] == "flight-data" and o["failOnDataLoss"] == "false"
    w = messages.kafka_write_options("h:9092", "t")
    assert w["kafka.acks"] == "all" and w["kafka.compression.type"] == "gzip"
    with pytest.raises(ValueError):
        messages.kafka_read_options("h", "t", "middle")
    with pytest.raises(Exception, match="(?i)kafka"):
        messages.read_kafka(spark, "h:9092", "t")  # no connector here: a clear error


def test_lines_that_do_not_fit_are_kept_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("YEAR,MONTH,FL_DATE\n2024,1,x\n2024,2,x,extra\n")
    (tmp_path / "b.csv").write_text("MONTH,TAXI_OUT\n3,7\n")
    (tmp_path / "c.csv").write_text("YEAR,MONTH,FL_DATE\n2025,4,y\n")
    (tmp_path / "d.csv").write_text("")
    df = files.read_csv_drifting(spark, [str(tmp_path / f"{n}.csv") for n in "abcd"], corrupt="bad")
    assert sorted(df.columns) == ["MONTH", "TAXI_OUT", "YEAR", "bad"]
    got = {(r.YEAR, r.MONTH, r.TAXI_OUT): r.bad for r in df.collect()}
    assert got == {("2024", "1", None): None, ("2024", "2", None): "2024,2,x,extra", (None, "3", "7"): None, ("2025", "4", None): None}
    assert len(files.headers(spark, [str(tmp_path / f"{n}.csv") for n in "abcd"])) == 2


def test_clean_table_moves_short_legs_and_sorts_nothing(spark, sf, monkeypatch):
    """Names and derived columns come after the exchange by month, and no whole rows are sorted for their partitions' files."""
    from latewing.operators import clean
    from latewing.plans import flights as plans
    from latewing.sources import files, views

    legs = views.legs(spark, sf)
    lines = clean.filled_delays(views.flights(spark, sf, files.dealt(legs)))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(lines) if "RebalancePartitions" in x)
    depth = lines[at].index("RebalancePartitions")
    below = "\n".join(takewhile(lambda x: set(x[:depth]) <= set(" :") and len(x) > depth, lines[at + 1:]))
    assert "l_orderkey" in below and "n_name" not in below and "arr_delay" not in below
    kept = []
    monkeypatch.setattr(plans, "write_parquet", lambda df, path, **how: (kept.append(how), files.write_parquet(df, path, **how)))
    path = plans._clean_table(spark, sf)
    assert kept == [{"deal": False}] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", "0") == "0"
    want, got = clean.clean_flights(views.flights(spark, sf)), spark.read.parquet(path)
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()
