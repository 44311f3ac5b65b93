"""Physical plans: pushdown, pruning, no Python in the relational path, bounded sorts."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from latewing.operators.trajectory import gap_stats
from latewing.sources.views import flights, table, trajectory


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pushdown_and_pruning(spark, sf):
    p = plan(flights(spark, sf).where("cancelled = 0").groupBy("origin").count())
    scan = next(line for line in p.splitlines() if "lineitem.parquet" in line)
    assert "l_extendedprice" not in scan.split("ReadSchema")[1] and "l_returnflag" in scan
    p = plan(table(spark, sf, "events").where("event_type = 'click'").select("value"))
    assert "EqualTo(event_type,click)" in p and re.search(r"ReadSchema: struct<event_type:string,value:double>", p)


@pytest.mark.parametrize("name", ["topk_airlines_by_delay", "topk_od", "topk_riskiest", "tail_recent"])
def test_top_k_is_not_a_full_sort(spark, sf, name):
    assert "TakeOrderedAndProject" in plan(entry.queries()[name](spark, sf))


def test_dimension_is_broadcast(spark, sf):
    assert "BroadcastHashJoin" in plan(entry.queries()["join_carrier_left"](spark, sf))


def test_rank_filter_before_exchange(spark, sf):
    p = plan(entry.queries()["band_confidence"](spark, sf))
    assert p.count("WindowGroupLimit") == 2


def test_no_python_rows_in_relational_queries(spark, sf):
    for name in ("agg_delay_by_airline", "clip_p99", "p_gap_stats", "ml_auc_roc", "sample_stratified"):
        p = plan(entry.queries()[name](spark, sf))
        assert "BatchEvalPython" not in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_no_nested_loops_in_split_way(spark, sf):
    e = trajectory(spark, sf)
    p = plan(gap_stats(e, e.count(), chunk_rows=50).select(F.sum("max_gap_s")))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_whole_flights_are_joined_in_parts_that_follow_from_their_size(spark, sf, monkeypatch):
    """Few partitions of the session don't make a large table's join sort and spill; more of them are kept."""
    from latewing.plans import flights, streams

    asked = flights.joined_in_parts(spark, sf)
    assert asked["spark.sql.shuffle.partitions"] == spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(flights, "PART_BYTES", 20_000)
    parts = int(flights.joined_in_parts(spark, sf)["spark.sql.shuffle.partitions"])
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = []
    monkeypatch.setattr(flights, "write_parquet", lambda *a, **kw: seen.append(spark.conf.get("spark.sql.shuffle.partitions")))
    flights._clean_table(spark, sf)
    monkeypatch.setattr(streams, "kept", lambda spark, label, folder, make: make())
    monkeypatch.setattr(streams, "as_files", lambda *a: seen.append(spark.conf.get("spark.sql.shuffle.partitions")) or sf)
    monkeypatch.setattr(streams.scoring, "replay", lambda *a: None)
    streams.message_stream(spark, sf)
    assert seen == [str(parts)] * 2 and spark.conf.get("spark.sql.shuffle.partitions") != str(parts)
