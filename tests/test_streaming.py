import datetime as dt

import pytest
from pyspark.sql import functions as F

from latewing.operators import features, models
from latewing.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from latewing.session import run_folder
from latewing.sources.messages import to_messages
from latewing.sources.views import FLIGHT_KEY, flights, trajectory
from latewing.streaming import events as ev, scoring

COLS = [*CATEGORICAL_FEATURES, *NUMERIC_FEATURES]


@pytest.fixture(scope="module")
def model(spark, sf):
    rows = features.training_rows(flights(spark, sf), FLIGHT_KEY, 1.0)
    return models.train_models(rows, kinds=("rf",), rf={"maxDepth": 3, "numTrees": 3})["rf"].model


def upper(df):
    return df.select(*[F.col(c).alias(c.upper()) for c in COLS])


def folder_of(spark, df, files):
    out = run_folder(spark, "in")
    df.repartition(files).write.parquet(out)
    return out


@pytest.fixture(scope="module")
def inbox(spark, sf):
    return folder_of(spark, to_messages(upper(flights(spark, sf))), 4)


MESSAGE = "key string, value string"


def schema(text):
    from pyspark.sql import types as T

    return T._parse_datatype_string(text)


def test_stream_equals_batch_and_tables_add_up(spark, sf, model, inbox):
    out = run_folder(spark, "out")
    stream = scoring.replay(spark, inbox, schema(MESSAGE), 1)
    scoring.start_scoring(stream, model, out, f"{out}/cp", available_now=True).awaitTermination()
    got = scoring.read_table(spark, out, "scored")
    raw = upper(flights(spark, sf)).select(*[F.col(c.upper()).cast("string") for c in COLS])
    want = models.score_batch(model, raw)
    cols = [*COLS, "prediction", "p", "flagged"]
    assert got.count() == want.count() and got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    m = scoring.read_table(spark, out, "metrics")
    assert m.count() == 4 and m.agg(F.sum("records_processed")).first()[0] == want.count()
    total = scoring.running_metrics(m).first()
    assert total.avg_prob == pytest.approx(want.agg(F.avg("p")).first()[0]) and total.batches == 4
    alerts = scoring.read_table(spark, out, "alerts")
    assert alerts.count() == 4
    top = got.groupBy("batch_id").agg(F.max("p").alias("p"))
    assert alerts.join(top, "batch_id").where(F.col("p") != F.col("delay_probability")).count() == 0


def test_a_batch_run_twice_leaves_no_duplicates(spark, sf, model):
    out = run_folder(spark, "twice")
    batch = upper(flights(spark, sf)).select(*[F.col(c.upper()).cast("string").alias(c.upper()) for c in COLS])
    for _ in range(2):
        scoring.write_batch(batch, 7, model, 0.5, out)
    assert scoring.read_table(spark, out, "scored").count() == batch.count()
    assert scoring.read_table(spark, out, "metrics").count() == 1


def test_empty_batch_writes_no_metrics(spark, model):
    out = run_folder(spark, "none")
    batch = spark.createDataFrame([("x",) * 10], ", ".join(f"{c.upper()} string" for c in COLS))
    scoring.write_batch(batch, 0, model, 0.5, out)
    assert spark.read.schema("records_processed bigint").parquet(f"{out}/metrics").count() == 0


def test_restart_continues_after_the_checkpoint(spark, sf, model):
    source, out = run_folder(spark, "src"), run_folder(spark, "out")
    msgs = to_messages(upper(flights(spark, sf)))
    for _ in range(2):
        msgs.limit(50).coalesce(1).write.mode("append").parquet(source)
        q = scoring.start_scoring(scoring.replay(spark, source, schema(MESSAGE), 10), model, out, f"{out}/cp", available_now=True)
        q.awaitTermination()
    assert scoring.read_table(spark, out, "scored").groupBy("batch_id").count().collect().__len__() == 2
    assert scoring.read_table(spark, out, "scored").count() == 100


def test_errors_are_not_swallowed(spark, model, inbox):
    out = run_folder(spark, "bad")
    stream = scoring.replay(spark, inbox, schema(MESSAGE), 1)
    q = scoring.start_scoring(stream, None, out, f"{out}/cp", available_now=True)
    with pytest.raises(Exception):
        q.awaitTermination()


def test_complete_mode_is_refused(spark, model, inbox):
    with pytest.raises(ValueError):
        scoring.start_scoring(scoring.replay(spark, inbox, schema(MESSAGE)), model, "x", "y", mode="complete")
    assert scoring.check_mode("update") == "update"


def test_running_and_producer_metrics(spark):
    m = spark.createDataFrame([(2, 0.5, 0.1, 0.9), (8, 0.25, 0.0, 0.8)],
                              "records_processed bigint, avg_prob double, min_prob double, max_prob double")
    r = scoring.running_metrics(m).first()
    assert (r.batches, r.total_records, r.min_prob, r.max_prob) == (2, 10, 0.0, 0.9) and r.avg_prob == pytest.approx(0.3)
    b = spark.createDataFrame([(1, 100), (2, 100), (3, 40)], "batch_num int, records_in_batch bigint")
    assert [x.total_sent for x in scoring.producer_metrics(b).orderBy("batch_num").collect()] == [100, 200, 240]


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


EVENT = "event_id bigint, flight_id bigint, event_type string, ts timestamp_ntz"


def feed(spark, batches):
    """One file per batch, written in order."""
    import time

    out = run_folder(spark, "feed")
    for rows in batches:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(out)
        time.sleep(1.1)
    return scoring.replay(spark, out, schema(EVENT), 1)


def test_late_rows_and_open_windows(spark):
    out = run_folder(spark, "rate")
    stream = feed(spark, [
        [(1, 1, "a", at(5)), (2, 1, "a", at(50))], [(3, 1, "a", at(200))], [(6, 1, "a", at(205))],
        [(4, 1, "a", at(10)), (5, 1, "a", at(210))],  # event 4 is far behind the watermark
    ])
    ev.start_append(ev.event_rate(stream, "1 hour", "30 minutes"), f"{out}/t", f"{out}/cp").awaitTermination()
    rows = {x.window_start: x.events for x in spark.read.parquet(f"{out}/t").collect()}
    assert rows == {at(0): 2}


def test_dedup_within_delay(spark):
    out = run_folder(spark, "dedup")
    stream = feed(spark, [[(1, 1, "a", at(0)), (1, 1, "a", at(0))], [(1, 1, "a", at(1)), (2, 1, "a", at(2))]])
    ev.start_append(ev.dedup(stream, ["event_id"], "1 hour"), f"{out}/t", f"{out}/cp").awaitTermination()
    assert sorted(x.event_id for x in spark.read.parquet(f"{out}/t").collect()) == [1, 2]


def test_closed_sessions_equal_batch(spark, sf):
    e = trajectory(spark, sf)
    last = e.agg(F.max("ts")).first()[0]
    out = run_folder(spark, "sessions")
    source = folder_of(spark, e, 1)
    stream = scoring.replay(spark, source, e.schema, 1)
    ev.start_append(ev.sessions(stream, "6 hours", "1 hour"), f"{out}/t", f"{out}/cp").awaitTermination()
    got = spark.read.parquet(f"{out}/t")
    mark = F.lit(last).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    want = ev.sessions(e, "6 hours").where(F.col("session_end") <= mark)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_upsert_keeps_latest(spark):
    out = run_folder(spark, "upsert")
    stream = feed(spark, [[(1, 1, "a", at(0))], [(2, 1, "a", at(1)), (3, 1, "a", at(70))]])
    ev.start_upsert(ev.event_rate(stream, "1 hour", "10 days"), f"{out}/t", f"{out}/cp").awaitTermination()
    rows = {x.window_start: x.events for x in ev.latest(spark, f"{out}/t", ["window_start", "event_type"]).collect()}
    assert rows == {at(0): 2, at(60): 1}


def test_a_message_is_parsed_once(spark):
    """Conditions on parsed fields don't parse the message again; unreadable and missing messages are rows of nulls as before."""
    from latewing.operators.features import complete_features
    from latewing.schema import MESSAGE_SCHEMA
    from latewing.sources.messages import parse_messages, value_text

    texts = ['{"MONTH": 1, "ORIGIN": "A"}', "no record", "", "{}", None, "[1]", '{"ORIGIN": null}', '[{"ORIGIN": "B"}, {"ORIGIN": "C"}]']
    df = spark.createDataFrame([(x,) for x in texts], "value string")
    plain = value_text(df).select(F.from_json("json", MESSAGE_SCHEMA).alias("d")).select("d.*")
    mine = parse_messages(df)
    assert mine.schema == plain.schema and mine.count() == plain.count() == len(texts)
    assert mine.exceptAll(plain).isEmpty() and plain.exceptAll(mine).isEmpty()
    plan = complete_features(mine)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_preprocessing_codes_and_assembles(spark, monkeypatch):
    """The stream's table holds hashed codes and the vector of each complete row, as in batch; the query reads its numbers from the vectors."""
    import __spark_entry__ as entry
    from latewing.plans import streams

    rows = [("AA", "BOS", "JFK", "900", "1015.0", "75.5", "187", "1", "2", "3"), ("B6", "", "LAX", "5", "6", "7", "8.25", "12", "31", "7"),
            ("AA", "BOS", None, "900", "1015", "75", "187", "1", "2", "3"), ("AA", "BOS", "JFK", "late", "1015", "75", "187", "1", "2", "3")]
    names = "OP_UNIQUE_CARRIER ORIGIN DEST CRS_DEP_TIME CRS_ARR_TIME CRS_ELAPSED_TIME DISTANCE MONTH DAY_OF_MONTH DAY_OF_WEEK".split()
    messages = to_messages(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)))
    source, written, real = folder_of(spark, messages, 2), [], streams.appended
    monkeypatch.setattr(streams, "message_stream", lambda *_: scoring.replay(spark, source, schema(MESSAGE), 1))
    monkeypatch.setattr(streams, "appended", lambda *a: written.append(real(*a)) or written[-1])
    got = entry.queries()["st_preprocess"](spark, source)
    table = {x.dest: x for x in written[0].collect()}
    assert set(table) == {"JFK", "LAX"}
    for x in table.values():
        codes = spark.createDataFrame([(x.op_unique_carrier, x.origin, x.dest)], COLS[:3]).selectExpr(*[f"pmod(hash({c}), 10000)" for c in COLS[:3]]).first()
        assert [*codes] == [x[f"{c}_indexed"] for c in COLS[:3]]
        assert [*x.features] == [*[float(x[c]) for c in NUMERIC_FEATURES], *map(float, codes)]
    batch = features.prepared_features(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))).select(written[0].columns)
    assert batch.exceptAll(written[0]).isEmpty() and written[0].exceptAll(batch).isEmpty()
    assert [f.dataType.simpleString() for f in got.select(*NUMERIC_FEATURES).schema] == ["int"] * 5 + ["double"] * 2
    assert {(r.dest, r.crs_arr_time, r.distance) for r in got.collect()} == {("JFK", 1015, 187.0), ("LAX", 6, 8.25)}
