from pyspark.sql import functions as F

from latewing.operators import dims
from latewing.operators.joins import fits_broadcast, key_filter, left_lookup


def test_far_way_equals_broadcast(spark):
    fact = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"))
    dim = spark.range(40).select(F.col("id").cast("string").alias("k"), (F.col("id") * 10).alias("x")).unionByName(
        spark.sql("SELECT 'hot' AS k, 7L AS x"))
    a = left_lookup(fact, dim, ["k"])
    b = left_lookup(fact, dim, ["k"], max_rows=5)
    assert sorted(a.collect()) == sorted(b.select(*a.columns).collect())
    assert a.count() == 3000


def test_fits_broadcast_measures_rows_and_bytes(spark):
    assert fits_broadcast(spark.range(10), 10) and not fits_broadcast(spark.range(11), 10)
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert not fits_broadcast(wide, 10, 5000)


def test_dimension_dedup_is_stable(spark):
    rows = [("aa (1)", "Old A"), ("AA", "New A"), ("b (1)", " Z "), ("b (2)", "Y")]
    df = spark.createDataFrame(rows, "code string, description string")
    for n in (1, 4, 7):
        got = {x.op_unique_carrier: x.airline_name for x in dims.airline_dimension(df.repartition(n)).collect()}
        assert got == {"AA": "New A", "B": "Y"}


def test_left_join_keeps_rows_and_falls_back(spark):
    flights = spark.createDataFrame([("aa", 1), ("zz", 2), (None, 3)], "op_unique_carrier string, i int")
    dim = spark.createDataFrame([("AA", "Alpha")], "op_unique_carrier string, airline_name string")
    got = {x.i: x.airline_name for x in dims.join_carrier_left(flights, dim).collect()}
    assert got == {1: "Alpha", 2: "ZZ", 3: None}
    assert {x.i: x.airline_name for x in dims.join_carrier_left(flights, None).collect()} == {1: "aa", 2: "zz", 3: None}


def test_long_lists_join(spark):
    fact = spark.range(30_000)
    assert dims.join_pred_to_fact(fact, spark.range(12_000), ["id"]).count() == 12_000
    assert dims.join_pred_to_fact(fact, spark.range(300_000), ["id"]).count() == 30_000


def test_null_keys_meet_where_asked(spark):
    fact = spark.createDataFrame([(1, None), (2, "a")], "id int, k string")
    dim = spark.createDataFrame([(None, 7), ("a", 8)], "k string, x int")
    for most in (10, 1):
        assert {r.id: r.x for r in left_lookup(fact, dim, ["k"], max_rows=most, null_safe=True).collect()} == {1: 7, 2: 8}
        assert {r.id: r.x for r in left_lookup(fact, dim, ["k"], max_rows=most).collect()} == {1: None, 2: 8}


def test_key_filter_lets_all_keys_through_and_few_others(spark):
    fact = spark.range(20_000).select("id", (F.col("id") % 5000).alias("k"), F.concat(F.lit("s"), F.col("id") % 7).alias("s"))
    keys = spark.range(0, 500).select((F.col("id") * 3).alias("k"), F.concat(F.lit("s"), F.col("id") % 7).alias("s")).unionByName(
        spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 's1' AS s"))
    joined = fact.join(keys, ["k", "s"]).count()
    passed = fact.where(key_filter(keys, ["k", "s"], bits=1 << 14))
    assert passed.join(keys, ["k", "s"]).count() == joined > 0 and joined <= passed.count() < 3 * joined
    full = fact.where(key_filter(keys, ["k", "s"], bits=1 << 8))       # far too small: slower, not wrong
    assert full.join(keys, ["k", "s"]).count() == joined
    assert fact.where(key_filter(keys.limit(0), ["k", "s"])).count() == 0


def test_long_list_is_filtered_before_the_exchange(spark):
    fact = spark.range(50_000).select("id", (F.col("id") % 5000).alias("k"))
    preds = spark.range(100).select(F.col("id").alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = dims.join_pred_to_fact(fact, preds, ["k"], max_rows=10)
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        assert df.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = next(i for i, x in enumerate(plan) if "SortMergeJoin" in x)
    left = plan[join:]
    exchange = next(i for i, x in enumerate(left) if "Exchange" in x)
    assert any("Filter" in x and "getbit" in x.lower() for x in left[exchange:])
