import shutil

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as entry
from latewing import session
from latewing.operators import aggregates, anomaly
from latewing.operators.trajectory import peer_zscore
from latewing.plans.learning import parts
from latewing.plans.trajectories import feats


def test_results_follow_their_tables(spark, sf, tmp_path):
    own = str(tmp_path / "tables")
    shutil.copytree(sf, own, copy_function=shutil.copyfile)
    queries = entry.queries()
    events = feats(spark, own).agg(F.sum("events")).first()[0]
    rows = parts(spark, own)[0].count()
    volume = queries["agg_volume_delay_by_carrier"](spark, own).agg(F.sum("flight_count")).first()[0]
    for t in ("lineitem", "events"):
        pq.write_table(pq.read_table(f"{sf}/{t}.parquet").slice(0, 300), f"{own}/{t}.parquet")
    again = queries["agg_volume_delay_by_carrier"](spark, own).agg(F.sum("flight_count")).first()[0]
    assert again < volume and again <= 300
    assert feats(spark, own).agg(F.sum("events")).first()[0] == 300 < events
    assert parts(spark, own)[0].count() < rows


def test_folders_go(spark):
    path = session.run_folder(spark, "x")
    spark.range(3).write.parquet(path)
    fs, p = session._file_system(spark, path)
    assert fs.exists(p)
    session._remove(spark, [path])
    assert not fs.exists(p) and path not in session._folders


def test_no_group_and_no_flight_is_lost(spark):
    rows = [(i, None if i % 5 == 0 else "a", float(i % 7), None if i == 3 else float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "flight_id bigint, g string, x double, y double")
    assert {r.g for r in aggregates.box_stats(df, "g", "x").collect()} == {None, "a"}
    assert peer_zscore(df, "x", ["g"]).where("g IS NULL AND z IS NULL").count() == 0
    cols = ["x", "y"]
    for scored in (anomaly.kmeans_outliers(df, cols, k=2), anomaly.pca_reconstruction(df, cols, 1), anomaly.grid_density(df, cols),
                   anomaly.isolation_forest(df, cols, trees=5, sample=16)):
        assert scored.select("flight_id").distinct().count() == scored.count() == 60


def test_pairs_with_new_destinations_stay(spark):
    od = spark.createDataFrame([("A", "ATLANTIS", 1.5), ("B", "C", 2.0)], "origin string, dest string, avg_delay double")
    cells = aggregates.matrix_cells(aggregates.pivot_od(od), "origin", "dest", "avg_delay").collect()
    assert {(r.origin, r.dest): r.avg_delay for r in cells} == {
        ("A", "ATLANTIS"): 1.5, ("A", "C"): None, ("B", "ATLANTIS"): None, ("B", "C"): 2.0}
