import corpus_pipeline
from corpus_pipeline import STAGES
from latewing.session import cut_lineage
from tests.llm.tables import documents
from pyspark.sql import functions as F


def test_stages_on_odd_documents(spark, sf):
    docs = documents(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    columns = docs.columns
    for name, stage in STAGES:
        before, docs = docs, cut_lineage(stage(spark, docs, sf), name)
        if name != STAGES[-1][0]:
            assert docs.columns == columns and docs.count() <= before.count(), name
    assert docs.count() > 5
    assert [n for n, _ in STAGES] == ["language", "near_duplicates", "decontamination", "privacy", "tokens"]


def test_decisions_take_effect(spark, sf):
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    docs = corpus_pipeline.language(spark, raw, sf)
    assert docs.count() >= 0.98 * raw.count()
    groups = corpus_pipeline.simhash.near_duplicates(raw)
    kept = corpus_pipeline.near_duplicates(spark, raw, sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.m for r in groups.groupBy("root").agg(F.min("doc_id").alias("m")).collect())
    bad = corpus_pipeline.decontaminate.contamination(raw, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated")
    clean = corpus_pipeline.decontamination(spark, raw, sf)
    assert bad.count() > 0 and clean.count() + bad.count() == raw.count() and clean.join(bad, "doc_id").count() == 0
    private = corpus_pipeline.privacy(spark, raw, sf)
    assert private.where(F.col("text").rlike("[0-9]@mail")).count() == 0 and private.where("n_chars != length(text)").count() == 0
    old = raw.select("doc_id", F.col("text").alias("old"))
    assert private.join(old, "doc_id").where("text != old").count() > 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 100


def test_near_duplicates_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one text of its own", "mine", "x"), (1, "one text of its own", "mine", "x"), (2, None, "yours", "y")],
                                 "doc_id bigint, text string, _h string, h string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [(1, "one text of its own", "mine", "x"), (2, None, "yours", "y")]
