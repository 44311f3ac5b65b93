"""A corpus cleaned in five stages; each is written as Parquet and read again as the next one's documents.

A stage is ``function(spark, docs, sf_dir)``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from latewing.llm import byte_bpe, decontaminate, language_id, private_data, simhash
from latewing.plans.registry import Query
from latewing.session import cut_lineage


def _whole_rows(docs: DataFrame) -> DataFrame:
    """Rows under one column, which operators hand through as a key, beside their text."""
    return docs.select(F.struct("*").alias("doc"), F.col("text").alias("text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null texts, texts without letters, scores below the calibrated threshold."""
    found = language_id.identify(_whole_rows(docs), language_id.train(docs), key="doc")
    return found.where("not rejected").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays, and one of equal rows."""
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    keyed = rows.select(F.struct("doc_id", "h").alias("key"), "text")
    groups = simhash.near_duplicates(keyed, key="key")
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col("key.doc_id").isNull(), "key")).alias("m")).select(
        F.col("m.key.doc_id").alias("_d"), F.col("m.key.h").alias("_k"))
    same = rows["doc_id"].eqNullSafe(kept["_d"]) & (rows["h"] == kept["_k"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "h"]).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(_whole_rows(docs), benchmark, key="doc")
    return found.where("not contaminated").select("doc.*")


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind; n_chars follows where a text changes."""
    found = private_data.find_private(_whole_rows(docs), private_data.train(docs), key="doc")
    text, spans = F.col("doc.text"), F.array_sort(F.concat("base", "added"))
    found = found.withColumn("new", private_data.redact(text, spans)).withColumn("changed", F.size(spans) > 0)
    own = {"text": F.when(F.col("changed"), F.col("new")).otherwise(text)}
    if "n_chars" in docs.columns:
        n = F.col("doc.n_chars")
        own["n_chars"] = F.when(F.col("changed"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(n)
    return found.select(*[own.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded text, and the ids."""
    return byte_bpe.encode(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("privacy", privacy), ("tokens", tokens)]

#: Learned decisions and hashes: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE = Query("pipeline", run, ORACLE_SQL)
