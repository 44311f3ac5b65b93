"""File sources and sinks."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from latewing.schema import CARRIER_FILE_SCHEMA
from latewing.session import settings

OPEN_FILES = 8              # of one writing task


def list_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """``(path, length)`` of the matching files; file contents are not read. No match is an error."""
    try:
        found = spark.read.format("binaryFile").load(path_glob).select("path", "length")
        empty = found.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            empty = True
        else:
            raise
    if empty:
        raise FileNotFoundError(f"no files match {path_glob}")
    return found


def read_csv_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """CSV with a header, every column a string."""
    return spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(paths)


def read_carrier_csv(spark: SparkSession, path: str, schema: T.StructType = CARRIER_FILE_SCHEMA) -> DataFrame:
    """Quoted CSV whose fields may hold line breaks and doubled quotes; renamed to ``code, description``."""
    raw = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    )
    return raw.withColumnsRenamed({"Code": "code", "Description": "description"})


def plain_path(encoded: Column) -> Column:
    """A file's path as it was given, from the encoded one that Spark reports."""
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Files by their first line, found in one job over all files; a file without lines has no header."""
    lines = spark.read.text(list(paths)).select(
        "value", plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"))
    first = lines.where("start = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    groups: dict[str, list[str]] = defaultdict(list)
    for r in first.orderBy("header", "path").toLocalIterator():
        groups[r.header].append(r.path)
    return groups


def read_csv_drifting(
    spark: SparkSession, paths: Iterable[str], drop: Sequence[str] = ("FL_DATE",), corrupt: str | None = None,
) -> DataFrame:
    """Files whose columns differ, as one table: matched by name, missing columns NULL, all columns strings.

    Files with the same header are read together, so the plan has one branch per header, not per file. ``corrupt`` names a
    column that holds the whole line where its fields don't fit the header; it is NULL for all other lines.
    """
    groups = headers(spark, list(paths))
    if not groups:
        raise FileNotFoundError("no input files")
    parts = []
    for same in groups.values():
        names = read_csv_text(spark, same[0]).columns
        kinds = T.StructType([T.StructField(c, T.StringType()) for c in [*names, *([corrupt] if corrupt else [])]])
        reader = spark.read.schema(kinds).option("header", True).option("mode", "PERMISSIVE")
        if corrupt:
            # Fields can only be counted if all are parsed.
            reader = reader.option("columnNameOfCorruptRecord", corrupt).option("columnPruning", False)
        parts.append(reader.csv(same).drop(*drop))
    return union_by_name(parts)


def union_by_name(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dealt(df: DataFrame, partition_by: Sequence[str] = ("year", "month")) -> DataFrame:
    """Rows go to the task that writes their partition's files, a hot partition to several of them (Spark splits it while rebalancing)."""
    return df.hint("rebalance", *[F.col(c) for c in partition_by])


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ("year", "month"), deal: bool = True) -> None:
    """Overwrite, partitioned for pruning; ``deal=False`` if the rows are dealt out already.

    A task holds few partitions then, so it keeps a file open for each instead of sorting whole rows; beyond ``OPEN_FILES`` it sorts.
    """
    with settings(df.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}):
        (dealt(df, partition_by) if deal else df).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers, written by the executors."""
    df.write.mode("overwrite").option("header", True).csv(path)


# Columns of the exported predictions.
PREDICTION_EXPORT = {
    "month": "MONTH", "day_of_month": "DAY_OF_MONTH", "day_of_week": "DAY_OF_WEEK", "crs_dep_time": "CRS_DEP_TIME",
    "crs_arr_time": "CRS_ARR_TIME", "distance": "DISTANCE", "crs_elapsed_time": "CRS_ELAPSED_TIME",
    "label": "ACTUAL_DELAYED", "prediction": "PREDICTED_DELAYED", "p": "DELAY_PROBABILITY",
    "prediction_correct": "PREDICTION_CORRECT", "prediction_type": "PREDICTION_TYPE",
}


def from_rows(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Local rows with an explicit schema; missing values stay NULL."""
    return spark.createDataFrame(list(rows), schema)
