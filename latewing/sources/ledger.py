"""Files taken once each, as they arrive: a ledger beside the table says which."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from latewing.sources.files import plain_path, read_csv_drifting

LEDGER = "name string, size bigint, changed bigint"
SOURCE = "source_file"
SCHEME = "^[A-Za-z0-9.+-]+:/+"


def listing(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[tuple[str, str, int, int]]:
    """``(path, name below the folder, bytes, time of change)`` of all files, at any depth, on any store that Spark reads."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top, found, files = fs.makeQualified(root).toString(), [], fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        path = f.getPath().toString()
        if path.endswith(suffix) and not f.getPath().getName().startswith(("_", ".")):
            found.append((path, path[len(top) + 1:], f.getLen(), f.getModificationTime()))
    return sorted(found, key=lambda x: x[1])


def taken(spark: SparkSession, ledger: str) -> set[tuple[str, int, int]]:
    """What the ledger holds; empty before the first run."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return set()
    return {tuple(r) for r in spark.read.schema(LEDGER).parquet(ledger).collect()}


def take_new(
    spark: SparkSession, folder: str, table: str, ledger: str,
    read: Callable[[SparkSession, list[str]], DataFrame] = lambda spark, paths: read_csv_drifting(spark, paths),
) -> list[str]:
    """Read the files that the ledger lacks, or that changed since, into the table; return their names.

    A file's rows are a partition of the table, replaced as a whole. The ledger is written last, so a run that stops in between is
    simply made again, and a file that is delivered anew takes the place of its former rows.
    """
    known = taken(spark, ledger)
    new = [(path, name, size, changed) for path, name, size, changed in listing(spark, folder) if (name, size, changed) not in known]
    if not new:
        return []
    top = re.sub(SCHEME, "/", new[0][0][:-len(new[0][1])])
    where = F.regexp_replace(plain_path(F.input_file_name()), SCHEME, "/")
    own = read(spark, [path for path, *_ in new]).withColumn(SOURCE, F.substr(where, F.lit(len(top) + 1)))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SOURCE).parquet(table)
    spark.createDataFrame([x[1:] for x in new], LEDGER).coalesce(1).write.mode("append").parquet(ledger)
    return [x[1] for x in new]


def rows(spark: SparkSession, table: str) -> DataFrame:
    """All rows taken so far; columns that some files lack are NULL there."""
    return spark.read.option("mergeSchema", True).parquet(table)
