"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed side is split even if that costs one more exchange above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Sessions are merged inside each task before the exchange.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    # Streaming state on local disk with its change log in the checkpoint, not on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra) -> SparkSession:
    """A session with the engine's defaults; memory and executor sizes stay with the cluster."""
    b = SparkSession.builder.appName("latewing")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**SETTINGS, **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()


@contextmanager
def settings(spark: SparkSession, some: dict[str, str]):
    """Session settings for the jobs that run inside; the old ones come back."""
    before = {k: spark.conf.get(k, None) for k in some}
    try:
        for k, v in some.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = tempfile.mkdtemp(prefix="latewing-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def run_folder(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path for one run below the shared folder; ``forget`` removes it."""
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    _folders.append(path)
    return path


_folders: list[str] = []
_kept: dict[tuple[str, str], tuple[str, object, list[str]]] = {}


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def input_state(spark: SparkSession, folder: str) -> str:
    """Paths, sizes and times of the files of a folder's tables: changes whenever a table does."""
    fs, root = _file_system(spark, folder)
    seen = []
    for entry in fs.listStatus(root):
        for f in fs.listStatus(entry.getPath()) if entry.isDirectory() else [entry]:
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a table's files."""
    fs, p = _file_system(spark, path)
    return fs.getContentSummary(p).getLength()


def copy_folder(spark: SparkSession, source: str, target: str) -> None:
    """A folder's files as they are, in place of what the target held."""
    (fs, a), (to, b) = _file_system(spark, source), _file_system(spark, target)
    to.delete(b, True)
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"{source} was not copied to {target}")


def kept(spark: SparkSession, label: str, folder: str, make: Callable[[], object]):
    """The result of ``make`` for the tables of a folder, made once for their present state.

    When a table changes, the old result's folders are removed and it is made anew.
    """
    key, state = (label, folder), f"{spark.sparkContext.applicationId} {input_state(spark, folder)}"
    if key in _kept and _kept[key][0] == state:
        return _kept[key][1]
    if key in _kept:
        _remove(spark, _kept.pop(key)[2])
    before = len(_folders)
    value = make()
    _kept[key] = (state, value, _folders[before:])
    return value


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, p = _file_system(spark, path)
        fs.delete(p, True)
        if path in _folders:
            _folders.remove(path)


def forget(spark: SparkSession) -> None:
    """Drop all kept results and remove every folder that runs of this session wrote; DataFrames read from them end here."""
    _kept.clear()
    _remove(spark, list(_folders))


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write to the shared folder and read back: computed once, safe when executors are lost, and of known size."""
    path = run_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
