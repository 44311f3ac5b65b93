"""Join helpers that check sizes and survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure, on no more than ``max_rows + 1`` rows, whether a side is small enough to send to every executor."""
    width = F.lit(8 * len(df.columns)).cast("bigint")
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(F.col(name)).cast("bigint"), F.lit(0))
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def left_lookup(
    fact: DataFrame, dim: DataFrame, keys: Sequence[str], max_rows: int = BROADCAST_ROWS, null_safe: bool = False,
) -> DataFrame:
    """Left equi-join to a table with one row per key: broadcast if measured small, else a sort-merge join.

    The session lets AQE split the fact side's hot keys; the dimension has one row for each. ``null_safe`` lets null keys meet.
    """
    own = dim.select(*[F.col(k).alias(f"_dim_{k}") for k in keys], *[c for c in dim.columns if c not in keys])
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_dim_{k}")) if null_safe else F.col(k) == F.col(f"_dim_{k}")
        same = c if same is None else same & c
    own = F.broadcast(own) if fits_broadcast(dim, max_rows) else own
    return fact.join(own, same, "left").drop(*[f"_dim_{k}" for k in keys])


FILTER_BITS = 1 << 24       # 2 MB as an array of longs; more keys than a tenth of it let more rows through, never fewer
PROBES = 4


def _places(keys: Sequence[str], bits: int) -> list[Column]:
    """Where a key's bits lie: positions 0 .. bits - 1."""
    a, b = F.xxhash64(*keys), F.xxhash64(F.lit(1), *keys)
    return [F.pmod(F.shiftright(a, 8) + F.shiftright(b, 8) * i, F.lit(bits)) for i in range(1, PROBES + 1)]


def key_filter(keys_of: DataFrame, keys: Sequence[str], bits: int = FILTER_BITS) -> Column:
    """A condition that holds for every row whose keys are in ``keys_of`` and for few others: a Bloom filter.

    Tasks or their keys' bits together before the exchange, so it gets no more than ``bits`` / 64 rows from each; the finished array is a
    scalar of the plan. Columns must have the same types on both sides.
    """
    at = keys_of.na.drop("any", subset=list(keys)).select(F.explode(F.array(*_places(keys, bits))).alias("at"))
    word, bit = F.shiftright("at", 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int"))
    words = at.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set"))
    every = keys_of.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    whole = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("set", F.lit(0).cast("bigint")).alias("set")))), lambda x: x["set"]).alias("w"))
    array = whole.scalar()
    return reduce(lambda a, b: a & b, [
        F.getbit(F.get(array, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in _places(keys, bits)])
