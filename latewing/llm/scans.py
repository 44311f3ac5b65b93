"""Running sums, maxima and minima of arrays as Spark expressions, in time linear in their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

CHUNK = 128                 # elements folded into one growing array
LEVELS = 3                  # chunks of chunks: beyond CHUNK ** LEVELS elements the last level alone grows on


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside use it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, zero: Column, add: Callable[[Column, Column], Column], kind: str = "int", levels: int = LEVELS, chunk: int = CHUNK) -> Column:
    """For each element what all elements before it add up to, from ``zero`` on. ``add`` must be associative.

    A fold that appends to an array copies it at every step. So only chunks are folded, their totals are scanned in the same way, and
    each chunk is moved by what came before it.
    """
    def folded(part: Column) -> Column:
        begin = F.struct(zero.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, begin, lambda acc, x: F.struct(
            add(acc["at"], x).cast(kind).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    if levels <= 1:
        return folded(values)["out"]

    def chunked(v: Column) -> Column:
        last = F.call_function("div", F.greatest(F.size(v) - 1, F.lit(0)), F.lit(chunk)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda c: folded(F.slice(v, c * chunk + 1, F.lit(chunk))))
        return let(parts, lambda p: let(
            scan(F.transform(p, lambda x: x["at"]), zero, add, kind, levels - 1, chunk),
            lambda before: F.flatten(F.transform(p, lambda x, i: F.transform(x["out"], lambda y: add(before[i], y).cast(kind))))))

    return F.when(F.size(values) <= chunk, folded(values)["out"]).otherwise(let(values, chunked))
