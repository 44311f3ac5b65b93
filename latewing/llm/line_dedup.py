"""Lines that several documents share: exploded, hashed, counted by distinct documents, dropped, and put together again by position.

Spark expressions only. A line travels as two 64-bit hashes beside its document and position, never as text. Hashes that hold
a noticeable part of all shared lines are answered by a broadcast whose size is bounded by that part, so no task of the join gets
a hot line's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from latewing.llm.meeting import named, numbered
from latewing.session import cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
#: A hash with at least this part of all shared lines is hot: there can be no more such hashes than its inverse.
HOT_PART = 1 / 4096


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case. In a text without other letters than ASCII that is what the faster ``lower`` does."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def line_key(line: Column) -> Column:
    """What makes lines equal: blanks at both ends are stripped, A-Z lower-cased."""
    return F.btrim(lower_ascii(line), F.lit(BLANKS))


def hashed_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """(d, v, p, h, g): for each line long enough its row's key and text hash, its position, and two independent hashes of its key."""
    keyed = rows.select("d", "v", F.posexplode(F.split("t", "\n", -1)).alias("p", "line")).select("d", "v", "p", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= least_chars).select("d", "v", "p", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def shared_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(h, g, low, n_docs, n_lines) of the hashes in at least ``least_docs`` documents; ``low`` is the smallest of these."""
    found = lines.groupBy("h", "g").agg(F.min("d").alias("low"), F.count_distinct("d").alias("n_docs"), F.count(F.lit(1)).alias("n_lines"))
    return found.where(F.col("n_docs") >= least_docs)


def repeated_lines(lines: DataFrame, shared: DataFrame, hot_part: float = HOT_PART) -> DataFrame:
    """(d, v, p) of the lines under a shared hash outside its smallest document."""
    total = shared.agg(F.sum("n_lines")).first()[0] or 0
    is_hot = F.col("n_lines") >= total * hot_part
    hot = shared.where(is_hot).select("h", "g", F.col("low").alias("hot_low"))
    cold = shared.where(~is_hot).select("h", "g", "low")
    # At most 1 / hot_part hashes are hot: 100 kB. Their lines go on under keys of their own, which meet nothing.
    told = lines.join(F.broadcast(hot), ["h", "g"], "left")
    own = F.col("hot_low").isNotNull()
    told = told.withColumns({"h": F.when(own, F.xxhash64("d", "v", "p")).otherwise(F.col("h")), "g": F.when(own, F.xxhash64("p", "v", "d")).otherwise(F.col("g"))})
    low = F.coalesce("hot_low", "low")
    return told.join(cold, ["h", "g"], "left").where(F.col("d") > low).select("d", "v", "p")


def remove_lines(
    docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = 10, least_docs: int = 2, hot_part: float = HOT_PART,
) -> DataFrame:
    """One row per row of ``docs``: the key, n_lines (before dropping), n_dropped, and kept, the text without its repeated lines.

    Texts are split at line feeds; a null or empty text is one empty line. A line whose key (``line_key``) has at least
    ``least_chars`` code points and occurs in ``least_docs`` documents stays only in the smallest document that holds it, there
    in all its places. Keys are integers; a null key is smaller than all others. Rows with equal keys are one document: lines
    they share don't make two, and all stay where that document is the smallest. Other columns of ``docs`` are left out,
    whatever their names; an empty table gives an empty result.
    """
    rows = numbered(docs, text, key).withColumn("v", F.xxhash64("t"))
    lines = hashed_lines(rows, least_chars)
    shared = cut_lineage(shared_lines(lines, least_docs), "shared-lines")
    # Equal rows have equal positions, so a set per (key, text) serves all of them; it is no longer than the text has lines.
    gone = repeated_lines(lines, shared, hot_part).groupBy("d", "v").agg(F.sort_array(F.collect_set("p")).alias("gone"))
    whole = rows.join(gone, ["d", "v"], "left").select("d", F.split("t", "\n", -1).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # What stays are the slices between dropped lines: work in proportion to lines, however many are dropped.
    n = F.size("lines")
    gaps = F.arrays_zip(F.concat(F.array(F.lit(-1)), "gone").alias("a"), F.concat("gone", F.array(n)).alias("b"))
    kept = F.flatten(F.transform(gaps, lambda x: F.slice(F.col("lines"), x["a"] + 2, x["b"] - x["a"] - 1)))
    out = whole.select("d", n.cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))
    return named(out, docs, key)
