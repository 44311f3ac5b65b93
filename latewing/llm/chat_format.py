"""Chat formatting with Spark expressions only.

A conversation's turns are collected, sorted and joined into one text. Adjacent turns of one role share a block:

    <turn>user<text>first<next>second</turn>

``&`` and ``<`` inside roles and texts are written as ``&amp;`` and ``&lt;``, so no text can hold a mark of the template and every
text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, TEXT, NEXT, CLOSE = "<turn>", "<text>", "<next>", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted text, and its segments with the loss mask; the segments joined are the formatted text.

    Rows with null or empty text are turns with an empty text, a null role is an empty one. Turns are sorted by (turn, role, text),
    null turns first; repeated rows are turns of their own. A null conv_id is a conversation. Other columns are left out.
    """
    def begins(all_turns: Column, t: Column, i: Column) -> Column:
        return (i == 0) | (F.get(all_turns, i - 1)["role"] != t["role"])

    def pieces(t: Column, i: Column) -> Column:
        all_turns = F.col("turns")
        ends = (i + 1 == F.size(all_turns)) | (F.get(all_turns, i + 1)["role"] != t["role"])
        head = F.when(begins(all_turns, t, i), F.concat(F.lit(OPEN), escape(t["role"]), F.lit(TEXT))).otherwise(F.lit(NEXT))
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(segment(head, F.lit(False)), segment(escape(t["text"]), t["role"] == trained),
                       segment(F.when(ends, F.lit(CLOSE)).otherwise(F.lit("")), F.lit(False)))

    rows = turns.select(
        F.col("conv_id"),
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return (
        rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))
        .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), in order."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")
    def turns(b: Column) -> Column:
        inner = F.substring(b, F.lit(len(OPEN) + 1), F.length(b))
        role = unescape(F.split_part(inner, F.lit(TEXT), F.lit(1)))
        return F.transform(F.split(F.split_part(inner, F.lit(TEXT), F.lit(2)), NEXT, -1),
                           lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def read_trained(segments: Column) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
