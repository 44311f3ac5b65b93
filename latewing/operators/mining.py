"""Frequent and rare event sequences with gaps, grown over projected flights.

A pattern occurs in a flight if its kinds of event follow one another in that order, whatever lies between. Its projection onto a
flight is only the place where its earliest occurrence ends; one kind more moves that place to the next event of the kind, which
one ordered pass has noted beside every event. So a growing step is an equi-join on (flight, place), and its counts are two-step
aggregates: neither a common prefix nor a flight with a large share of all events meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, functions as F

from latewing.operators.joins import fits_broadcast
from latewing.operators.ordered import CHUNK_ROWS, following_min
from latewing.operators.trajectory import reconstruct
from latewing.session import cut_lineage


@dataclass(frozen=True)
class Mined:
    """``patterns``: (pattern, length, flights, frequent) of the frequent patterns and of those one kind longer that just fail.

    ``places``: (flight_id, pattern, place), the end of the earliest occurrence of each of these patterns.
    """

    patterns: DataFrame
    places: DataFrame
    least: int


def _having(df: DataFrame, patterns: DataFrame) -> DataFrame:
    short = patterns.select("pattern")
    return df.join(F.broadcast(short) if fits_broadcast(short) else short, "pattern", "left_semi")


def mine(events: DataFrame, min_share: float, max_length: int, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> Mined:
    """All patterns of at most ``max_length`` kinds that at least ``min_share`` of the flights show, with exact supports.

    Only frequent kinds are grown: there are at most (mean kinds of a flight) / ``min_share`` of them, which bounds what comes to
    the driver. Events without a kind take no part.
    """
    known = events.where(F.col("event_type").isNotNull())
    seq = cut_lineage(reconstruct(known, rows, chunk_rows).select("flight_id", "seq_no", "event_type"), "sequences")
    flights = seq.select("flight_id").distinct().count()
    least = max(1, ceil(min_share * flights))
    place = cut_lineage(seq.groupBy("flight_id", "event_type").agg(F.min("seq_no").alias("place")).select(
        "flight_id", F.array("event_type").alias("pattern"), "place"), "places")
    support = [_support(place, least)]
    kinds = sorted(r.pattern[0] for r in support[0].where("frequent").collect())
    places = [place]
    if kinds and max_length > 1:
        marks = seq.withColumns({f"_e{i}": F.when(F.col("event_type") == k, F.col("seq_no")) for i, k in enumerate(kinds)})
        noted = following_min(marks, ["flight_id"], ["seq_no"], {f"_n{i}": f"_e{i}" for i in range(len(kinds))}, rows, chunk_rows)
        steps = cut_lineage(noted.select("flight_id", F.col("seq_no").alias("place"), F.array(*[f"_n{i}" for i in range(len(kinds))]).alias("next")), "next-events")
    names = F.array(*map(F.lit, kinds)).cast("array<string>")
    for _ in range(1, max_length):
        frequent = support[-1].where("frequent")
        if not kinds or frequent.isEmpty():
            break
        grown = _having(places[-1], frequent).join(steps, ["flight_id", "place"]).select(
            "flight_id", "pattern", F.posexplode("next").alias("i", "place")).where(F.col("place").isNotNull())
        places.append(cut_lineage(grown.select("flight_id", F.concat("pattern", F.array(F.get(names, F.col("i")))).alias("pattern"), "place"), "places"))
        support.append(_support(places[-1], least))
    return Mined(reduce(DataFrame.unionByName, support), reduce(DataFrame.unionByName, places), least)


def _support(place: DataFrame, least: int) -> DataFrame:
    n = place.groupBy("pattern").agg(F.count(F.lit(1)).alias("flights"))
    return cut_lineage(n.select("pattern", F.size("pattern").alias("length"), "flights", (F.col("flights") >= least).alias("frequent")), "supports")


def frequent_patterns(mined: Mined) -> DataFrame:
    return mined.patterns.where("frequent").select("pattern", "length", "flights")


def rare_patterns(mined: Mined) -> DataFrame:
    """Patterns that are themselves too rare while all they hold, one kind less, is frequent: ``(pattern, length, flights)``."""
    rare = mined.patterns.where("NOT frequent").select("pattern", "length", "flights")
    without = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda i: F.concat(
        F.slice("pattern", F.lit(1), i), F.slice("pattern", i + 2, F.col("length") - i - 1)))
    parts = rare.where("length > 1").select(F.col("pattern").alias("whole"), F.explode(F.array_distinct(without)).alias("pattern"))
    frequent = mined.patterns.where("frequent").select("pattern")
    broken = parts.join(frequent, "pattern", "left_anti").select(F.col("whole").alias("pattern")).distinct()
    return rare.join(broken, "pattern", "left_anti")


def rare_flights(mined: Mined, rare: DataFrame) -> DataFrame:
    """Flights that show rare patterns: how many, and how few flights show the rarest of them."""
    own = mined.places.join(F.broadcast(rare) if fits_broadcast(rare) else rare, "pattern")
    return own.groupBy("flight_id").agg(F.count(F.lit(1)).alias("patterns"), F.min("flights").alias("rarest"))
