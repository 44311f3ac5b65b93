"""Where a flight went: deviation from the usual path of its airport pair, holding patterns, aborted take-offs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from latewing.functions.buckets import key_text, md5_rank_text
from latewing.functions.geo import bearing_deg, haversine_km
from latewing.operators.joins import left_lookup
from latewing.operators.ordered import CHUNK_ROWS, known_size, running, windowed
from latewing.operators.trajectory import ORDER, POSITION, SECOND, steps, timed
from latewing.schema import PARKING, TAKE_OFF, TAXI
from latewing.session import cut_lineage

PATH_POINTS = 16            # positions that stand for a flight
CANDIDATES = 16             # flights of an airport pair that may become its usual path


# --- route deviation ------------------------------------------------------------------------------------------------

def paths(events: DataFrame, points: int = PATH_POINTS, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(flight_id, path)``: ``points`` positions at equal steps through a flight's events, the first and last included.

    A flight of any length becomes one short array; events are numbered by ``running``, and only those that stand for a step are
    exchanged. Events without a position take no part.
    """
    known = timed(events).where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("_one", F.lit(1).cast("bigint"))
    seq = running(known, ["flight_id"], ORDER, {"i": "_one"}, {"n": "_one"}, rows, chunk_rows)
    gaps, last = F.col("n") - 1, points - 1

    def first_step(i: Column) -> Column:
        return F.call_function("div", i * last + gaps - 1, F.greatest(gaps, F.lit(1))).cast("int")

    low, high = first_step(F.col("i") - 1), F.least(first_step(F.col("i")) - 1, F.lit(last))
    step = F.when(F.col("n") == 1, F.sequence(F.lit(0), F.lit(last))).when(low <= high, F.sequence(low, F.greatest(low, high)))
    marked = seq.select("flight_id", "lat", "lon", F.explode(step).alias("s"))
    return marked.groupBy("flight_id").agg(F.sort_array(F.collect_list(F.struct("s", "lat", "lon"))).alias("p")).select(
        "flight_id", F.transform("p", lambda x: F.struct(x["lat"].cast("double").alias("lat"), x["lon"].cast("double").alias("lon"))).alias("path"))


def frechet_km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Discrete Fréchet distance of paths ``a[i]`` and ``b[i]``: arrays of (row, point, latitude and longitude in degrees)."""
    x, y = np.radians(a), np.radians(b)
    lat, lon = y[:, None, :, 0] - x[:, :, None, 0], y[:, None, :, 1] - x[:, :, None, 1]
    h = np.sin(lat / 2) ** 2 + np.cos(x[:, :, None, 0]) * np.cos(y[:, None, :, 0]) * np.sin(lon / 2) ** 2
    d = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
    for i in range(d.shape[1]):
        for j in range(d.shape[2]):
            before = [d[:, p, q] for p, q in ((i - 1, j), (i - 1, j - 1), (i, j - 1)) if p >= 0 and q >= 0]
            if before:
                d[:, i, j] = np.maximum(d[:, i, j], reduce(np.minimum, before))
    return d[:, -1, -1]


def _paths(column: pa.Array, points: int) -> np.ndarray:
    flat = column.flatten()
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon")], axis=-1).reshape(-1, points, 2)


def distances(rows: DataFrame, points: int) -> DataFrame:
    """Fréchet distances of each row's path to the paths in its array ``others``, as an array ``km``; Arrow batches, rows of fixed size."""
    names = [c for c in rows.columns if c not in ("path", "others")]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            others = b.column("others")
            n = np.diff(others.offsets.to_numpy())
            own = _paths(b.column("path"), points)[np.repeat(np.arange(len(n)), n)]
            km = frechet_km(own, _paths(others.flatten(), points)) if len(own) else np.zeros(0)
            out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(km))
            yield pa.record_batch([*(b.column(c) for c in names), out], [*names, "km"])

    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", km array<double>")


def route_deviation(
    flights: DataFrame, pair: Sequence[str], points: int = PATH_POINTS, candidates: int = CANDIDATES, seed: int = 42,
) -> DataFrame:
    """``(flight_id, *pair, usual, deviation_km)``: Fréchet distance of each flight to its pair's usual path.

    The usual path is the medoid: of ``candidates`` flights of the pair, the lowest by a hash, the one with the smallest mean distance
    to all flights of the pair (the smaller id if equal). ``flights`` has flight_id, path of ``points`` positions, and the pair's columns.
    """
    order = [md5_rank_text(key_text("flight_id"), seed), F.col("flight_id")]
    number = F.row_number().over(Window.partitionBy(*pair).orderBy(*order))        # cut before the exchange to a few rows a pair and task
    chosen = flights.withColumn("_n", number).where(F.col("_n") <= candidates).groupBy(*pair).agg(
        F.sort_array(F.collect_list(F.struct("_n", "flight_id", "path"))).alias("c"))
    chosen = cut_lineage(chosen.select(*pair, F.transform("c", lambda x: x["flight_id"]).alias("ids"), F.transform("c", lambda x: x["path"]).alias("others")), "candidates")
    told = left_lookup(flights, chosen, pair, max_rows=20_000, null_safe=True)
    measured = cut_lineage(distances(told.select("flight_id", *pair, "ids", "path", "others"), points), "distances")
    means = measured.select(*pair, F.posexplode("km").alias("at", "km"), "ids").groupBy(*pair, "at", F.get("ids", F.col("at")).alias("id")).agg(F.avg("km").alias("mean"))
    best = means.groupBy(*pair).agg(F.min(F.struct("mean", "id", "at")).alias("m")).select(*pair, F.col("m.id").alias("usual"), F.col("m.at").alias("at"))
    out = left_lookup(measured, cut_lineage(best, "usual"), pair, null_safe=True)
    return out.select("flight_id", *pair, "usual", F.get("km", F.col("at")).alias("deviation_km"))


# --- holding patterns -----------------------------------------------------------------------------------------------

def cumulated_turns(events: DataFrame, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Each event with its signed turn in degrees (right positive, 0 at the ends) and the sum of turns up to it."""
    df = steps(events, POSITION, rows, back=1, ahead=1, chunk_rows=chunk_rows)
    arriving = bearing_deg(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    leaving = bearing_deg(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon"))
    turn = F.coalesce(F.pmod(leaving - arriving + 540.0, F.lit(360.0)) - 180.0, F.lit(0.0))
    sized, rows = known_size(df.select("flight_id", "us", "event_id", "lat", "lon", turn.alias("turn")), rows, chunk_rows)
    return running(sized, ["flight_id"], ORDER, {"turned": "turn"}, rows=rows, chunk_rows=chunk_rows)


def holding_patterns(
    events: DataFrame, radius_km: float, min_turn: float = 300.0, back: int = 8, max_seconds: float = 3600.0,
    rows: int | None = None, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(flight_id, loops, turned, widest)``: events that close a loop, the sum of turns, its largest size on the way.

    An event closes a loop if one of the last ``back`` events lies within ``radius_km`` and ``max_seconds``, and the flight has
    turned by at least ``min_turn`` degrees in one direction in between.
    """
    df, rows = known_size(cumulated_turns(events, rows, chunk_rows), rows, chunk_rows)

    def closes(w) -> Column:
        def behind(c: str, j: int) -> Column:
            return F.lag(c, j).over(w)

        def loop(j: int) -> Column:
            near = haversine_km(behind("lat", j), behind("lon", j), F.col("lat"), F.col("lon")) <= radius_km
            quick = F.col("us") - behind("us", j) <= max_seconds * SECOND
            return near & quick & (F.abs(behind("turned", 1) - behind("turned", j)) >= min_turn)
        return F.coalesce(F.greatest(*[F.coalesce(loop(j), F.lit(False)) for j in range(2, back + 1)]), F.lit(False))

    told = windowed(df, ["flight_id"], ORDER, lambda w: {"closes": closes(w)}, back=back, rows=rows, chunk_rows=chunk_rows)
    return told.groupBy("flight_id").agg(
        F.count_if("closes").alias("loops"), F.sum("turn").alias("turned"), F.max(F.abs("turned")).alias("widest"))


# --- aborted take-offs ----------------------------------------------------------------------------------------------

def aborted_take_offs(events: DataFrame, ground: Sequence[str] = (TAXI, PARKING), rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(flight_id, aborted)``: take-offs that a ground event follows at once."""
    df = steps(events, ["event_type"], rows, chunk_rows=chunk_rows)
    hit = (F.col("prev_event_type") == TAKE_OFF) & F.col("event_type").isin(list(ground))
    return df.groupBy("flight_id").agg(F.count_if(hit).alias("aborted"))
