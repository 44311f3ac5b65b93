"""Features of event trajectories.

Input: ``flight_id, event_id, ts, event_type, lon, lat, altitude, info``. "Ordered" means by ``(ts, event_id)`` inside a
flight. Looks at neighbouring events go through ``windowed`` and running counts through ``running``, so a flight with a very
large share of all events is cut into ranges. What a flight adds up to is an ordinary two-step aggregate. Time is carried as
whole microseconds, which add up exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from latewing.functions.geo import bearing_deg, haversine_km, turn_deg
from latewing.operators.joins import left_lookup
from latewing.operators.ordered import CHUNK_ROWS, known_size, running, windowed
from latewing.operators.quantiles import value_counts
from latewing.schema import EXPECTED_EVENTS, LANDING, LEVEL, PARKING, TAKE_OFF, TAXI
from latewing.session import cut_lineage

ORDER = ("us", "event_id")
SECOND = 1e6
# The flight levels whose crossings are counted, in feet.
FLIGHT_LEVELS = {"fl50": 5000.0, "fl70": 7000.0, "fl100": 10000.0, "fl245": 24500.0}


def timed(events: DataFrame) -> DataFrame:
    """Add the event time as microseconds."""
    return events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def steps(
    events: DataFrame, cols: Sequence[str] = ("us",), rows: int | None = None, back: int = 1, ahead: int = 0,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Each event with columns of its neighbours: ``prev_<c>`` (``prev2_<c>`` …) and ``next_<c>``."""
    def names(word: str, k: int) -> str:
        return f"{word}{'' if k == 1 else k}"

    def columns(w):
        out = {f"{names('prev', k)}_{c}": F.lag(c, k).over(w) for k in range(1, back + 1) for c in cols}
        return out | {f"{names('next', k)}_{c}": F.lead(c, k).over(w) for k in range(1, ahead + 1) for c in cols}

    return windowed(timed(events), ["flight_id"], ORDER, columns, back, ahead, rows, chunk_rows)


def _seconds(us: Column) -> Column:
    return us / F.lit(SECOND)


GAP_US = "gap_us"


def with_gap(events: DataFrame, cols: Sequence[str] = (), rows: int | None = None, chunk_rows: int = CHUNK_ROWS):
    """Each event with its predecessor's columns and the time since, in microseconds."""
    return steps(events, ["us", *cols], rows, chunk_rows=chunk_rows).withColumn(GAP_US, F.col("us") - F.col("prev_us"))


# --- order and sequence ---------------------------------------------------------------------------------------------

def reconstruct(events: DataFrame, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The flight in order, one row per event with its position: arrays would put a whole flight into one row."""
    one = timed(events).withColumn("_one", F.lit(1).cast("bigint"))
    return running(one, ["flight_id"], ORDER, {"seq_no": "_one"}, rows=rows, chunk_rows=chunk_rows).select(
        "flight_id", "seq_no", "us", "event_id", "event_type")


def parse_info(events: DataFrame, schema: str = "k int") -> DataFrame:
    return events.withColumn("info_fields", F.from_json("info", schema))


def airport_pair(events: DataFrame, field: str = "k") -> DataFrame:
    """First and last place mentioned in a flight's ``info``."""
    parsed = timed(parse_info(events)).select("flight_id", F.struct(*ORDER).alias("o"), F.col(f"info_fields.{field}").alias("v"))
    return parsed.where(F.col("v").isNotNull()).groupBy("flight_id").agg(
        F.min_by("v", "o").alias("origin_ref"), F.max_by("v", "o").alias("dest_ref"))


def ngrams(events: DataFrame, n: int = 2, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every run of ``n`` consecutive event types: ``(flight_id, gram)``, one row per run."""
    parts = [f"prev{'' if k == 1 else k}_event_type" for k in range(n - 1, 0, -1)]
    df = steps(events, ["event_type"], rows, back=n - 1, chunk_rows=chunk_rows)
    return df.where(F.col(parts[0]).isNotNull()).select("flight_id", F.concat_ws(">", *parts, "event_type").alias("gram"))


def ngram_counts(events: DataFrame, n: int = 2, rows: int | None = None) -> DataFrame:
    return ngrams(events, n, rows).groupBy("gram").agg(F.count(F.lit(1)).alias("count"))


def rare_sequences(events: DataFrame, n: int = 3, max_share: float = 0.1, rows: int | None = None) -> DataFrame:
    """Runs of ``n`` events seen in fewer than a share of all flights."""
    per_flight = ngrams(events, n, rows).groupBy("gram", "flight_id").agg(F.count(F.lit(1)).alias("c"))
    support = per_flight.groupBy("gram").agg(F.count(F.lit(1)).alias("flights"), F.sum("c").alias("count"))
    total = events.agg(F.count_distinct("flight_id")).scalar()
    return support.withColumn("_all", total).where(F.col("flights") < F.col("_all") * max_share).drop("_all")


def bad_order(events: DataFrame, illegal: Sequence[tuple[str, str]], rows: int | None = None) -> DataFrame:
    """Illegal successions per flight."""
    rule = F.concat_ws(">", "prev_event_type", "event_type").isin([">".join(p) for p in illegal])
    return steps(events, ["event_type"], rows).groupBy("flight_id").agg(
        F.count_if(F.col("prev_event_type").isNotNull() & rule).alias("violations"))


def _successions(events: DataFrame, rows: int | None, *by: str) -> DataFrame:
    """How often one kind directly follows another, per ``by``."""
    return steps(events, ["event_type"], rows).where(F.col("prev_event_type").isNotNull()).groupBy(
        *by, "prev_event_type", "event_type").agg(F.count(F.lit(1)).alias("n"))


def transition_probabilities(events: DataFrame, rows: int | None = None) -> DataFrame:
    """``(prev_event_type, event_type, n, prob)``; the totals per type are summed over the short table of pair counts."""
    return _shares(_successions(events, rows))


def _shares(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("prev_event_type")))


def markov_likelihood(events: DataFrame, rows: int | None = None) -> DataFrame:
    """Log-likelihood of each flight under the fleet's transition probabilities, and its mean per step.

    One ordered pass: the fleet's counts are those of the flights added up.
    """
    own = cut_lineage(_successions(events, rows, "flight_id"), "successions").withColumnRenamed("n", "c")
    fleet = own.groupBy("prev_event_type", "event_type").agg(F.sum("c").alias("n"))
    probs = cut_lineage(_shares(fleet), "transitions").select("prev_event_type", "event_type", "prob")
    joined = left_lookup(own, probs, ["prev_event_type", "event_type"])
    total = F.sum(F.col("c") * F.ln("prob"))
    return joined.groupBy("flight_id").agg(
        F.sum("c").alias("steps"), total.alias("log_likelihood"), (total / F.sum("c")).alias("mean_log_prob"))


# --- time -----------------------------------------------------------------------------------------------------------

def duration(events: DataFrame) -> DataFrame:
    return timed(events).groupBy("flight_id").agg(
        _seconds(F.max("us") - F.min("us")).alias("duration_s"), F.count(F.lit(1)).alias("events"))


def ground_taxi_time(events: DataFrame, rows: int | None = None) -> DataFrame:
    """Seconds from landing to parking and from taxiing to take-off, over directly following events."""
    df = with_gap(events, ["event_type"], rows)

    def between(a: str, b: str) -> Column:
        hit = (F.col("prev_event_type") == a) & (F.col("event_type") == b)
        return _seconds(F.coalesce(F.sum(F.when(hit, F.col(GAP_US))), F.lit(0)))

    return df.groupBy("flight_id").agg(
        between(LANDING, PARKING).alias("landing_to_parking_s"), between(TAXI, TAKE_OFF).alias("taxi_to_take_off_s"))


def phase_time(events: DataFrame, rows: int | None = None) -> DataFrame:
    """Seconds a flight spent after each kind of event, until the next one."""
    df = steps(events, ["us"], rows, back=0, ahead=1)
    spent = F.sum(F.col("next_us") - F.col("us"))
    return df.groupBy("flight_id", "event_type").agg(_seconds(F.coalesce(spent, F.lit(0))).alias("seconds"))


def gap_stats(events: DataFrame, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    gap = _seconds(F.col(GAP_US))
    return with_gap(events, [], rows, chunk_rows).groupBy("flight_id").agg(
        (F.sum(GAP_US) / F.lit(SECOND) / F.count(GAP_US)).alias("mean_gap_s"), F.stddev(gap).alias("std_gap_s"),
        _seconds(F.max(GAP_US)).alias("max_gap_s"))


def long_hold(events: DataFrame, min_seconds: float, ground: Sequence[str] = (TAXI, PARKING), rows: int | None = None):
    """Gaps above a threshold that began on the ground."""
    df = with_gap(events, ["event_type"], rows)
    long = (F.col(GAP_US) > min_seconds * SECOND) & F.col("prev_event_type").isin(list(ground))
    return df.where(long).select("flight_id", "event_id", "prev_event_type", _seconds(F.col(GAP_US)).alias("gap_s"))


def event_rate(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), width).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("events")).select(F.unix_micros("w.start").alias("window_start"), "event_type", "events")


def temporal_patterns(events: DataFrame) -> DataFrame:
    """Events and flights by hour of day; night is 22-6."""
    hour = F.hour("ts")
    night = (hour >= 22) | (hour < 6)
    return events.groupBy(hour.alias("hour"), night.alias("night")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("flight_id").alias("flights"))


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("flight_id").alias("flights"))


def rolling(events: DataFrame, k: int = 5, col: str = "altitude", rows: int | None = None, chunk_rows: int = CHUNK_ROWS):
    """Mean and deviation of the last ``k`` events, per event."""
    def columns(w):
        frame = w.rowsBetween(-(k - 1), 0)
        return {"roll_mean": F.avg(col).over(frame), "roll_std": F.stddev(col).over(frame)}

    return windowed(timed(events), ["flight_id"], ORDER, columns, back=k - 1, rows=rows, chunk_rows=chunk_rows).select(
        "flight_id", "event_id", "roll_mean", "roll_std")


def level_segments(events: DataFrame, kind: str = LEVEL, rows: int | None = None, chunk_rows: int = CHUNK_ROWS):
    """Runs of consecutive events of one kind: ``(flight_id, segment, start_us, end_us, events)``."""
    df = steps(events, ["event_type"], rows, chunk_rows=chunk_rows)
    fresh = (F.col("event_type") == kind) & ~F.col("prev_event_type").eqNullSafe(F.lit(kind))
    flagged, rows = known_size(df.withColumn("_fresh", fresh.cast("bigint")).select(
        "flight_id", "us", "event_id", "event_type", "_fresh"), rows, chunk_rows)
    numbered = running(flagged, ["flight_id"], ORDER, {"segment": "_fresh"}, rows=rows, chunk_rows=chunk_rows)
    return numbered.where(F.col("event_type") == kind).groupBy("flight_id", "segment").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("events"))


# --- space ----------------------------------------------------------------------------------------------------------

POSITION = ("lat", "lon")


def _leg() -> Column:
    return haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))


def path_length(events: DataFrame, rows: int | None = None) -> DataFrame:
    return steps(events, POSITION, rows).groupBy("flight_id").agg(
        F.coalesce(F.sum(_leg()), F.lit(0.0)).alias("distance_km"))


def sinuosity(events: DataFrame, rows: int | None = None) -> DataFrame:
    """Path length over the direct distance between the ends; NULL when the ends coincide."""
    df = steps(events, POSITION, rows).withColumns({"_o": F.struct(*ORDER), "_p": F.struct("lat", "lon"), "_km": _leg()})
    ends = df.groupBy("flight_id").agg(
        F.coalesce(F.sum("_km"), F.lit(0.0)).alias("distance_km"), F.min_by("_p", "_o").alias("a"), F.max_by("_p", "_o").alias("b"))
    direct = haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return ends.select("flight_id", "distance_km", direct.alias("direct_km")).withColumn(
        "sinuosity", F.try_divide("distance_km", "direct_km"))


def direction_changes(events: DataFrame, min_turn: float = 45.0, rows: int | None = None) -> DataFrame:
    """Turns above a threshold at inner points of a flight."""
    df = steps(events, POSITION, rows, back=1, ahead=1)
    arriving = bearing_deg(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    leaving = bearing_deg(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon"))
    return df.groupBy("flight_id").agg(F.count_if(turn_deg(arriving, leaving) > min_turn).alias("turns"))


def teleports(events: DataFrame, max_kmh: float, rows: int | None = None) -> DataFrame:
    """Steps whose implied speed is impossible."""
    df = steps(events, ["us", *POSITION], rows).withColumn("km", _leg())
    hours = (F.col("us") - F.col("prev_us")) / F.lit(3.6e9)
    return df.withColumn("kmh", F.try_divide(F.col("km"), hours)).where(F.col("kmh") > max_kmh).select(
        "flight_id", "event_id", "km", "kmh")


def altitude_profile(events: DataFrame, rows: int | None = None) -> DataFrame:
    """Level, spread and vertical speed of a flight; ``cruise_var`` looks at level events only."""
    df = steps(events, ["us", "altitude"], rows)
    rate = F.try_divide(F.col("altitude") - F.col("prev_altitude"), (F.col("us") - F.col("prev_us")) / F.lit(6e7))
    return df.withColumn("_rate", rate).groupBy("flight_id").agg(
        F.max("altitude").alias("max_alt"), F.avg("altitude").alias("mean_alt"), F.stddev("altitude").alias("std_alt"),
        F.max(F.when(F.col("_rate") > 0, F.col("_rate"))).alias("max_climb_per_min"),
        F.min(F.when(F.col("_rate") < 0, F.col("_rate"))).alias("max_descent_per_min"),
        F.avg(F.abs("_rate")).alias("mean_abs_rate_per_min"),
        F.var_samp(F.when(F.col("event_type") == LEVEL, F.col("altitude"))).alias("cruise_var"))


def level_crossings(events: DataFrame, levels: dict[str, float] = FLIGHT_LEVELS, rows: int | None = None) -> DataFrame:
    """Upward and downward crossings of each flight level."""
    a, b = F.col("prev_altitude"), F.col("altitude")
    cols = []
    for name, h in levels.items():
        cols += [F.count_if((a < h) & (b >= h)).alias(f"{name}_up"), F.count_if((a >= h) & (b < h)).alias(f"{name}_down")]
    return steps(events, ["altitude"], rows).groupBy("flight_id").agg(*cols)


def unusual_altitude(events: DataFrame, level: float = 1000.0, tolerance: float = 300.0, rows: int | None = None):
    """Distance to the nearest standard level: largest, events beyond a tolerance, seconds spent there."""
    off = F.abs(F.col("altitude") - F.floor(F.col("altitude") / level + 0.5) * level)
    df = steps(events, ["us"], rows, back=0, ahead=1).withColumn("_off", off)
    away = F.col("_off") > tolerance
    return df.groupBy("flight_id").agg(
        F.max("_off").alias("max_off"), F.count_if(away).alias("events_off"),
        _seconds(F.coalesce(F.sum(F.when(away, F.col("next_us") - F.col("us"))), F.lit(0))).alias("seconds_off"))


# --- counts and flags -----------------------------------------------------------------------------------------------

def event_counts(events: DataFrame, kinds: Sequence[str] = EXPECTED_EVENTS) -> DataFrame:
    """Events of each listed kind, and of all others together."""
    other = ~F.coalesce(F.col("event_type").isin(*kinds), F.lit(False))
    return events.groupBy("flight_id").agg(
        *[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds], F.count_if(other).alias("n_other"))


def go_arounds(events: DataFrame) -> DataFrame:
    return events.groupBy("flight_id").agg(
        F.count_if(F.col("event_type") == TAKE_OFF).alias("take_offs"),
        F.count_if(F.col("event_type") == LANDING).alias("landings")).withColumn(
        "go_around", (F.col("take_offs") > 1) | (F.col("landings") > 1))


def missing_events(events: DataFrame, expected: Sequence[str] = EXPECTED_EVENTS) -> DataFrame:
    """Expected kinds a flight never shows, in the order of the list."""
    seen = events.groupBy("flight_id").agg(*[F.max(F.col("event_type") == k).alias(f"_{k}") for k in expected])
    absent = F.array_compact(F.array(*[F.when(~F.col(f"_{k}"), F.lit(k)) for k in expected]))
    return seen.select("flight_id", absent.alias("missing")).withColumn("n_missing", F.size("missing"))


def dq_report(events: DataFrame, keys: Sequence[str] = ("flight_id", "ts", "event_type")) -> DataFrame:
    """Events, incomplete values, surplus copies, flights, and flights without a take-off or a landing."""
    copies = events.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(F.sum("extra")).scalar()
    flights = go_arounds(events).agg(F.struct(
        F.count(F.lit(1)).alias("flights"),
        F.count_if((F.col("take_offs") == 0) | (F.col("landings") == 0)).alias("incomplete")).alias("f")).scalar()
    broken = F.col("ts").isNull() | F.col("lat").isNull() | F.col("lon").isNull() | F.col("altitude").isNull()
    corrupt = F.from_json("info", "k int").getField("k").isNull()
    return events.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(broken).alias("missing_values"), F.count_if(corrupt).alias("corrupt_info"),
    ).withColumns({"duplicates": copies, "_f": flights}).select(
        "events", "missing_values", "corrupt_info", "duplicates", "_f.flights", F.col("_f.incomplete").alias("incomplete_flights"))


def dedup_events(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The copy with the smallest id of every group of equal events."""
    return events.groupBy(*keys).agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("copies"))


# --- comparison with peers ------------------------------------------------------------------------------------------

def peer_stats(flights: DataFrame, value: str, peer: Sequence[str]) -> DataFrame:
    """Add mean and deviation of a value over all flights of the same peer group (all flights for no key).

    The group table has one row per group; it is written out, measured, and broadcast if small. The group without a key counts too.
    """
    cols = [F.avg(value).alias("peer_mean"), F.stddev(value).alias("peer_std"), F.count(value).alias("peers")]
    if not peer:
        fleet = flights.agg(F.struct(*cols).alias("s")).scalar()
        return flights.withColumn("_s", fleet).select(*flights.columns, "_s.*")
    return left_lookup(flights, cut_lineage(flights.groupBy(*peer).agg(*cols), "peers"), peer, null_safe=True)


def peer_zscore(flights: DataFrame, value: str, peer: Sequence[str] = (), out: str = "z") -> DataFrame:
    """(value - mean) / deviation; NULL where the group has no spread."""
    z = F.try_divide(F.col(value) - F.col("peer_mean"), F.nullif(F.col("peer_std"), F.lit(0.0)))
    return peer_stats(flights, value, peer).withColumn(out, z).drop("peer_mean", "peer_std", "peers")


def length_vs_peers(flights: DataFrame, peer: Sequence[str], length: str = "events") -> DataFrame:
    return peer_stats(flights, length, peer).withColumn("excess", F.col(length) - F.col("peer_mean")).drop(
        "peer_mean", "peer_std", "peers")


def percent_rank(flights: DataFrame, value: str, out: str = "pct_rank", rows: int | None = None,
                 chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Exact percentile rank over all flights; equal values are ranked once and looked up."""
    counts, rows = known_size(value_counts(flights, [value]), rows, chunk_rows)
    ranked = running(counts, [], ["value"], {"_cum": "n"}, {"_all": "n"}, rows, chunk_rows)
    share = F.coalesce(F.try_divide(F.col("_cum") - F.col("n"), F.col("_all") - 1), F.lit(0.0))
    table = ranked.select(F.col("value").alias(value), share.alias(out))
    return left_lookup(flights, cut_lineage(table, "ranks"), [value], null_safe=True)


def starts(events: DataFrame) -> DataFrame:
    """Per flight: duration, number of events, hour and kind of the first event."""
    df = timed(events)
    first = F.min_by(F.struct(F.hour("ts").alias("hour"), "event_type"), F.struct(*ORDER))
    return df.groupBy("flight_id").agg(
        _seconds(F.max("us") - F.min("us")).alias("duration_s"), F.count(F.lit(1)).alias("events"), first.alias("f")).select(
        "flight_id", "duration_s", "events", F.col("f.hour").alias("start_hour"), F.col("f.event_type").alias("first_type"))
