"""Fréchet distances, usual paths, loops and aborted take-offs against plain recomputation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latewing.operators import routes
from latewing.schema import LEVEL, PARKING, TAKE_OFF, TAXI


def km(a, b):
    (p, q), (u, v) = ((math.radians(x) for x in t) for t in (a, b))
    h = math.sin((u - p) / 2) ** 2 + math.cos(p) * math.cos(u) * math.sin((v - q) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def frechet(a, b, i, j, known):
    if (i, j) not in known:
        before = [frechet(a, b, p, q, known) for p, q in ((i - 1, j), (i - 1, j - 1), (i, j - 1)) if p >= 0 and q >= 0]
        known[i, j] = max(km(a[i], b[j]), min(before)) if before else km(a[i], b[j])
    return known[i, j]


def events(spark, flights):
    """``flights``: id -> list of (lat, lon) or (lat, lon, kind)."""
    rows = [(f, 1000 * k + i, 60 * i, p[2] if len(p) > 2 else LEVEL, p[0], p[1]) for k, (f, path) in enumerate(flights.items()) for i, p in enumerate(path)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "flight_id string, event_id long, ts long, event_type string, lat double, lon double").withColumn(
        "ts", F.timestamp_seconds("ts"))


def test_frechet_equals_the_recursion():
    rng = np.random.default_rng(4)
    a, b = (rng.uniform(-80, 80, size=(20, 7, 2)) for _ in range(2))
    got = routes.frechet_km(a, b)
    assert all(abs(got[i] - frechet(a[i], b[i], 6, 6, {})) < 1e-6 for i in range(20))


@pytest.mark.parametrize("chunk_rows", [1_000_000, 40])
def test_paths_pick_equal_steps(spark, chunk_rows):
    rnd = random.Random(2)
    flights = {f"f{n}": [(rnd.uniform(-60, 60), rnd.uniform(-170, 170)) for _ in range(n)] for n in (1, 2, 3, 5, 8, 9, 31, 300)}
    flights["f9"][4] = (None, 1.0)
    df = events(spark, flights)
    got = {r.flight_id: [tuple(p) for p in r.path] for r in routes.paths(df, 5, df.count(), chunk_rows).collect()}
    for f, path in flights.items():
        known = [p for p in path if p[0] is not None]
        assert got[f] == [known[s * (len(known) - 1) // 4] for s in range(5)], f


def test_planted_detours_rank_first(spark):
    rng = np.random.default_rng(5)
    flights, pair = {}, {}
    for k in range(60):
        lat = np.linspace(0, 20, 12) + rng.normal(scale=0.2, size=12)
        lon = np.linspace(0, 30 if k % 2 else -30, 12) + rng.normal(scale=0.2, size=12)
        if k in (10, 33):
            lat[6] += 15
        flights[f"f{k:02d}"], pair[f"f{k:02d}"] = list(zip(lat.tolist(), lon.tolist())), ("west" if k % 2 else None)
    df = routes.paths(events(spark, flights), 12, 720).join(spark.createDataFrame([(f, p) for f, p in pair.items()], "flight_id string, pair string"), "flight_id")
    out = {r.flight_id: r for r in routes.route_deviation(df, ["pair"], 12, 8).collect()}
    assert len(out) == 60
    assert sorted(out, key=lambda f: -out[f].deviation_km)[:2] in (["f10", "f33"], ["f33", "f10"])
    for p in (None, "west"):
        own = [f for f in flights if pair[f] == p]
        usual = {out[f].usual for f in own}
        assert len(usual) == 1 and not usual & {"f10", "f33"}
        m = flights[usual.pop()]
        assert all(abs(out[f].deviation_km - frechet(flights[f], m, 11, 11, {})) < 1e-6 for f in own)


def circle(n, turns, radius=0.2, at=(10.0, 10.0)):
    return [(at[0] + radius * math.sin(2 * math.pi * turns * i / n), at[1] + radius * math.cos(2 * math.pi * turns * i / n)) for i in range(n + 1)]


@pytest.mark.parametrize("chunk_rows", [1_000_000, 16])
def test_holding(spark, chunk_rows):
    straight = [(0.1 * i, 0.3 * i) for i in range(40)]
    there_and_back = straight[:10] + straight[8::-1]
    flights = {"holds": straight[:10] + circle(24, 3), "straight": straight, "back": there_and_back, "one": straight[:1], "two": straight[:2]}
    df = events(spark, flights)
    got = {r.flight_id: r for r in routes.holding_patterns(df, 5.0, 300.0, 10, 3600.0, df.count(), chunk_rows).collect()}
    assert got["holds"].loops >= 10 and got["holds"].widest > 900
    assert {got[f].loops for f in ("straight", "back", "one", "two")} == {0} and len(got) == 5


def test_aborted(spark):
    at = (1.0, 1.0)
    flights = {"a": [(*at, TAKE_OFF), (*at, TAXI), (*at, TAKE_OFF), (*at, LEVEL)], "b": [(*at, TAKE_OFF), (*at, LEVEL), (*at, PARKING)], "c": [(*at, TAXI)]}
    got = {r.flight_id: r.aborted for r in routes.aborted_take_offs(events(spark, flights)).collect()}
    assert got == {"a": 1, "b": 0, "c": 0}
