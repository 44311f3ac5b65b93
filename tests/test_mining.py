"""Sequences grown over projected flights against counting every subsequence."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from latewing.operators import mining
from latewing.operators.ordered import following_min


def made(spark, data):
    rows = [(f, i, t, k) for i, (f, t, k) in enumerate(data)]
    return spark.createDataFrame(rows, "flight_id string, event_id long, ts long, event_type string").withColumn("ts", F.timestamp_seconds("ts"))


def brute(data, share, length):
    flights = {}
    for i, (f, t, k) in enumerate(data):
        if k is not None:
            flights.setdefault(f, []).append((t, i, k))
    held = {}
    for f, seq in flights.items():
        kinds = [k for *_, k in sorted(seq)]
        for n in range(1, length + 1):
            for p in set(combinations(kinds, n)):
                held.setdefault(p, set()).add(f)
    least = max(1, -(-int(share * 1000) * len(flights) // 1000))
    often = {p: len(f) for p, f in held.items() if len(f) >= least}
    rare = {p: len(f) for p, f in held.items() if len(f) < least and all(p[:i] + p[i + 1:] in often for i in range(len(p)) if len(p) > 1)}
    return often, rare, {f: n for f in flights if (n := sum(f in held[p] for p in rare))}


def random_events(seed, flights=40, hot=60):
    rnd = random.Random(seed)
    data = [(f"f{rnd.randrange(flights)}", rnd.randrange(50), rnd.choice("aaabbcdexyz")) for _ in range(150)]
    data += [("hot", rnd.randrange(50), rnd.choice("abc")) for _ in range(hot)]
    data += [("f1", 3, None), ("none", 1, None)]
    rnd.shuffle(data)
    return data


@pytest.mark.parametrize("chunk_rows", [1_000_000, 25])
def test_against_all_subsequences(spark, chunk_rows):
    data = [x for x in random_events(3, hot=20)]
    often, rare, holders = brute(data, 0.1, 3)
    m = mining.mine(made(spark, data), 0.1, 3, len(data), chunk_rows)
    assert {tuple(r.pattern): r.flights for r in mining.frequent_patterns(m).collect()} == often
    found = mining.rare_patterns(m)
    assert {tuple(r.pattern): r.flights for r in found.collect()} == rare and rare
    assert {r.flight_id: r.patterns for r in mining.rare_flights(m, found).collect()} == holders


def test_nothing_to_mine(spark):
    m = mining.mine(made(spark, []), 0.5, 3, 0)
    assert mining.frequent_patterns(m).count() == 0 and mining.rare_patterns(m).count() == 0
    few = mining.mine(made(spark, [("a", 1, "x"), ("b", 1, "y")]), 1.0, 3, 2)
    assert mining.frequent_patterns(few).count() == 0 and mining.rare_patterns(few).count() == 2


def test_following_min_on_split_keys(spark):
    data = random_events(5)
    df = made(spark, [x for x in data if x[2]]).withColumn("us", F.unix_micros("ts")).withColumn("v", F.when(F.col("event_type") == "a", F.col("event_id")))
    out = [sorted((r.event_id, r.m) for r in following_min(df, ["flight_id"], ["us", "event_id"], {"m": "v"}, len(data), c).select("event_id", "m").collect())
           for c in (1_000_000, 20)]
    assert out[0] == out[1] and any(m is not None for _, m in out[0])
