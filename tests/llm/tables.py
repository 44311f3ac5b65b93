"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

EXTRA = ("k", "t", "d", "h", "n", "part", "fp", "row", "hashes", "runs", "base", "turns")


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["the", "of", "nach", "über", "été", "niño", "a", "x1", "@", "17", "end."]
    parts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 60))) for _ in range(6)]
    out = [(i, rnd.choice(["", " ", "\n"]).join(rnd.choice(parts) for _ in range(rnd.randrange(4))) + rnd.choice(["", " tail", "  "]))
           for i in range(n)]
    out += [(n, None), (n + 1, ""), (n + 2, "  \n\t"), (n + 3, "a" * 30_000), (n + 4, "word " * 9_000), (n + 5, "\U0001f600é" * 400)]
    out += [(None, parts[0]), (None, None), (7, parts[1]), (7, parts[1]), (n + 6, parts[2] + " " + parts[3])]
    return out


def documents(spark, data=None):
    """doc_id, text and columns whose names operators use inside."""
    data = rows() if data is None else data
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    df = spark.createDataFrame([(d, t, None, None, None if t is None else len(t)) for d, t in data], kinds).repartition(3)
    for c in EXTRA:
        df = df.selectExpr("*", f"'clash' AS `{c}`")
    return df


def empty(spark):
    return documents(spark).limit(0)
