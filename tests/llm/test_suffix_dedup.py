import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from latewing.llm import suffix_dedup
from latewing.llm.queries import QUERIES
from tests.llm.tables import documents, empty, rows


def brute(data, window):
    texts = [(t or "").encode() for _, t in data]
    seen = Counter(b[i:i + window] for b in texts for i in range(len(b) - window + 1))
    out = []
    for (d, _), b in zip(data, texts):
        step = np.zeros(len(b) + 1, int)
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                step[i] += 1
                step[i + window] -= 1
        gone = np.cumsum(step[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def ordered(x):
    return sorted(x, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("window, gram", [(20, 6), (40, 8), (40, 40)])
def test_against_brute_force(spark, window, gram):
    rnd = random.Random(window)
    base = ["".join(rnd.choice("ab é") for _ in range(rnd.randrange(300))) for _ in range(6)]
    data = [(i, "".join(rnd.choice(base)[rnd.randrange(50):][:rnd.randrange(200)] + rnd.choice(["", "x", "y"]) for _ in range(rnd.randrange(6))))
            for i in range(100)]
    data += [(200, None), (201, ""), (202, "a" * 500), (None, "a" * 70), (203, data[5][1]), (203, data[5][1])]
    got = suffix_dedup.remove_repeats(documents(spark, data), window, gram, batch_bytes=900)
    assert ordered(map(tuple, got.collect())) == ordered(brute(data, window))


def test_small_shards_and_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 700)
    data = [(d, t) for d, t in rows(3) if len(t or "") < 20_000]
    got = suffix_dedup.reads(np.frombuffer(data[3][1].encode() * 9, np.uint8), np.array([0, 9 * len(data[3][1].encode())]), 60, 16)
    text = data[3][1].encode() * 9
    starts = [s for a, n in zip(got[1], got[2]) for s in range(a, a + n - 60 + 1)]
    assert starts == list(range(len(text) - 60 + 1))
    assert all(off >= 0 and off + 16 <= n for off, n in zip(got[3], got[2]))


def test_query_against_brute_force(spark, sf):
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op10_suffix_dedup"].run(spark, sf).collect()
    assert ordered(map(tuple, got)) == ordered(brute(data, 400))


def test_empty(spark):
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    one = documents(spark, [(1, "ab" * 300)])
    assert suffix_dedup.remove_repeats(one, kept=True).first().kept == b""


@pytest.mark.parametrize("window, gram, hot", [(30, 8, 1), (30, 8, 20), (40, 40, 0), (64, 6, 5)])
def test_hot_minimizers_are_not_sorted(spark, monkeypatch, window, gram, hot):
    rnd = random.Random(hot)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(150))
    own = lambda: "".join(rnd.choice("abcdefghij é") for _ in range(rnd.randrange(90)))
    data = [(i, own() + passage + own()) for i in range(60)] + [(i, own() + passage[rnd.randrange(60):][:rnd.randrange(90)] + own()) for i in range(60, 120)]
    data += [(None, data[0][1]), (0, data[0][1]), (200, "a" * 300), (201, None), (202, passage[:70])]
    monkeypatch.setattr(suffix_dedup, "cut_lineage", lambda df, label, real=suffix_dedup.cut_lineage: made.setdefault(label, real(df, label)))
    made = {}
    got = suffix_dedup.remove_repeats(documents(spark, data), window, gram, batch_bytes=900, hot_reads=hot)
    assert ordered(map(tuple, got.collect())) == ordered(brute(data, window))
    assert made["hot_texts"].count() > 60               # different reads that no task sorts together
    assert window == gram or made["hot_reads"].where("n = 1").groupBy("a").count().where("count > 20").count() > 0
