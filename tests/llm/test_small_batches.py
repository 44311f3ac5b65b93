"""The same results when every exchange arrives in many small record batches, and large groups are cut."""

import random

import pytest

from latewing.llm import meeting, suffix_dedup
from tests.llm import test_piecewise_hash, test_simhash, test_substring_dedup, test_suffix_dedup
from tests.llm.tables import documents, rows


@pytest.fixture
def small(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("large, shard", [(1 << 20, 1 << 20), (3, 2_000), (1, 1)])
def test_suffix_dedup_in_pieces(small, monkeypatch, large, shard):
    monkeypatch.setattr(suffix_dedup, "LARGE_GROUP", large)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    rnd = random.Random(9)
    line = "one very common line " * 2
    data = [(i, "".join(rnd.choice("abcdefghij ") for _ in range(rnd.randrange(90))) + line + "".join(
        rnd.choice("ab") for _ in range(rnd.randrange(60)))) for i in range(80)] + [(i, line) for i in range(80, 95)]
    got = suffix_dedup.remove_repeats(documents(small, data), 30, 8, batch_bytes=600)
    assert test_suffix_dedup.ordered(map(tuple, got.collect())) == test_suffix_dedup.ordered(test_suffix_dedup.brute(data, 30))


def test_others_in_pieces(small):
    data = [(d, t) for d, t in rows(5) if len(t or "") < 20_000]
    test_substring_dedup.check(small, data, 12, 7)
    test_piecewise_hash.check(small, data)
    test_simhash.test_odd_rows(small)
    test_simhash.test_dense_groups_lose_no_link(small, 40)


def test_many_bins_in_a_partition(small, monkeypatch):
    """Bins of a few entries, sent in pieces of a few: each partition has hundreds, and results stay the same."""
    monkeypatch.setattr(meeting, "BIN_BYTES", 400)
    monkeypatch.setattr(meeting, "HELD_BYTES", 2_000)
    data = [(d, t) for d, t in rows(6) if len(t or "") < 20_000]
    docs = meeting.numbered(documents(small, data), "text", "doc_id")
    assert meeting.bins(docs) > 20 * meeting.partitions(docs)
    test_substring_dedup.check(small, data, 12, 7, batch_bytes=500)
    test_substring_dedup.check(small, [(i, "the same passage for all of them " * 4 + str(i)) for i in range(200)], 12, 7, batch_bytes=500)
