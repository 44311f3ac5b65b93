import time

from pyspark.sql import functions as F

from latewing.llm import line_dedup
from tests.llm.tables import documents, empty, rows

BLANKS = " \t\n\x0b\x0c\r"


def brute(data, least_chars=10, least_docs=2):
    order = lambda d: float("-inf") if d is None else d
    low = str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower())
    lines = [(d, [(x, x.strip(BLANKS).translate(low)) for x in (t or "").split("\n")]) for d, t in data]
    held = {}
    for d, some in lines:
        for _, k in some:
            held.setdefault(k, set()).add(order(d))
    out = []
    for d, some in lines:
        kept = [x for x, k in some if len(k) < least_chars or len(held[k]) < least_docs or order(d) == min(held[k])]
        out.append((d, len(some), len(some) - len(kept), "\n".join(kept)))
    return out


def check(spark, data, **options):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.remove_lines(documents(spark, data), **options).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(brute(data, **{k: v for k, v in options.items() if k != "hot_part"}), key=key)


def odd_lines():
    shared = ["Licensed under terms", "  licensed UNDER terms\t", "LICENSED UNDER TERMS", "ÀÉÎ ÜÖ straße", "àéî üö straße", "short", "\U0001f600" * 10,
              "nine char", "ten chars!", "\x0b\x0c padded line \r", "nbsp\xa0line here", "nbsp line here", ""]
    data = [(i, "\n".join(shared[(i * k) % len(shared)] for k in range(1, 9))) for i in range(40)]
    return data + rows() + [(3, "Licensed under terms"), (None, "licensed under terms\n\n"), (500, None), (500, "ten chars!\nten chars!"), (-5, "TEN CHARS!")]


def test_against_brute_force(spark):
    check(spark, odd_lines())
    check(spark, odd_lines(), hot_part=2.0)          # none is hot
    check(spark, odd_lines(), hot_part=0.0)          # all are
    check(spark, odd_lines(), least_docs=3, least_chars=5)


def test_a_third_of_all_lines_are_equal(spark):
    check(spark, [(i % 300, "\n".join(["a line that all have", f"line of document {i}", f"line of the ten {i % 10}"])) for i in range(600)])


def test_no_exchange_gets_a_hot_line(spark):
    docs = documents(spark, [(i, f"a line that all have\nown line {i}") for i in range(200)])
    lines = line_dedup.hashed_lines(docs.select(F.col("doc_id").alias("d"), F.col("text").alias("t"), F.xxhash64("text").alias("v")), 10)
    shared = line_dedup.shared_lines(lines, 2)
    plan = line_dedup.repeated_lines(lines, shared)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan


def test_time_grows_with_the_lines(spark):
    """Long texts of which every second line goes: four times the lines take no more than some eight times the time."""
    took = []
    for n in (1000, 50_000, 200_000):
        data = [(1, "\n".join(f"shared line {i}" for i in range(n))), (2, "\n".join(f"shared line {i}\nown line {i}" for i in range(n)))]
        begin = time.monotonic()
        got = line_dedup.remove_lines(documents(spark, data)).where("doc_id = 2").select("n_lines", "n_dropped", F.length("kept").alias("n")).first()
        took.append(time.monotonic() - begin)
        assert (got.n_lines, got.n_dropped, got.n) == (2 * n, n, len("\n".join(f"own line {i}" for i in range(n))))
    assert took[2] < 8 * took[1] + 2


def test_empty(spark):
    assert line_dedup.remove_lines(empty(spark)).count() == 0
