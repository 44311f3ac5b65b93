import zlib

import pytest
from pyspark.sql import functions as F

from latewing.llm import language_id
from latewing.llm.queries import QUERIES
from tests.llm.tables import documents, empty


@pytest.fixture(scope="module")
def learned(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, language_id.train(docs)


def test_held_out_accuracy(spark, sf, learned):
    docs, _ = learned
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = QUERIES["op5_language_id"].run(spark, sf).collect()
    assert {r.doc_id: r.held_out for r in got} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in truth}
    held = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 0.01 * len(got)


def test_labels_of_held_out_rows_are_never_used(learned):
    docs, model = learned
    lie = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    other = language_id.train(lie)
    assert other.languages == model.languages and (other.table == model.table).all()


def test_odd_rows(spark, learned):
    out = language_id.identify(documents(spark), learned[1]).collect()
    texts = documents(spark).collect()
    assert len(out) == len(texts)
    und = [r for r in out if r.lang_pred == "und"]
    assert len(und) == sum(not any(c.isalpha() for c in r.text or "") for r in texts) and all(r.rejected and r.score == 0 for r in und)
    assert language_id.identify(empty(spark), learned[1]).count() == 0


def test_without_labels(spark):
    model = language_id.train(documents(spark))
    assert model.languages == [] and language_id.train(empty(spark)).languages == []
    assert {r.lang_pred for r in language_id.identify(documents(spark), model).collect()} == {"und"}
    one = documents(spark).withColumn("lang", F.lit("aa"))
    assert {r.lang_pred for r in language_id.identify(one, language_id.train(one)).collect()} == {"aa", "und"}


def test_sample_is_bounded_by_rows_and_bytes(spark):
    rows = [(i, "aa", f"word {i}") for i in range(4_000)] + [(i, "bb", f"{i} " + "long text " * 300) for i in range(4_000, 4_400)]
    rows += [(9_999, "aa", "copied word")] * 2_000 + [(5_000, "cc", "only one"), (5_001, "cc", None), (None, "cc", "x"), (5_003, None, "x")]
    docs = spark.createDataFrame(rows, "k long, l string, t string").where("k is not null and l is not null and t is not null").repartition(5)
    draw = lambda *limits: [(r.l, r.k) for r in language_id._sample(docs, *limits).collect()]
    every = draw(10_000, 30_000, 1 << 40)
    assert len(every) == len(set(every)) == 4_402                       # copies once, nothing else lost
    few = draw(200, 6_000, 1 << 40)
    assert sum(x == "cc" for x, _ in few) == 1
    assert all(120 < sum(x == lang for x, _ in few) < 280 for lang in ("aa", "bb")) and few.count(("aa", 9_999)) <= 1
    tight = draw(200, 6_000, 3 * 40 * 8 * 3 * 3_000)
    assert sum(x == "bb" for x, _ in tight) < 90 and sum(x == "cc" for x, _ in tight) == 1
    assert {x for x, _ in draw(200, 20, 1 << 40)} <= {"aa", "bb"}       # two languages of ten rows each, the most frequent


def test_long_labelled_texts(spark):
    text = {"aa": "der die und ich nicht ", "bb": "the and of to in "}
    rows = [(i, lang, t * 5_000 + str(i)) for i, (lang, t) in enumerate(sorted(text.items()) * 40)]
    docs = spark.createDataFrame([(i, t, lang) for i, lang, t in rows], "doc_id long, text string, lang string").repartition(4)
    # Such a text may send up to 131 KB: about ten of each language fit.
    found = language_id.identify(docs, language_id.train(docs, most_bytes=20 * 8 * language_id.BUCKETS)).collect()
    assert all(r.lang_pred == ("aa", "bb")[r.doc_id % 2] for r in found)
