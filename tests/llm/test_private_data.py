import hashlib
import itertools
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from latewing.llm import private_data
from latewing.llm.queries import QUERIES
from latewing.llm.scans import scan
from tests.llm.tables import documents, empty, rows

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    return private_data.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_base_spans(spark):
    rnd = random.Random(5)
    bits = ["a", "é", "@", ".", "@b.c", "1", "23", "+1 ", "-", " ", "(555) 555-1234", "4845168114407329", "10.0.0.1", "256.1.1.1", "007.0.0.255",
            "%", "x@y.zz", "\U0001f600"]
    data = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(25)))) for i in range(1500)] + [(10_000 + i, t) for i, (_, t) in enumerate(rows())]
    data += [(20_000 + i, t) for i, t in enumerate(["1 " * 20_000, "a" * 50_000, "a@" * 20_000, "1." * 20_000, "+1(" * 9_000, "a@b.c " * 1500])]
    got = {r.doc_id: [tuple(x) for x in r.base] for r in private_data.find_private(documents(spark, data), private_data.Model()).collect()}
    assert got == {d: base(t) for d, t in data}


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op2_private_data"].run(spark, sf).collect():
        spans = base(texts[r.doc_id])
        told = ",".join(f"{private_data.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(told.split(",")) <= set(r.spans.split(",")) and r.n_added <= 1


def loose_cases():
    """Text, start, kind and end of loose forms that no base pattern finds."""
    rnd, out = random.Random(8), []
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    for i in range(160):
        card = "4" + digits(14)
        card += next(c for c in "0123456789" if luhn(card + c))
        name = "".join(rnd.choice("abcdefghij") for _ in range(6))
        m = [f"{name}.{10 + i % 80} at mail{i % 9} dot example dot com", ".".join(str(rnd.randrange(1, 256)) for _ in range(4)).replace(".", "[.]"),
             ".".join(card[j:j + 4] for j in range(0, 16, 4)), f"({rnd.randrange(200, 999)}) 555-{digits(4)}"][i % 4]
        before = ["the note says; ", "see: ", "written on the wall, "][i % 3]
        out.append((before + m + " and no more", len(before), i % 4, len(before) + len(m)))
    return out


def test_query_with_planted_loose_cases(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cases = {1_000_000 + i: c for i, c in enumerate(loose_cases())}
    planted = spark.createDataFrame([(d, c[0]) for d, c in cases.items()], "doc_id bigint, text string")
    docs.unionByName(planted, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    hit, n = [0] * 4, [0] * 4
    for r in QUERIES["op2_private_data"].run(spark, str(tmp_path)).collect():
        if r.doc_id in cases:
            _, start, kind, end = cases[r.doc_id]
            n[kind] += 1
            hit[kind] += any(int(b) == end and k == private_data.KINDS[kind] for k, _, b in (x.split(":") for x in r.spans.split(",") if x))
        else:
            assert r.n_added <= 1
    assert n == [40] * 4 and min(hit) >= 38, hit


def other_cases():
    """Loose forms that training does not make, without digits too, as (text, start, kind, end), and harmless texts."""
    rnd, out = random.Random(11), []
    names = ["joe.miller", "anna", "kate_b", "h.o.lee", "Pat", "maria-luisa", "sales", "info", "j", "tom.o.hara"]
    hosts = [("example", "com"), ("mail", "org"), ("post", "net"), ("uni", "edu"), ("host", "de"), ("firma", "fr"), ("correo", "es"), ("shop", "io")]
    befores = ["the note says; ", "see: ", "written on the wall, ", "Kontakt: ", "por favor escriba: ", "(", "and then - "]
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    for i in range(240):
        a, (h, t) = names[i % len(names)], hosts[i % len(hosts)]
        card = "5" + digits(14)
        card += next(c for c in "0123456789" if luhn(card + c))
        octets = [str(rnd.randrange(1, 256)) for _ in range(4)]
        m = [
            [f"{a} at {h} dot {t}", f"{a.upper()}(AT){h}(DOT){t}", f"{a} [at] {h} [dot] co [dot] uk", f"{a} (at) {h} (dot) {t}", f"{a}(at){h}.{t}", f"{a} at sub dot {h} dot {t}"][i // 4 % 6],
            " . ".join(octets) if i % 8 < 4 else " dot ".join(octets),
            (" / ", ". ", " . ", "-- ")[i // 4 % 4].join(card[j:j + 4] for j in range(0, 16, 4)),
            [f"0049 30 {digits(7)}", f"(0{digits(2)}) {digits(3)} {digits(4)}", f"00 1 {rnd.randrange(200, 999)} 555 {digits(4)}", f"0{rnd.randrange(20, 99)}/{digits(3)} {digits(4)}"][i // 4 % 4],
        ][i % 4]
        before = befores[i % len(befores)]
        out.append((before + m + ", no more", len(before), i % 4, len(before) + len(m)))
    plain = ["meet me at noon dot dot dot", "we met at home.Then we left", "look at this dot matrix dot printer", "version 1 . 2 and chapter 3 . 4", "on 2024-05-17 at 12:30:45",
             "rows 100 200 300 of 400", "order 47369625730995 was late", "at the end dot", "he is at work dot tomorrow", "prices 12.50 13.75 and 14.00", "see sections 1.2 and 3.4"]
    return out, plain * 6


def test_query_with_forms_of_their_own(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cases, plain = other_cases()
    texts = {1_000_000 + i: c[0] for i, c in enumerate(cases)} | {2_000_000 + i: t for i, t in enumerate(plain)}
    planted = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    docs.unionByName(planted, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    right, missed, wrong = [0] * 4, [], []
    for r in QUERIES["op2_private_data"].run(spark, str(tmp_path)).collect():
        if r.doc_id not in texts:
            continue
        found = {tuple(x.split(":")) for x in r.spans.split(",") if x}
        want = set()
        if r.doc_id < 2_000_000:
            _, start, kind, end = cases[r.doc_id - 1_000_000]
            want = {(private_data.KINDS[kind], str(start), str(end))}
            right[kind] += want <= found
            missed += [texts[r.doc_id]] if not want <= found else []
        wrong += [(texts[r.doc_id], x) for x in found - want]
    print(right, missed[:20], wrong[:20])
    assert min(right) >= 0.9 * 60, (right, missed)
    assert sum(right) >= 0.95 * (sum(right) + len(wrong)), wrong


def test_work_is_linear_in_the_matches(spark):
    """A megabyte of addresses takes little more than twice the time of a megabyte of plain text; all are found and redacted."""
    took = {}
    for name, bit in (("words", "a bc def "), ("ip", "1.1.1.1. "), ("email", "y.z@a.b c"), ("phone", "+1 555 123 4567 x ")):
        text = bit * (1_000_000 // len(bit))
        docs = documents(spark, [(1, text)]).select("doc_id", "text")
        found = private_data.find_private(docs.select(F.struct("doc_id", "text").alias("k"), "text"), private_data.Model(), key="k")
        begin = time.monotonic()
        got = found.select(F.size("base").alias("n"), F.length(private_data.redact(F.col("k.text"), F.col("base"))).alias("l")).first()
        took[name] = time.monotonic() - begin
        n = 0 if name == "words" else len(text) // len(bit)
        assert got.n == n and (n or got.l == len(text))
    assert max(took.values()) < 20, took


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000, 70_000])
def test_scan_of_any_length(spark, n):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: ((i * 7919) % 1000).cast("int")).alias("v")).select(F.slice("v", 1, n).alias("v"))
    sums, tops = df.select(scan(F.col("v"), F.lit(0), lambda a, b: a + b), scan(F.col("v"), F.lit(0), F.greatest)).first()
    v = [(i * 7919) % 1000 for i in range(n)]
    assert sums == [0, *itertools.accumulate(v)][:n] and tops == [0, *itertools.accumulate(v, max)][:n]


def test_calibration():
    a, b = private_data.calibration([1.0, 1.2, 0.9] * 30, [-1.0, -0.8] * 30 + [1.1])
    assert a > 0 and private_data.probability(a + b) > 0.9 > 0.2 > private_data.probability(-a + b)
    assert private_data.calibration([], [1.0]) == (1.0, 0.0)


def test_overlapping_candidates_give_one_span(spark):
    data = [(1, [(0, 2, 5, 0.6), (0, 3, 5, 0.9), (4, 3, 9, 0.7), (9, 0, 12, 0.8), (20, 1, 25, 0.9)]), (2, [])]
    kind = "d int, s array<struct<start:int,kind:int,end:int,p:double>>"
    got = {r.d: [tuple(x) for x in r.b] for r in spark.createDataFrame(data, kind).select("d", private_data._best_of_touching(F.col("s")).alias("b")).collect()}
    assert got == {1: [(0, 3, 5), (9, 0, 12), (20, 1, 25)], 2: []}


def test_threshold_keeps_a_stated_precision():
    assert private_data.lowest_threshold([1.0, 1.2] * 50, [-1.0] * 99 + [1.2]) == 0.0
    assert private_data.lowest_threshold([1.0] * 90 + [0.1] * 10, [-1.0] * 80 + [0.1] * 20) == 1.0
    assert private_data.lowest_threshold([1.0], [1.0]) is None and private_data.lowest_threshold([], [-1.0]) is None


def test_copies_are_one_training_row(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(private_data, "cut_lineage", lambda df, label, real=private_data.cut_lineage: made.setdefault(label, real(df, label)))
    data = [(i, "please write now to joe.17@mail3.example.com") for i in range(300)]
    data += [(300 + i, f"please write now to ann.{i}@mail{i}.example.com") for i in range(20)]
    private_data.train(documents(spark, data), fit_rows=30)
    positive = made["labelled"].where("kind = 0 and label = 1")
    assert positive.count() == positive.select("h").distinct().count() == 30


def test_all_rows_are_learned_from(spark, monkeypatch):
    """No document and no row is left out, whatever their number; the driver gets counts of scores."""
    made = {}
    monkeypatch.setattr(private_data, "cut_lineage", lambda df, label, real=private_data.cut_lineage: made.setdefault(label, real(df, label)))
    data = [(i, f"please write now to ann.{i}@mail{i}.example.com") for i in range(21_000)]
    model = private_data.train(documents(spark, data), rounds=1, depth=1)
    positive = made["labelled"].where("kind = 0 and label = 1")
    assert positive.count() > 10 * 21_000 and 0 in model.thresholds


def test_counted_scores_are_scores():
    hits, wrong = [1.0, 1.25, 0.5] * 30, [-1.0, -0.5] * 30 + [1.25]
    assert private_data.calibration(Counter(hits), Counter(wrong)) == private_data.calibration(hits, wrong)
    for p in (0.5, 0.95, 0.99):
        assert private_data.lowest_threshold(Counter(hits), Counter(wrong), p) == private_data.lowest_threshold(hits, wrong, p)
    assert private_data.lowest_threshold(Counter({1.0: 90, 0.1: 10}), Counter({-1.0: 80, 0.1: 20})) == 1.0


@pytest.mark.parametrize("loose", ["JOE AT HOST DOT COM", "joe(AT)host(DOT)com", "Joe[At]host.com", "joe at host dot com"])
def test_upper_case_forms_are_proposed(spark, loose):
    docs = documents(spark, [(1, f"({loose})")]).select("doc_id", "text")
    found = private_data._candidates(private_data._base(docs, "text"), "text").first().candidates
    assert [(c.kind, c.m) for c in found] == [(0, loose)]


def test_kinds_that_the_sample_lacks(spark):
    text = "please write now to joe.17@mail3.example.com or 10.20.30.40 or 4845168114407329 or ring up +1 (017) 555-7713 today"
    data = [(i, "nothing to see here at all") for i in range(400)] + [(400 + i, text.replace("17", str(20 + i))) for i in range(20)]
    data = [(d, t.replace(t[t.find("48451"):][:16], "4845168114407329") if d >= 400 else t) for d, t in data]
    assert private_data.train(documents(spark, data), fit_docs=1).thresholds.keys() == {0, 1, 2, 3}


def test_added_spans_and_redaction(spark, model):
    data = [(1, "ring me: (017) 555-7713 or mail joe dot 17 at mail3 dot example dot com, 97[.]51[.]17[.]173, card 4845.1681.1440.7329 end"),
            (2, "version 10 200 300 or room 12, look at the dot com era, 3.1.4 and 47369625730995"),
            (3, "a@b.com+1 (017) 555-7713"), (4, None), (None, "plain")]
    docs = documents(spark, data).select(F.struct("doc_id", "text", "k").alias("doc"), "text")
    got = private_data.find_private(docs, model, key="doc").withColumn(
        "redacted", private_data.redact(F.col("doc.text"), F.array_sort(F.concat("base", "added")))).select("*", "doc.doc_id", "doc.k").collect()
    by = {r.doc_id: r for r in got}
    assert by[1].redacted == "ring me: [PHONE] or mail [EMAIL], [IP], card [CARD] end" and not by[1].base
    assert by[2].redacted == data[1][1] and by[4].redacted is None and by[None].redacted == "plain" and by[1].k == "clash"
    assert "017" not in by[3].redacted and "@" not in by[3].redacted


def test_no_rows_to_learn_from(spark):
    assert private_data.train(empty(spark)).trees == []
    assert private_data.find_private(empty(spark), private_data.Model()).count() == 0
    assert private_data.train(documents(spark)).thresholds.keys() <= set(range(4))


def test_plan_has_no_python(spark, model):
    plan = private_data.find_private(documents(spark), model)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
