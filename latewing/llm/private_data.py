"""Personal data: fixed base patterns, and further spans chosen by boosted trees. Spark expressions only.

High-recall generators propose spans that may overlap: spaced, bracketed or spelled-out addresses, numbers without their usual
marks. Trees score them by format and context. They learn from the base spans of all documents, rewritten into
such looser forms (positive), and from prose set into an address's form and candidates that touch no base span (negative). A
candidate that has the form of a positive may be real, so it is neither. For each kind the threshold is the lowest of a stated
precision on rows held back. The trees are evaluated as nested conditions over an array, so no
row leaves its task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from latewing.llm.scans import let, scan
from latewing.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 24                # characters before a candidate
FULL_ROWS = 4_000           # training rows of a label and kind that count in full; more of them share this weight, so no kind drowns another
SCORE_STEP = 1 / 1024       # scores are told apart to this step, so that their counts are a short table whatever the number of rows
LEAST_ROWS = 100            # a kind with fewer positive rows in a sample asked for is looked for in all documents
PRECISION = 0.95            # on held-back rows, as if both labels were equally frequent

#: The base patterns, written so that matching takes linear time: repetitions give nothing back, and a match begins where a
#: run of its characters begins or the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
_AT, _DOT = r"(?: ?@ ?| ?\(at\) ?| ?\[at\] ?| at )", r"(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )"
_SPELLED_DOT = r"(?: ?\(dot\) ?| ?\[dot\] ?| dot )"
_NUMBER = r"(?<![0-9A-Za-z.])(?:\((?=[0-9]{1,6}\))|\+)?[0-9](?:[ ()./-]{0,3}[0-9]){6,18}(?![0-9A-Za-z])"
LOOSE = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+(?:{_SPELLED_DOT}[a-z0-9_%+-]{{1,64}}+){{0,3}}{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}}){{0,3}}{_DOT}[a-z]{{2,8}}(?![a-z])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?: ?\. ?|\[\.\]|\(\.\)| dot )[0-9]{1,3}){3}(?![0-9])",
    "card": _NUMBER,
    "phone": _NUMBER,
}
LOOSE_GUARD = {"email": r"(?i)@|[(\[ ]at[)\] ]", "ip": r"[0-9](?: \.|\. |\[\.\]|\(\.\)| dot )", "card": r"[0-9].?.?[0-9]", "phone": r"[0-9].?.?[0-9]"}
#: Forms of the rewritten base spans and their like: a candidate of such a form is no sure negative.
FORM = {
    "email": r"(?i)(?: at | ?\(at\) ?| ?\[at\] ?).*(?: dot | ?\(dot\) ?| ?\[dot\] ?)|\(at\)|\[at\]",
    "ip": r"^[0-9]+(?:(?:\[\.\]|\(\.\)| \. | dot )[0-9]+){3}$",
    "card": r"^[0-9]{4}(?:[./ -]+[0-9]{4})+(?:[./ -]+[0-9]{1,3})?$",
    "phone": r"^\+|^0|\(|^[0-9]{2,5}[ ./-]+[0-9]{3}",
}
# Ends of public host names that are common in addresses.
COMMON_ENDS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "io", "co", "ai", "app", "dev", "me", "tv", "eu", "de", "at", "ch", "fr", "be",
               "nl", "lu", "es", "pt", "it", "uk", "ie", "dk", "se", "no", "fi", "pl", "cz", "gr", "ru", "ua", "tr", "us", "ca", "mx", "br", "ar", "cl", "jp", "cn", "kr",
               "in", "au", "nz", "za")
# Words that come before nouns, not before the end of a host name.
ARTICLES = "the|a|an|this|that|my|our|your|his|her|its|all|any|der|die|das|den|dem|ein|eine|le|la|les|un|une|el|los|las|una"
THREE_WORDS = r"^.*?(\p{L}+)[^\p{L}]+(\p{L}+)[^\p{L}]+(\p{L}+)[^\p{L}]*$"
WORDS = r"(?i)(mail|contact|phone|tel|mobil|call|fax|card|visa|konto|pay|\bip\b|host|addr|server)"


def equals(i: int):
    return lambda x: x == i


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern counts."""
    n = F.length(digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


_ELEMENT = "array<struct<start:int,end:int,m:string,before:string,after:string>>"


def _is_valid(kind: str):
    return lambda x: valid(kind, x["m"])


def _of_kind(i: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("kind"), x["end"].alias("end"), x["m"].alias("m"),
                              x["before"].alias("before"), x["after"].alias("after"))


def _placed(matches: Column, gaps: Column) -> Column:
    """Matches with their places and context, given what lies between them; linear in their number."""
    sizes = F.transform(matches, lambda m, i: F.length(m) + F.length(gaps[i]))

    def element(at: Column):
        def one(m: Column, i: Column) -> Column:
            start = at[i] + F.length(gaps[i])
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"), F.right(gaps[i], F.lit(CONTEXT)).alias("before"),
                            F.left(gaps[i + 1], F.lit(1)).alias("after"))
        return one
    return let(scan(sizes, F.lit(0), lambda x, y: x + y), lambda at: F.transform(matches, element(at)))


def _placed_between(text: Column, pattern: str):
    none = F.array().cast(_ELEMENT)
    return lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda gaps: _placed(m, gaps)))


def _matches(df: DataFrame, text: str, patterns: dict[str, str], guards: dict[str, str], name: str) -> DataFrame:
    """Add for each kind an array of its matches with places in code points and context, found by splitting at them."""
    t, none, out = F.col(text), F.array().cast(_ELEMENT), {}
    for kind, p in patterns.items():
        # Texts without a trace of a kind are not searched.
        seen = t.contains(guards[kind]) if guards[kind] == "@" else t.rlike(guards[kind])
        found = let(F.regexp_extract_all(t, F.lit(p), F.lit(0)), _placed_between(t, p))
        out[f"{name}_{kind}"] = F.when(seen, found).otherwise(none)
    return df.withColumns(out)


def _base(df: DataFrame, text: str) -> DataFrame:
    """Add ``base``: array of (start, kind, end, m, before, after) by start, then kind as listed; end exclusive."""
    df = _matches(df, text, BASE, GUARD, "_b")
    kinds = [F.transform(F.filter(f"_b_{k}", _is_valid(k)), _of_kind(i)) for i, k in enumerate(KINDS)]
    return df.withColumn("base", F.array_sort(F.concat(*kinds))).drop(*[f"_b_{k}" for k in KINDS])


FAR = (1 << 31) - 1


def _untouched(candidates: Column, base: Column) -> Column:
    """The candidates that overlap no base span: all spans in order, looked at once from either side."""
    def both(c: Column) -> Column:
        spans = F.array_sort(F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("mine"), b["end"].alias("end"), F.lit(-1).alias("i"))),
            F.transform(c, lambda x, i: F.struct(x["start"].alias("start"), F.lit(1).alias("mine"), x["end"].alias("end"), i.alias("i")))))

        def sides(e: Column) -> Column:
            ends = F.transform(e, lambda x: F.when(x["mine"] == 0, x["end"]).otherwise(0))
            starts = F.reverse(F.transform(e, lambda x: F.when(x["mine"] == 0, x["start"]).otherwise(FAR)))
            return let(scan(ends, F.lit(0), F.greatest), lambda before: let(F.reverse(scan(starts, F.lit(FAR), F.least)), lambda after: F.transform(
                e, lambda x, i: F.struct(x["i"].alias("i"), ((x["mine"] == 1) & (before[i] <= x["start"]) & (after[i] >= x["end"])).alias("free")))))
        free = F.transform(F.filter(let(spans, sides), lambda x: x["free"]), lambda x: x["i"])
        return F.transform(F.array_sort(free), lambda i: c[i])
    return let(candidates, lambda c: F.when((F.size(c) == 0) | (F.size(base) == 0), c).otherwise(both(c)))


def _candidates(df: DataFrame, text: str) -> DataFrame:
    """Add ``candidates``, like ``base``: what the generators propose, has what its kind needs, and touches no base span."""
    numbers = {k: v for k, v in LOOSE.items() if k != "phone"}      # cards and phones share a generator
    df = _matches(df, text, numbers, {k: LOOSE_GUARD[k] for k in numbers}, "_c")
    kinds = []
    for i, k in enumerate(KINDS):
        source = F.filter(F.col("_c_card" if k == "phone" else f"_c_{k}"), _has_needed(k))
        kinds.append(F.transform(source, _of_kind(i)))
    free = _untouched(F.array_sort(F.concat(*kinds)), F.col("base"))
    return df.withColumn("candidates", free).drop(*[f"_c_{k}" for k in numbers])


def _has_needed(kind: str):
    """Whether a candidate has what its kind needs in any form: a card its check digit, four numbers up to 255, a phone's number of digits."""
    return lambda x: valid(kind, F.regexp_replace(x["m"], "[^0-9]+", ".") if kind == "ip" else x["m"])


def features(c: Column) -> Column:
    """Format and context of a candidate as an array of doubles."""
    m, before, after = c["m"], c["before"], c["after"]
    d, letters = digits(m), F.regexp_replace(m, r"[^\p{L}]", "")
    groups = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    sizes = F.transform(groups, lambda g: F.length(g))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    last = F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1))
    address = (c["kind"] == KINDS.index("email")).cast("int")
    marks = address * F.size(F.regexp_extract_all(m, F.lit(rf"(?i){_DOT}"), F.lit(0)))
    values = [
        c["kind"], F.length(m), F.length(d), F.length(letters), F.length(m) - F.length(d) - F.length(letters), F.size(groups),
        F.coalesce(F.array_max(sizes), F.lit(0)), F.coalesce(F.array_min(sizes), F.lit(0)), F.coalesce(F.try_element_at(sizes, F.lit(-1)), F.lit(0)),
        F.size(F.array_distinct(F.split(d, ""))), flag(F.call_function("luhn_check", d)), flag(m.rlike(r"^\(")), flag(m.rlike(r"^[+]|^00")),
        flag(m.rlike(r"(?i)@|\bat\b")), flag(m.rlike(r"(?i)\[|\(\.|\(at|\(dot")), flag(m.rlike(r"[0-9] [0-9]|[0-9]-[0-9]")),
        flag(before.rlike(r"[\p{L}0-9]$")), flag(before.rlike(r"[=#:/_.-]\s?$")), flag(after.rlike(r"[\p{L}0-9=_/-]")),
        flag(before.rlike(WORDS)), flag(last.isin(*COMMON_ENDS)), F.length(last), marks, flag(m.rlike(rf"(?i){_SPELLED_DOT}")),
        flag(m.rlike(r"^[(+]?0|^\([0-9]{2,5}\)")), flag(m.rlike(rf"(?i){_AT}(?:{ARTICLES})(?![a-z0-9-])")),
    ]
    return F.array(*[v.cast("double") for v in values])


def _loosened(kind: int, m: Column, before: Column) -> list[Column]:
    """A base span as it may look where its usual marks are missing; addresses also with words from the text before them as their names."""
    if KINDS[kind] == "email":
        host = F.regexp_extract(m, "@(.*)$", 1)
        words = [F.regexp_replace(before, THREE_WORDS, x) for x in ("$1.$2", "$3", "$2_$3")]
        names = [F.regexp_extract(m, "^(.*)@", 1), *[F.when(before.rlike(THREE_WORDS), w) for w in words]]
        # A host as short as most are, and the span's own, which may be long.
        hosts = [host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)]
        forms = [(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", ".")]
        out = []
        for i, name in enumerate(names):
            for j, (at, dot) in enumerate(forms):
                spelled = F.replace(F.concat(name, F.lit("@"), hosts[(i + j) % 2]), F.lit("."), F.lit(dot))
                made = F.replace(spelled, F.lit("@"), F.lit(at))
                out.append(F.upper(made) if (i + j) % 4 == 3 else made)
        return out
    if KINDS[kind] == "ip":
        return [F.replace(m, F.lit("."), F.lit(x)) for x in ("[.]", " . ", "(.)", " dot ")]
    if KINDS[kind] == "card":
        return [F.regexp_replace(digits(m), "([0-9]{4})(?=[0-9])", f"$1{x}") for x in (".", "/", " - ", "  ")]
    national = F.regexp_replace(m, r"^\+[0-9]{1,3}[ .-]?", "")
    return [national, F.concat(F.lit("00"), F.substring(m, F.lit(2), F.length(m))), F.concat(F.lit("0"), F.regexp_replace(national, "[()]", "")),
            F.regexp_replace(F.concat(F.lit("0"), F.regexp_replace(national, "^[(]|[)]", "")), "[ .-]+", "/")]


def _unclear(c: Column) -> Column:
    """Whether a candidate that touches no base span may be a real one all the same."""
    return reduce(lambda rest, i: F.when(c["kind"] == i, c["m"].rlike(FORM[KINDS[i]])).otherwise(rest), range(len(KINDS)), F.lit(False))


#: Scores one by one, or how often each occurs.
Scores = Iterable[float] | Mapping[float, int]


def lowest_threshold(positive: Scores, negative: Scores, precision: float = PRECISION, least: float = 0.0) -> float | None:
    """The lowest threshold from ``least`` on at which the positives' share among the selected reaches ``precision``, each label counted as a whole."""
    sides = [Counter(positive), Counter(negative)]
    whole = [max(1, c.total()) for c in sides]
    left, values, at = [c.total() for c in sides], sorted(sides[0].keys() | sides[1].keys()), 0
    for t in sorted({least, *(x for x in values if x > least)}):
        while at < len(values) and values[at] < t:
            left, at = [n - c[values[at]] for n, c in zip(left, sides)], at + 1
        hit, wrong = left[0] / whole[0], left[1] / whole[1]
        if hit and hit >= precision * (hit + wrong):
            return t
    return None


def calibration(positive: Scores, negative: Scores, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities: a logistic fit of the labels, each counted as a whole.

    Labels are drawn in by half a row, so that the slope stays finite where the scores part them. Newton's steps on the different scores.
    """
    positive, negative = Counter(positive), Counter(negative)
    if not positive or not negative:
        return 1.0, 0.0
    a, b, n, m = 1.0, 0.0, positive.total(), negative.total()
    rows = [(x, 1 - 0.5 / (n + 1), 0.5 * k / n) for x, k in positive.items()] + [(x, 0.5 / (m + 1), 0.5 * k / m) for x, k in negative.items()]
    for _ in range(rounds):
        ga = gb = haa = hab = hbb = 0.0
        for x, y, w in rows:
            p = probability(a * x + b)
            d, v = w * (p - y), w * max(p * (1 - p), 1e-9)
            ga, gb, haa, hab, hbb = ga + d * x, gb + d, haa + v * x * x, hab + v * x, hbb + v
        det = haa * hbb - hab * hab
        if det <= 1e-15:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return max(a, 1e-6), b


def probability(z: float) -> float:
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


@dataclass
class Model:
    """Boosted trees as nested (feature, threshold, left, right) or leaf values; for each kind the calibration of their sum and the least probability."""

    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)
    calibrations: dict[int, tuple[float, float]] = field(default_factory=dict)

    def score(self, x: Column) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            i, t, left, right = node
            return F.when(x[i] <= t, value(left)).otherwise(value(right))
        whole = reduce(lambda a, b: a + b, [value(t) for t in self.trees], F.lit(0.0))
        return F.rint(whole / SCORE_STEP) * SCORE_STEP

    def probability(self, kind: Column, score: Column) -> Column:
        """The calibrated probability of a candidate, or null if its kind is not looked for."""
        out = F.lit(None).cast("double")
        for k in self.thresholds:
            a, b = self.calibrations[k]
            out = F.when(kind == k, 1 / (1 + F.exp(-(score * a + b)))).otherwise(out)
        return out

    def selects(self, c: Column) -> Column:
        out = F.lit(False)
        for kind, t in self.thresholds.items():
            out = out | ((c["kind"] == kind) & (c["p"] >= t))
        return out


def _tree(node, weight: float):
    if node.getClass().getSimpleName() == "LeafNode":
        return weight * node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _tree(node.leftChild(), weight), _tree(node.rightChild(), weight)


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", fit_docs: int | None = None, fit_rows: int | None = None,
          rounds: int = 12, depth: int = 3) -> Model:
    """Fit on all documents and all their rows; a label and kind with more than FULL_ROWS rows has the weight of so many.

    Equal rows count once. A quarter is held back. On a kind's held-back rows (on all its rows if no positive is held back) scores are
    calibrated to probabilities, and its threshold is the lowest from a half on with PRECISION; a kind without positives, or that never
    reaches it, gets no spans of its own. Without rows of both labels nothing is added. The driver gets counts of scores, no rows.

    A caller may ask for less: about ``fit_docs`` documents, drawn by a hash of the key (kinds that they hardly have are looked for in
    all documents), and at most ``fit_rows`` rows of each label and kind.
    """
    grain = 1 << 20
    n = 0 if fit_docs is None else docs.count()
    keep = grain if fit_docs is None or n <= fit_docs else max(1, grain * fit_docs // n)
    every = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    drawn = F.pmod(F.xxhash64("k"), F.lit(grain)) < keep
    rows = _candidates(_base(every.where(drawn), "t"), "t").select("base", "candidates")
    positive = F.flatten(F.transform("base", lambda b: reduce(lambda rest, i: F.when(
        b["kind"] == i, F.array(*[F.struct(b["kind"].alias("kind"), m.alias("m"), b["before"].alias("before"), b["after"].alias(
            "after")) for m in _loosened(i, b["m"], b["before"])])).otherwise(rest), range(len(KINDS)),
        F.array().cast("array<struct<kind:int,m:string,before:string,after:string>>"))))
    negative = F.transform(F.filter("candidates", lambda c: ~_unclear(c)), lambda c: F.struct(
        c["kind"].alias("kind"), c["m"].alias("m"), c["before"].alias("before"), c["after"].alias("after")))
    # Prose in an address's form, unless it happens to end as an address would.
    prose = F.flatten(F.transform(F.filter("base", lambda b: b["before"].rlike(THREE_WORDS)), lambda b: F.transform(
        F.array(*[F.regexp_replace(b["before"], THREE_WORDS, x) for x in ("$1 at $2 dot $3", "$1 at $2.$3", "$2 (at) $1 dot $3")]),
        lambda m: F.struct(F.lit(0).alias("kind"), m.alias("m"), F.lit(" ").alias("before"), F.lit(" ").alias("after")))))
    prose = F.filter(prose, lambda c: ~F.lower(F.regexp_extract(c["m"], r"(\p{L}+)$", 1)).isin(*COMMON_ENDS))
    noun = F.flatten(F.transform(F.filter("base", lambda b: b["before"].rlike(THREE_WORDS)), lambda b: F.transform(
        F.array(*[F.regexp_replace(b["before"], THREE_WORDS, x) for x in ("$1 at the dot com", "$2 at a dot net", "$3 at this.com")]),
        lambda m: F.struct(F.lit(0).alias("kind"), m.alias("m"), F.lit(" ").alias("before"), F.lit(" ").alias("after")))))
    positive = F.filter(positive, lambda c: c["m"].isNotNull())
    def told(rows: DataFrame) -> DataFrame:
        return cut_lineage(rows.select(F.explode(F.concat(
            F.transform(positive, lambda c: F.struct(c.alias("c"), F.lit(1.0).alias("label"))),
            F.transform(F.concat(negative, prose, noun), lambda c: F.struct(c.alias("c"), F.lit(0.0).alias("label"))))).alias("r")).select(
            "r.c.kind", "r.label", features(F.col("r.c")).alias("x"), F.xxhash64("r.c").alias("h")), "candidates")

    labelled = told(rows)
    if keep < grain:
        number = {r.kind: r["count"] for r in labelled.where("label = 1").groupBy("kind").count().collect()}
        rare = [i for i in range(len(KINDS)) if number.get(i, 0) < LEAST_ROWS]
        if rare:
            seen = reduce(lambda a, b: a | b, [F.col("t").rlike(GUARD[KINDS[i]]) for i in rare])
            others = _base(every.where(~drawn & seen), "t").withColumn("base", F.filter("base", lambda b: b["kind"].isin(rare)))
            labelled = labelled.unionByName(told(others.withColumn("candidates", F.filter("base", lambda b: F.lit(False)))))
    if fit_rows is None:
        rows = labelled.dropDuplicates(["kind", "label", "h"])
    else:
        rows = reduce(DataFrame.unionByName, [labelled.where((F.col("kind") == k) & (F.col("label") == y)).dropDuplicates(["h"]).orderBy("h").limit(
            fit_rows) for k in range(len(KINDS)) for y in (0.0, 1.0)])
    cores = docs.sparkSession.sparkContext.defaultParallelism
    sample = cut_lineage(rows.withColumn("held", F.pmod("h", F.lit(4)) == 0).coalesce(max(2, cores)), "labelled")
    number = {(r.kind, r.label): r["count"] for r in sample.where("not held").groupBy("kind", "label").count().collect()}
    if len({y for _, y in number}) < 2:
        return Model()
    weight = reduce(lambda rest, g: F.when((F.col("kind") == g[0]) & (F.col("label") == g[1]), FULL_ROWS / max(FULL_ROWS, number[g])).otherwise(
        rest), number, F.lit(1.0))
    fit = sample.where("not held").select("label", weight.alias("weight"), array_to_vector("x").alias("features"))
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, checkpointInterval=-1, seed=11, weightCol="weight").fit(fit)
    model = Model([_tree(t._call_java("rootNode"), w) for t, w in zip(gbt.trees, gbt.treeWeights)])
    scores = sample.groupBy("kind", "label", "held", model.score(F.col("x")).alias("score")).count().collect()
    for kind in range(len(KINDS)):
        own = [r for r in scores if r.kind == kind]
        own = [r for r in own if r.held] if any(r.held and r.label for r in own) else own
        sides = [_counted((r.score, r["count"]) for r in own if bool(r.label) == y) for y in (True, False)]
        a, b = calibration(*sides)
        t = lowest_threshold(*[_counted((probability(a * x + b), k) for x, k in c.items()) for c in sides], least=0.5)
        if t is not None:
            model.thresholds[kind], model.calibrations[kind] = t, (a, b)
    return model


def _counted(pairs: Iterable[tuple[float, int]]) -> Counter:
    out = Counter()
    for x, n in pairs:
        out[x] += n
    return out


def _best_of_touching(spans: Column) -> Column:
    """Of every run of overlapping candidates the likeliest one, ties by start, kind and end, as (start, kind, end) in order."""
    def runs(s: Column) -> Column:
        fresh = let(scan(F.transform(s, lambda x: x["end"]), F.lit(0), F.greatest), lambda before: F.transform(s, lambda x, i: (x["start"] >= before[i]).cast("int")))
        numbered = let(fresh, lambda f: let(scan(f, F.lit(0), lambda x, y: x + y), lambda upto: F.transform(s, lambda x, i: F.struct(
            (upto[i] + f[i]).alias("run"), (-x["p"]).alias("p"), x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))))
        return let(F.array_sort(numbered), lambda r: F.filter(r, lambda x, i: (i == 0) | (x["run"] != r[F.greatest(i - 1, F.lit(0))]["run"])))
    best = let(F.array_sort(spans), lambda s: F.when(F.size(s) == 0, F.array().cast("array<struct<run:int,p:double,start:int,kind:int,end:int>>")).otherwise(runs(s)))
    return F.array_sort(F.transform(best, _plain))


def _plain(c: Column) -> Column:
    return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))


def find_private(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, base and added, arrays of (start, kind, end).

    Places are code points, ends exclusive, kinds numbers of KINDS; both arrays are sorted. Added spans touch no base span and no other
    added one: where candidates overlap, the likeliest is taken. Null texts are empty. Repeated rows and null keys stay; other columns
    are left out, but a key may be a struct that holds them. Work grows with a text and its matches in proportion, sorting aside.
    """
    rows = _base(docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")), "t")
    added = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if model.thresholds:
        rows = _candidates(rows, "t")

        def scored(c: Column) -> Column:
            p = let(features(c), lambda x: model.probability(c["kind"], model.score(x)))
            return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), p.alias("p"))
        chosen = F.filter(F.transform("candidates", scored), lambda c: F.coalesce(model.selects(c), F.lit(False)))
        added = F.when(F.size("candidates") == 0, added).otherwise(_best_of_touching(chosen))
    return rows.select(F.col("k").alias(key), F.transform("base", _plain).alias("base"), added.alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


PIECE = 1024                # code points of a text that are cut at once


def redact(text: Column, spans: Column) -> Column:
    """The text with every run of overlapping spans replaced by the name of its first kind in brackets.

    The text is cut into pieces first: a slice looks at the pieces it touches, not at all that lies before it.
    """
    names = F.array(*map(F.lit, KINDS))

    def cut(pieces: Column):
        def slice_(a: Column, b: Column) -> Column:
            def within(i: Column, j: Column) -> Column:
                head = F.substring(pieces[i], a - i * PIECE + 1, F.when(i == j, b - a).otherwise(PIECE))
                tail = F.when(i == j, F.lit("")).otherwise(F.left(pieces[j], b - j * PIECE))
                middle = F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
                return F.concat(head, F.when(j > i + 1, middle).otherwise(""), tail)
            number = lambda x: F.call_function("div", x, F.lit(PIECE)).cast("int")
            return F.when(a >= b, F.lit("")).otherwise(let(number(a), lambda i: let(number(b - 1), lambda j: within(i, j))))
        return slice_

    def replaced(s: Column, pieces: Column) -> Column:
        slice_ = cut(pieces)
        whole = let(scan(F.transform(s, lambda x: x["end"]), F.lit(0), F.greatest), lambda before: F.transform(s, lambda x, i: F.when(
            x["start"] >= before[i], F.concat(slice_(before[i], x["start"]), F.lit("["), F.upper(names[x["kind"]]), F.lit("]"))).otherwise("")))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(F.array_join(whole, ""), slice_(last, F.length(text)))
    parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(spans, lambda s: let(parts, lambda p: replaced(s, p))))
