"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

Subwords are runs of two to four bytes of the lower-cased text, in which everything but letters and bytes beyond ASCII is a space.
Embeddings and softmax are trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows. At
prediction time their product is one small table, so a text costs one lookup per subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from latewing.llm.flat import by_bytes, flat, with_key

BUCKETS = 1 << 14
SIZES = (2, 3, 4)
DIMENSIONS = 12
PER_LANGUAGE = 600          # labelled rows to learn from, for each language, on average
MOST_ROWS = 6_000           # of all languages
LEAST_ROWS = 10             # that a language's part of MOST_ROWS must have
MOST_BYTES = 256 << 20      # of bucket shares that come to the driver
BATCH_BYTES = 4 << 20

FOLD = np.full(256, 32, np.uint8)
FOLD[0x61:0x7B] = FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)
#: Odd multipliers of the subword hashes, by size.
FACTORS = {2: 0x9E3779B1, 3: 0x85EBCA6B, 4: 0xC2B2AE35}


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the buckets of all subwords and the offsets of each row's first; rows are padded with one space."""
    n = len(offsets) - 1
    padded = np.full(len(data) + n + 4, 32, np.uint32)
    padded[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = FOLD[data]
    begin = offsets + np.arange(n + 1)
    word = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24)
    for size in SIZES:
        x = word if size == 4 else word & np.uint32((1 << 8 * size) - 1)
        bucket = (x * np.uint32(FACTORS[size])) >> np.uint32(32 - 14)
        # A row has a subword at each of its places; the last ones reach over its end into the next row's, and are left out.
        yield bucket[:begin[-1]].astype(np.int32), begin


def counts_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text and their shares."""
    total = np.zeros(BUCKETS, np.int64)
    for bucket, _ in subwords(data, np.array([0, len(data)])):
        total += np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / total.sum()).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray           # BUCKETS x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0   # calibrated probability

    def probabilities(self, column: pa.Array) -> np.ndarray:
        data, offsets = flat(column)
        n = len(offsets) - 1
        score, total = np.zeros((n, len(self.languages))), np.zeros(n)
        for bucket, begin in subwords(data, offsets):
            sums = np.zeros((n, len(self.languages)))
            for k in range(len(self.languages)):
                run = np.add.reduceat(self.table[:, k][bucket], begin[:-1]) if n else sums[:, k]
                sums[:, k] = run
            score += sums
            total += np.diff(begin)
        return softmax((score / np.maximum(total, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True)) if z.size else z
    return e / e.sum(axis=-1, keepdims=True) if z.size else z


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 4.0, seed: int = 7) -> Model:
    """Train on (language, buckets, shares); every fifth row calibrates temperature and rejection instead.

    Texts are rejected where calibration rows of such low confidence were more often wrong than right, by four rows at least.
    """
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weight += rng.normal(0, 0.1, weight.shape).astype(np.float32)
    held = rows[::5] if len(rows) >= 50 else []
    learn = [r for i, r in enumerate(rows) if i % 5 or not held]
    target = {x: i for i, x in enumerate(languages)}
    steps, step = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            language, bucket, share = learn[i]
            own = embed[bucket]
            mean = share @ own
            error = softmax(mean @ weight + bias)
            error[target[language]] -= 1
            lr = np.float32(rate * (1 - step / steps))
            back = weight @ error
            weight -= lr * 0.1 * np.outer(mean, error).astype(np.float32)
            bias -= lr * np.float32(0.01) * error.astype(np.float32)
            embed[bucket] = own - lr * 10 * np.outer(share, back).astype(np.float32)
            step += 1
    model = Model(languages, (embed @ weight).astype(np.float32), bias.astype(np.float64))
    if held:
        z = np.array([share @ model.table[bucket] + model.bias for _, bucket, share in held])
        truth = np.array([target[x] for x, _, _ in held])
        grid = np.geomspace(0.1, 10, 41)
        loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        wrong, top = p.argmax(1) != truth, p.max(1)
        by = np.argsort(top, kind="stable")
        bad = np.flatnonzero(np.cumsum(wrong[by]) * 2 >= np.arange(1, len(by) + 1) + 4)
        if len(bad):
            model.reject_below = float(np.nextafter(top[by][bad[-1]], 1))
    return model


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(rows: DataFrame, per_language: int, most_rows: int, most_bytes: int) -> DataFrame:
    """The rows of (k, l, t) whose hash lies below their language's share, one of equal rows.

    Shares follow from one count of all rows: they ask for at most ``per_language`` rows a language and for an equal part of
    ``most_rows`` and ``most_bytes``, so the sample has that size on average, and no language's rows meet in one task.
    """
    cost = F.least(F.octet_length("t") * 3 + 3, F.lit(BUCKETS)) * 8
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.sum(cost).alias("cost")).orderBy(
        F.desc("n"), "l").limit(max(1, most_rows // LEAST_ROWS)).collect()
    part = max(1, len(sizes))
    limit = min(per_language, most_rows / part)
    shares = [(r.l, min(limit / r.n, most_bytes / part / r.cost)) for r in sizes]
    shares = rows.sparkSession.createDataFrame([(x, 2.0 if y >= 1 else y) for x, y in shares], "l string, share double")
    place = F.xxhash64("k", "t") / F.lit(2.0 ** 64) + 0.5
    # The broadcast has a row for each of at most most_rows / LEAST_ROWS languages.
    return rows.join(F.broadcast(shares), "l").where(place < F.col("share")).select("k", "l", "t").dropDuplicates()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Model:
    """Learn from a sample of about ``per_language`` rows of each language, ``most_rows`` rows and ``most_bytes`` bytes in all.

    The sample is drawn by a threshold on a hash of id and text; equal rows count once. A row comes to the driver as at most BUCKETS bucket
    shares, however long its text; ``most_bytes`` bounds their sum, so long texts make the sample smaller. Beyond
    ``most_rows / LEAST_ROWS`` languages the rarest are not learned. Rows with null id, text or language, and held-out rows, are not used.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).alias("t")).where(
        F.col("k").isNotNull() & F.col("l").isNotNull() & F.col("t").isNotNull() & ~held_out(F.col("k")))
    sample = _sample(rows, per_language, most_rows, most_bytes).withColumn("h", F.xxhash64("k", "t"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "t", BATCH_BYTES):
            data, offsets = flat(b.column("t"))
            found = [counts_of(data[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch([b.column("h"), b.column("l"), pa.array([x[0].tobytes() for x in found], pa.binary()), pa.array(
                [x[1].tobytes() for x in found], pa.binary())], ["h", "l", "b", "s"])

    got = sample.select("h", "l", "t").mapInArrow(features, "h bigint, l string, b binary, s binary").collect()
    got.sort(key=lambda r: (r.h, r.l, r.b, r.s))
    return fit([(r.l, np.frombuffer(r.b, np.int32), np.frombuffer(r.s, np.float32)) for r in got if len(r.b)])


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, lang_pred, score, rejected.

    ``lang_pred`` is ``und`` with score 0 for a null text, one without letters, or a model without languages; those are
    rejected, and so are texts whose score lies below the calibrated threshold. Other columns are left out.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn(
        "letters", F.col("t").rlike(r"\p{L}"))
    names = np.array([*model.languages, "und"], object)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "t", BATCH_BYTES):
            letters = b.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            if model.languages:
                p = model.probabilities(b.column("t"))
                best, score = p.argmax(1), p.max(1)
            else:
                best, score, letters = np.zeros(len(b), np.int64), np.zeros(len(b)), np.zeros(len(b), bool)
            best = np.where(letters, best, len(model.languages))
            score = np.where(letters, np.clip(score, 0, 1), 0.0)
            yield pa.record_batch([b.column("k"), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(
                ~letters | (score < model.reject_below))], ["k", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(work, with_key(rows, "lang_pred string, score double, rejected boolean")).withColumnRenamed("k", key)
