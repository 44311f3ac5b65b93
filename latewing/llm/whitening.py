"""Whitening of embeddings by Jacobi-Davidson.

The covariance is never formed. A product with it is one pass over the vectors: tasks centre them, multiply, and return one small
matrix each. The search space grows by approximate solutions of the projected correction equations, which inner MINRES steps find
for all open pairs at once, a pass a step. Rayleigh-Ritz in that space gives the next pairs; a pair whose residual is at rounding
level is locked, and the others go on orthogonally to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from latewing.llm.flat import with_key
from latewing.session import cut_lineage

SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 52           # integers beyond are set to it
COMPONENTS = 8
INNER_STEPS = 6             # MINRES steps of one correction
INNER_GAIN = 0.05           # or fewer, once a correction's residual fell this far
OUTER_LIMIT = 100
PARTIALS = 512              # results of a pass that reach the driver, or one a core if there are more cores
BLOCK = 4096                # vectors multiplied at once
EPS = float(np.finfo(np.float64).eps)


# --- vectors and their exact sums

def integers(vector: Column) -> Column:
    """floor(1024 c) + 100000 of every entry, as longs."""
    def entry(c: Column) -> Column:
        scaled = F.least(F.greatest(c.cast("double") * SCALE, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
        return (F.floor(scaled) + SHIFT).cast("bigint")
    return F.transform(vector, entry)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(odd, F.lit(False))


def fit_table(rows: DataFrame, vector: str, key: str) -> tuple[DataFrame, int]:
    """(k, x) of the usable rows, written once, and the number of dimensions: the commonest length, the largest of several."""
    kept = rows.where(usable(F.col(vector))).select(F.col(key).alias("k"), integers(F.col(vector)).alias("x"))
    table = cut_lineage(kept, "vectors")
    most = table.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 0
    return table.where(F.size("x") == d), d


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass(frozen=True)
class Fit:
    """The fit list: its table, its size n, exact sums a dimension, and the largest absolute entry."""

    table: DataFrame
    d: int
    n: int
    sums: tuple[int, ...]
    largest: int

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n x - S; machine integers where they are sure to hold it."""
        if self.n * self.largest + max(map(abs, self.sums), default=0) < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, each entry with one rounding of the exact difference."""
        return self.exact(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - S)^2, exact; None beyond a long."""
        y = self.exact(x)
        top = int(abs(y).max()) if y.size else 0
        if self.d * top * top >= 1 << 63:
            y = y.astype(object)
        return [int(s) if s < 1 << 63 else None for s in (y * y).sum(axis=1)]


def partials(table: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], list], kind: str) -> list:
    """What ``make`` returns for each task's batches, in the order of the tasks. As many tasks as PARTIALS or the cores."""
    spark = table.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = make(batches)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out])], ["part", "out"])

    few = table.select("x").coalesce(max(PARTIALS, spark.sparkContext.defaultParallelism))
    return [r.out for r in sorted(few.mapInArrow(run, f"part int, out {kind}").collect(), key=lambda r: r.part)]


def moments(table: DataFrame, d: int) -> Fit:
    """Size, sums and largest entry from one pass; the sums are added as Python integers."""
    def make(batches):
        n, total, largest = 0, np.zeros(d, object), 0
        for b in batches:
            x = _matrix(b.column(0), d)
            if len(x):
                high = x >> 26
                total += (high.sum(axis=0).astype(object) << 26) + (x - (high << 26)).sum(axis=0).astype(object)
                largest, n = max(largest, int(abs(x).max())), n + len(x)
        return [str(n), str(largest), *map(str, total)]

    parts = [list(map(int, p)) for p in partials(table, make, "array<string>")] if d else []
    return Fit(table, d, sum(p[0] for p in parts), tuple(sum(c) for c in zip(*(p[2:] for p in parts))), max((p[1] for p in parts), default=0))


class Sum:
    """Compensated sum of matrices."""

    def __init__(self, shape):
        self.total, self.lost = np.zeros(shape), np.zeros(shape)

    def add(self, m: np.ndarray) -> None:
        t = self.total + m
        self.lost += np.where(np.abs(self.total) >= np.abs(m), (self.total - t) + m, (m - t) + self.total)
        self.total = t

    def value(self) -> np.ndarray:
        return self.total + self.lost


def _blocks(fit: Fit, batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        for i in range(0, b.num_rows, BLOCK):
            yield fit.centred(_matrix(b.column(0).slice(i, BLOCK), fit.d))


def product(fit: Fit, w: np.ndarray) -> np.ndarray:
    """Covariance times ``w``: one pass over the vectors."""
    plain = Fit(None, fit.d, fit.n, fit.sums, fit.largest)      # tasks need no DataFrame

    def make(batches):
        s = Sum(w.shape)
        for y in _blocks(plain, batches):
            s.add(y.T @ (y @ w))
        return s.value().ravel().tolist()

    total = Sum(w.shape)
    for p in partials(fit.table, make, "array<double>"):
        total.add(np.array(p).reshape(w.shape))
    return total.value() / fit.n


def trace(fit: Fit) -> float:
    """The sum of all variances."""
    plain = Fit(None, fit.d, fit.n, fit.sums, fit.largest)

    def make(batches):
        s = Sum(1)
        for y in _blocks(plain, batches):
            s.add(np.array([np.vdot(y, y)]))
        return s.value().tolist()

    return sum(p[0] for p in partials(fit.table, make, "array<double>")) / fit.n


# --- eigenpairs of a symmetric positive operator that is only known by its products

def orthogonal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``t``'s columns add to the given orthonormal columns; nearly dependent columns are left out."""
    base = np.column_stack(against) if against else np.zeros((len(t), 0))
    for j in range(t.shape[1]):
        v = t[:, j]
        size = np.linalg.norm(v)
        if not size or not np.isfinite(size):
            continue
        v = v / size
        for _ in range(3):
            v = v - base @ (base.T @ v)
            size = np.linalg.norm(v)
            if size < 1e-10:
                break
            v = v / size
        else:
            base = np.column_stack([base, v])
    return base[:, sum(a.shape[1] for a in against):]


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int, gain: float) -> np.ndarray:
    """Approximate solutions of one symmetric system a column, all advanced by the same products."""
    beta = first = np.linalg.norm(b, axis=0)
    live = first > 0
    v, before = np.divide(b, beta, out=np.zeros_like(b), where=live), np.zeros_like(b)
    w, w_before, x = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    eta, beta = first.copy(), np.zeros_like(first)
    c, c_before, s, s_before = np.ones_like(first), np.ones_like(first), np.zeros_like(first), np.zeros_like(first)
    for _ in range(steps):
        if not live.any():
            break
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * before
        after = np.linalg.norm(p, axis=0)
        delta = c * alpha - c_before * s * beta
        r1, r2, r3 = np.hypot(delta, after), s * alpha + c_before * c * beta, s_before * beta
        live &= r1 > 0
        safe = np.where(live, r1, 1.0)
        c_before, s_before, c, s = c, s, delta / safe, after / safe
        w_before, w = w, (v - r3 * w_before - r2 * w) / safe
        x = x + np.where(live, c * eta, 0.0) * w
        eta = -s * eta
        live &= (np.abs(eta) > gain * first) & (after > 0)
        before, v, beta = v, np.divide(p, after, out=np.zeros_like(p), where=after > 0), after
    return x


def leading_pairs(
    apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, steps: int = INNER_STEPS, gain: float = INNER_GAIN,
    limit: int | None = None, seed: int = 5,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, their orthonormal vectors as columns, and the residuals' norms relative to the largest.

    A pair is locked at a residual of 4 eps sqrt(d) times the largest eigenvalue; where rounding of the products keeps it above
    that (no gain in four rounds), at 100 times as much. The search space is restarted from its best vectors at ``limit`` columns.
    """
    k = min(k, d)
    limit = limit or 4 * k + 16
    u = orthogonal(np.random.default_rng(seed).normal(size=(d, min(d, k + 4))))
    au = apply(u)
    q, theta_q = np.zeros((d, 0)), np.zeros(0)
    best, stale = np.inf, 0
    for _ in range(OUTER_LIMIT):
        h = u.T @ au
        theta, z = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-theta, kind="stable")
        theta, z = theta[order], z[:, order]
        u, au = u @ z, au @ z
        top = max([*theta_q, *theta, 0.0])
        want = min(k - q.shape[1], u.shape[1])
        r = au[:, :want] - u[:, :want] * theta[:want]
        r = r - q @ (q.T @ r)
        size, level = np.linalg.norm(r, axis=0), 4 * EPS * np.sqrt(d) * top
        first = size[0]
        stale, best = (stale + 1, best) if first >= best / 2 else (0, first)
        whole = q.shape[1] + u.shape[1] >= d                    # nothing is left to search
        loose = 100 * level if stale >= 4 else level
        n_locked = want if whole else next((i for i in range(want) if size[i] > (loose if i == 0 else level)), want)
        if n_locked:
            q, theta_q = np.column_stack([q, u[:, :n_locked]]), np.append(theta_q, theta[:n_locked])
            u, au, theta, r, size = u[:, n_locked:], au[:, n_locked:], theta[n_locked:], r[:, n_locked:], size[n_locked:]
            best, stale = np.inf, 0
            if q.shape[1] == k:
                break
        open_ = np.flatnonzero(size > level)
        if u.shape[1] + len(open_) > limit:
            u, au = u[:, :2 * k], au[:, :2 * k]
        t = np.zeros((d, 0))
        if len(open_):
            own, shift = u[:, open_], theta[open_]

            def project(m):
                m = m - q @ (q.T @ m)
                return m - own * (own * m).sum(axis=0)

            def corrected(m):
                m = project(m)
                return project(apply(m) - m * shift)

            t = minres(corrected, project(-r[:, open_]), steps, gain)
        t = orthogonal(t, q, u)
        if not t.shape[1]:
            t = orthogonal(np.random.default_rng(seed + q.shape[1] + u.shape[1]).normal(size=(d, max(1, k - q.shape[1]))), q, u)
        if t.shape[1]:
            u, au = np.column_stack([u, t]), np.column_stack([au, apply(t)])
    else:
        raise ArithmeticError(f"{k - q.shape[1]} of {k} eigenpairs not found in {OUTER_LIMIT} rounds")
    q = orthogonal(q)
    aq = apply(q)                                               # one last Rayleigh-Ritz among the locked ones
    h = q.T @ aq
    theta, z = np.linalg.eigh((h + h.T) / 2)
    theta, z = theta[::-1], z[:, ::-1]
    residual = np.linalg.norm(aq @ z - (q @ z) * theta, axis=0)
    return theta, q @ z, residual / theta[0] if theta[0] > 0 else residual


# --- whitening

@dataclass(frozen=True)
class Whitening:
    """A fit list, its leading eigenvalues and vectors (columns), and the trace of its covariance."""

    fit: Fit
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.fit.centred(x) @ (self.vectors / np.sqrt(self.values))

    def without_table(self) -> Whitening:
        f = self.fit
        return Whitening(Fit(None, f.d, f.n, f.sums, f.largest), self.values, self.vectors, self.residuals, self.trace)


def train(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> Whitening:
    """Fit on all usable rows. Components whose variance rounding can't tell from zero are left out."""
    table, d = fit_table(rows, vector, key)
    fit = moments(table, d)
    if not fit.n:
        return Whitening(fit, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0.0)
    total = trace(fit)
    if not total:
        return Whitening(fit, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0.0)
    values, vectors, residuals = leading_pairs(lambda w: product(fit, w), d, components)
    sure = values > 64 * EPS * d * values[0]
    return Whitening(fit, values[sure], vectors[:, sure], residuals[sure], total)


def identity_error(w: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from a pass that centres before it multiplies."""
    plain, k = w.without_table(), len(w.values)
    if not k:
        return 0.0

    def make(batches):
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                y = plain.project(_matrix(b.column(0), plain.fit.d))
                n, mean, spread = merged((n, mean, spread), (len(y), y.mean(axis=0), (y - y.mean(axis=0)).T @ (y - y.mean(axis=0))))
        return [float(n), *mean, *spread.ravel()]

    total = (0, np.zeros(k), np.zeros((k, k)))
    for p in partials(w.fit.table, make, "array<double>"):
        total = merged(total, (int(p[0]), np.array(p[1:k + 1]), np.array(p[k + 1:]).reshape(k, k)))
    return float(np.abs(total[2] / w.fit.n - np.eye(k)).max())


def merged(a, b):
    """Sizes, means and centred products of two parts taken together."""
    n = a[0] + b[0]
    if not n:
        return a
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def whiten(w: Whitening, key: str = "vec_id") -> DataFrame:
    """For each row of the fit list: key, deviation, and whitened, an array of one value a component."""
    plain, k = w.without_table(), len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), plain.fit.d)
            y = plain.project(x) if k else np.zeros((len(x), 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(y.ravel()))
            yield pa.record_batch([b.column(0), pa.array(plain.fit.deviation(x), pa.int64()), lists], ["k", "deviation", "whitened"])

    return w.fit.table.mapInArrow(run, with_key(w.fit.table, "deviation bigint, whitened array<double>")).withColumnRenamed("k", key)


def components(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", count: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: key, component (from 1 by falling variance), n, deviation, whitened, explained, identity_error, residual.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are vectors of another length than the
    commonest. Repeated rows and null keys count and stay; other columns are left out, whatever their names. Entries beyond 2^52
    after scaling count as 2^52; a deviation beyond a long is null. Directions without variance have no component: a table of
    equal vectors, or of one, gives no rows, nor does an empty table.
    """
    w = train(rows, vector, key, count)
    wrong, k = identity_error(w), len(w.values)
    named = F.array(*[F.struct(F.lit(float(e / w.trace)).alias("explained"), F.lit(float(r)).alias("residual")) for e, r in zip(w.values, w.residuals)]
                    ).cast("array<struct<explained:double,residual:double>>")
    out = whiten(w, key).select(F.col(key), "deviation", F.posexplode("whitened").alias("i", "whitened"))
    told = F.get(named, F.col("i"))
    return out.select(F.col(key), (F.col("i") + 1).alias("component"), F.lit(w.fit.n).cast("bigint").alias("n"), "deviation", "whitened",
                      told["explained"].alias("explained"), F.lit(wrong if k else None).cast("double").alias("identity_error"), told["residual"].alias("residual"))
