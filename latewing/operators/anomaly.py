"""Anomaly flags and scores over one row per flight."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from latewing.functions.buckets import key_text, md5_bucket
from latewing.functions.geo import haversine_km
from latewing.operators.aggregates import corr_matrix
from latewing.operators.joins import left_lookup
from latewing.operators.metrics import auc_roc
from latewing.operators.ordered import CHUNK_ROWS, windowed
from latewing.operators.quantiles import exact_quantiles, one_row
from latewing.operators.trajectory import SECOND, steps, timed
from latewing.schema import EXPECTED_EVENTS, LANDING, TAKE_OFF
from latewing.session import cut_lineage

FEATURES = ("events", "duration_s", "mean_gap_s", "max_gap_s", "distance_km", "max_alt", "mean_alt", "std_alt")


def flight_features(events: DataFrame, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per flight from a single ordered pass."""
    df = steps(events, ["us", "lat", "lon"], rows, chunk_rows=chunk_rows)
    gap = F.col("us") - F.col("prev_us")
    km = haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    kinds = reduce(lambda a, b: a + b, [F.max((F.col("event_type") == k).cast("int")) for k in EXPECTED_EVENTS])
    return df.groupBy("flight_id").agg(
        F.count(F.lit(1)).alias("events"), ((F.max("us") - F.min("us")) / F.lit(SECOND)).alias("duration_s"),
        F.coalesce(F.sum(gap) / F.lit(SECOND) / F.count(gap), F.lit(0.0)).alias("mean_gap_s"),
        F.coalesce(F.max(gap) / F.lit(SECOND), F.lit(0.0)).alias("max_gap_s"),
        F.coalesce(F.sum(km), F.lit(0.0)).alias("distance_km"), F.max("altitude").alias("max_alt"),
        F.avg("altitude").alias("mean_alt"), F.coalesce(F.stddev("altitude"), F.lit(0.0)).alias("std_alt"),
        F.count_if(F.col("event_type") == TAKE_OFF).alias("take_offs"),
        F.count_if(F.col("event_type") == LANDING).alias("landings"), kinds.alias("kinds"))


# --- feature preparation --------------------------------------------------------------------------------------------

def interaction(flights: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return flights.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


def standardise(flights: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace columns by z-scores; a constant column becomes 0."""
    stats = flights.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev(c).alias("s")).alias(c) for c in cols]).alias("s"))
    def z(c: str) -> Column:
        spread = F.nullif(F.col(f"_s.{c}.s"), F.lit(0.0))
        return F.coalesce(F.try_divide(F.col(c) - F.col(f"_s.{c}.m"), spread), F.when(F.col(c).isNotNull(), F.lit(0.0)))

    return flights.withColumn("_s", stats.scalar()).withColumns({c: z(c) for c in cols}).drop("_s")


def corr_prune(flights: DataFrame, cols: Sequence[str], limit: float = 0.9) -> list[str]:
    """Columns kept when, in the given order, each one too close to a kept one is dropped.

    Only the column by column matrix comes to the driver.
    """
    r = {(m.a, m.b): m.corr for m in corr_matrix(flights, cols).collect()}
    kept: list[str] = []
    for c in cols:
        if all(r[c, k] is None or abs(r[c, k]) <= limit for k in kept):
            kept.append(c)
    return kept


# --- rules ----------------------------------------------------------------------------------------------------------

def rule_flags(flights: DataFrame, p: float = 0.99, max_landings: int = 1, max_hold_s: float = 3600.0) -> DataFrame:
    """Rule-based flags per flight and how many of them hold. Limits for duration and altitude are exact percentiles."""
    cols = ["duration_s", "max_alt"]
    cut = one_row(exact_quantiles(flights, cols, {"q": p}), cols, "q").scalar()
    flags = {
        "long_duration": F.col("duration_s") > F.col("_q.duration_s"),
        "extreme_altitude": F.col("max_alt") > F.col("_q.max_alt"),
        "go_around": F.col("landings") > max_landings,
        "missing_events": F.col("kinds") < len(EXPECTED_EVENTS),
        "long_hold": F.col("max_gap_s") > max_hold_s,
    }
    return flights.withColumn("_q", cut).select("flight_id", *[c.alias(n) for n, c in flags.items()]).withColumn(
        "n_flags", reduce(lambda a, b: a + b, [F.col(n).cast("int") for n in flags]))


RULES = ("long_duration", "extreme_altitude", "go_around", "missing_events", "long_hold")


def taxonomy(flags: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """Names of the rules each flight breaks."""
    return flags.select("flight_id", F.array_compact(F.array(*[F.when(F.col(r), F.lit(r)) for r in rules])).alias("kinds"))


def taxonomy_counts(flags: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    return taxonomy(flags, rules).select(F.explode("kinds").alias("kind")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("flights"))


def inject_anomalies(events: DataFrame, percent: int = 5, drop_kind: str = LANDING, seed: int = 42) -> DataFrame:
    """Test anomalies: a share of flights takes twice as long, another share loses one kind of event.

    ``us`` is the changed time; ``injected`` names the change.
    """
    df = timed(events)
    bucket = md5_bucket(key_text("flight_id"), seed)
    chosen = df.where(bucket < percent).groupBy("flight_id").agg(F.min("us").alias("_first"))
    stretched = left_lookup(df, cut_lineage(chosen, "chosen"), ["flight_id"]).withColumns({
        "injected": F.when(F.col("_first").isNotNull(), "stretched").when(bucket < 2 * percent, "dropped"),
        "us": F.coalesce(2 * F.col("us") - F.col("_first"), F.col("us")),
    }).drop("_first")
    return stretched.where(~(F.col("injected").eqNullSafe("dropped") & (F.col("event_type") == drop_kind)))


# --- learned scores -------------------------------------------------------------------------------------------------

def with_incomplete(scored: DataFrame, flights: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add the flights that lack a feature, with null scores and flags: every flight has a row."""
    hole = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in cols])
    return scored.unionByName(flights.where(hole).select("flight_id"), allowMissingColumns=True)


def _scaler(cols: Sequence[str]):
    return [VectorAssembler(inputCols=list(cols), outputCol="raw", handleInvalid="skip"),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)]


def kmeans_outliers(flights: DataFrame, cols: Sequence[str] = FEATURES, k: int = 5, spread: float = 3.0,
                    min_share: float = 0.01, seed: int = 42, normal: DataFrame | None = None) -> DataFrame:
    """Cluster, distance to the own centre, and a flag for far flights and for members of tiny clusters.

    Clusters are those of ``normal``, flights known to be so, if given.
    """
    scaler = Pipeline(stages=_scaler(cols)).fit(flights if normal is None else normal)
    scaled = scaler.transform(flights if normal is None else normal).select("flight_id", "scaled").persist(
        StorageLevel.MEMORY_AND_DISK)  # read once per iteration
    try:
        model = KMeans(featuresCol="scaled", k=k, seed=seed).fit(scaled)
        placed = cut_lineage(_placed(model, scaled if normal is None else scaler.transform(flights).select("flight_id", "scaled")), "clusters")
    finally:
        scaled.unpersist()
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("cluster_size"))
    fleet = placed.agg(F.struct(F.avg("distance").alias("m"), F.stddev("distance").alias("s"), F.count("distance").alias("n"))).scalar()
    # One row per cluster, at most k rows.
    joined = placed.join(F.broadcast(sizes), "cluster").withColumn("_f", fleet)
    far = F.col("distance") > F.col("_f.m") + spread * F.col("_f.s")
    return with_incomplete(
        joined.withColumn("outlier", far | (F.col("cluster_size") < min_share * F.col("_f.n"))).drop("_f"), flights, cols)


def _placed(model, scaled: DataFrame) -> DataFrame:
    """Cluster and distance to its centre; the centres are k short literal arrays."""
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    own = F.element_at(centres, F.col("prediction") + 1)
    squares = F.zip_with(vector_to_array("scaled"), own, lambda a, b: (a - b) * (a - b))
    return model.transform(scaled).select(
        "flight_id", F.col("prediction").alias("cluster"),
        F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).alias("distance"))


def pca_reconstruction(flights: DataFrame, cols: Sequence[str] = FEATURES, k: int = 3, normal: DataFrame | None = None) -> DataFrame:
    """Squared distance of a flight to the plane of the first ``k`` components, those of ``normal`` flights if given."""
    model = Pipeline(stages=[*_scaler(cols), PCA(inputCol="scaled", outputCol="main", k=k)]).fit(flights if normal is None else normal)

    def norm(c: str) -> Column:
        return F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, x: s + x * x)

    return with_incomplete(model.transform(flights).select(
        "flight_id", F.greatest(norm("scaled") - norm("main"), F.lit(0.0)).alias("error")), flights, cols)


def grid_density(flights: DataFrame, cols: Sequence[str], width: float = 0.5) -> DataFrame:
    """Flights in the own and all adjacent cells of a grid over standardised features.

    Cells are counted first; only cells, never pairs of flights, meet their neighbours.
    """
    names = [f"_g{i}" for i in range(len(cols))]
    cells = standardise(flights.select("flight_id", *cols).na.drop(), cols).select(
        "flight_id", *[F.floor(F.col(c) / width).alias(n) for c, n in zip(cols, names)])
    near = cells.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    for n in names:
        near = near.withColumn(n, F.explode(F.array(F.col(n) - 1, F.col(n), F.col(n) + 1)))
    density = near.groupBy(*names).agg(F.sum("_n").alias("density"))
    return with_incomplete(left_lookup(cells, cut_lineage(density, "density"), names).select("flight_id", "density"), flights, cols)


# Isolation forest (Liu, Ting, Zhou 2008): random splits isolate outliers in few steps.

NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, depth double"


def _average_path(n):
    """Mean depth of an unsuccessful search among ``n`` points, the value used for an unsplit leaf."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + 0.5772156649) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """Node table of one random tree over a bounded sample."""
    rng, limit = np.random.default_rng([seed, tree]), int(np.ceil(np.log2(max(len(x), 2))))
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    free = 1
    while todo:
        node, idx, depth = todo.pop()
        low, high = x[idx].min(axis=0), x[idx].max(axis=0)
        split = np.flatnonzero(high > low)
        if depth >= limit or len(idx) < 2 or not len(split):
            nodes.append((tree, node, -1, 0.0, node, node, depth + float(_average_path(len(idx)))))
            continue
        f = int(rng.choice(split))
        cut = float(rng.uniform(low[f], high[f]))
        side = x[idx, f] < cut
        nodes.append((tree, node, f, cut, free, free + 1, 0.0))
        todo += [(free, idx[side], depth + 1), (free + 1, idx[~side], depth + 1)]
        free += 2
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "depth"])


def isolation_forest(flights: DataFrame, cols: Sequence[str] = FEATURES, trees: int = 100, sample: int = 256,
                     contamination: float = 0.02, seed: int = 42) -> DataFrame:
    """Anomaly score in (0, 1) per flight; the top share by score is flagged.

    Each tree sees about ``sample`` of all rows, chosen by a hash of its own. The forest has at most ``trees * 2 * sample`` nodes and travels
    as a broadcast; scoring runs on Arrow batches wherever the flights are.
    """
    cols = list(cols)
    data = flights.select("flight_id", *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    n = data.count()
    grain = 1 << 30
    tree_cut = int(grain * min(1.0, sample / max(n, 1)))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                      lambda t: F.pmod(F.xxhash64("flight_id", t, F.lit(seed)), F.lit(grain)) < tree_cut)
    drawn = data.withColumn("tree", F.explode(chosen))
    forest = drawn.groupBy("tree").applyInPandas(
        lambda pdf: _grow(int(pdf["tree"].iloc[0]), pdf.sort_values("flight_id")[cols].to_numpy(float), seed), NODE_SCHEMA
    ).toPandas()  # bounded: trees * 2 * sample nodes
    shape = (int(forest["tree"].max()) + 1, int(forest["node"].max()) + 1)

    def dense(col: str, fill):
        a = np.full(shape, fill, dtype=float if col in ("cut", "depth") else np.int64)
        a[forest["tree"], forest["node"]] = forest[col]
        return a

    grown = sorted(forest["tree"].unique())
    packed = flights.sparkSession.sparkContext.broadcast(
        [(dense("feature", -1)[t], dense("cut", 0.0)[t], dense("left", 0)[t], dense("right", 0)[t], dense("depth", 0.0)[t])
         for t in grown])
    levels, norm = int(np.ceil(np.log2(max(sample, 2)))) + 2, float(_average_path(min(sample, max(n, 2))))

    def score(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(float)
            rows, total = np.arange(len(x)), np.zeros(len(x))
            for feature, cut, left, right, depth in packed.value:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(levels):
                    f = feature[at]
                    at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] < cut[at], left[at], right[at]))
                total += depth[at]
            yield pd.DataFrame({"flight_id": pdf["flight_id"], "score": np.exp2(-total / len(packed.value) / norm)})

    kind = dict(flights.dtypes)["flight_id"]
    scored = cut_lineage(data.mapInPandas(score, f"flight_id {kind}, score double"), "isolation")
    limit = exact_quantiles(scored, ["score"], {"q": 1 - contamination}).select("q").scalar()
    flagged = scored.withColumn("_q", limit).withColumn("outlier", F.col("score") > F.col("_q")).drop("_q")
    return with_incomplete(flagged, flights, cols)


# --- combining and judging ------------------------------------------------------------------------------------------

def ensemble_vote(methods: dict[str, DataFrame], need: int = 2) -> DataFrame:
    """Flights flagged by at least ``need`` methods; each method brings ``(flight_id, flag)``."""
    votes = reduce(DataFrame.unionByName, [
        df.select("flight_id", F.col("flag").cast("int").alias("flag")) for df in methods.values()])
    return votes.groupBy("flight_id").agg(F.sum("flag").alias("votes")).withColumn("anomalous", F.col("votes") >= need)


def stability(periods: Sequence[DataFrame]) -> DataFrame:
    """How far two periods agree on the flagged flights: sizes, overlap, Jaccard index."""
    a, b = [p.where("flag").select("flight_id") for p in periods]
    sides = a.withColumns({"a": F.lit(1), "b": F.lit(0)}).unionByName(b.withColumns({"a": F.lit(0), "b": F.lit(1)}))
    both = sides.groupBy("flight_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = both.agg(F.count_if(F.col("a") == 1).alias("flagged_a"), F.count_if(F.col("b") == 1).alias("flagged_b"),
                 F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("in_both"), F.count(F.lit(1)).alias("in_any"))
    return n.withColumn("jaccard", F.try_divide("in_both", "in_any"))


def permutation_importance(
    predict, rows_df: DataFrame, cols: Sequence[str], key: Sequence[str], rows: int | None = None, seed: int = 42,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Loss of AUC when one column is shuffled; ``predict`` maps rows to ``(label, p)``.

    The shuffle gives each row the value of its predecessor in hash order: a permutation found by one ordered pass.
    """
    hashed = rows_df.withColumn("_h", F.xxhash64(*key, F.lit(seed)))
    donors = windowed(
        hashed, [], ["_h", *key], lambda w: {f"_d_{c}": F.coalesce(F.lag(c).over(w), F.col(c)) for c in cols},
        back=1, rows=rows, chunk_rows=chunk_rows)
    shuffled = cut_lineage(donors, "shuffled")
    base = F.lit(auc_roc(predict(rows_df), rows).first()[0]).cast("double")
    parts = []
    for c in cols:
        worse = predict(shuffled.withColumn(c, F.col(f"_d_{c}")).select(*rows_df.columns))
        parts.append(auc_roc(worse, rows).withColumns({"feature": F.lit(c), "base_auc": base}))
    return reduce(DataFrame.unionByName, parts).select(
        "feature", "base_auc", "auc_roc", (F.col("base_auc") - F.col("auc_roc")).alias("importance"))
