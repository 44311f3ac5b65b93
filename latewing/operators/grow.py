"""Random forests of two classes for tables that the library's passes are too slow for: the same method, grown in two steps.

Rows are kept as blocks of bin numbers. Nodes with many rows are split by counts that tasks add up in histograms, a level of all trees a pass.
A node with at most ``GROUP_ROWS`` rows sends them, once, to one task, which grows all that lies below it. So the exchanges carry each tree's rows
once and few histograms, instead of the histograms of every small node from every task. Bootstrap weights, the random features of a node, Gini gain,
the least rows of a child, depth and the merging of leaves that say the same are those of the library's classifier.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession, functions as F

from latewing.session import cut_lineage, run_folder, settings

GROUP_ROWS = 1 << 18        # of a node whose rows go to one task
BLOCK_ROWS = 1 << 16
SUMMARY = 1 << 13           # values that stand for a column's distribution; a cut is off by at most a few such shares of the rows
OPEN_NODES = 4096           # split in one pass
PART_BYTES = 32 << 20       # of rows on their way to the tasks that grow the lower nodes
FIRST_CLASS = float(1 << 26)    # a cell holds the number of rows and, times this, that of the second class; exact below 2^26 rows

MODEL = "org.apache.spark.ml.classification.RandomForestClassificationModel"
TREE = "org.apache.spark.ml.classification.DecisionTreeClassificationModel"
OF_FORESTS = ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")


@dataclass(frozen=True)
class Rules:
    """What a forest is grown by."""

    trees: int
    depth: int
    least: float            # rows of a child
    gain: float
    rate: float
    picked: int             # features looked at in a node
    bins: int
    seed: int


def rules(forest: RandomForestClassifier, width: int) -> Rules | None:
    """The classifier's parameters; none where it asks for something that only the library does."""
    picked = {"sqrt": math.ceil(math.sqrt(width)), "auto": math.ceil(math.sqrt(width)), "all": width}.get(forest.getFeatureSubsetStrategy())
    plain = forest.getImpurity() == "gini" and forest.getBootstrap() and forest.getNumTrees() > 1 and forest.getMinWeightFractionPerNode() == 0
    if picked is None or not plain or forest.getMaxDepth() == 0 or forest.isDefined("weightCol") or forest.isDefined("thresholds"):
        return None
    return Rules(forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getMinInfoGain(),
                 forest.getSubsamplingRate(), picked, forest.getMaxBins(), forest.getSeed())


# --- bins -----------------------------------------------------------------------------------------------------------

def _shortened(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different values and their counts (ones, if not given), as they are or, if there are many, as ``SUMMARY`` of them that stand for those before them."""
    if counts is None:
        values, counts = np.sort(values), np.ones(len(values), np.int64)
    else:
        order = np.argsort(values)
        values, counts = values[order], counts[order]
    first = np.flatnonzero(np.diff(values, prepend=np.nan) != 0)
    values, below = values[first], np.cumsum(counts)[np.append(first[1:], len(counts)) - 1]
    if len(values) > SUMMARY:
        at = np.unique(np.searchsorted(below, below[-1] * np.arange(1, SUMMARY + 1) / SUMMARY))
        values, below = values[at], below[at]
    return values, np.diff(below, prepend=0)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    label = batch.column("label").to_numpy(zero_copy_only=False)
    return batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1), label


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        x, y = _matrix(batch)
        for i in range(0, len(y), rows):
            held.append((x[i:i + rows], y[i:i + rows]))
            n += len(held[-1][1])
            if n >= rows:
                yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
                held, n = [], 0
    if n:
        yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: list[tuple[np.ndarray, np.ndarray]] = []
    for x, _ in _gathered(batches, 4 * BLOCK_ROWS):
        now = [_shortened(x[:, f]) for f in range(x.shape[1])]
        known = [_shortened(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])) for a, b in zip(known, now)] if known else now
    if known:
        yield pa.RecordBatch.from_arrays([
            pa.array(range(len(known)), pa.int32()), pa.array([v.tobytes() for v, _ in known], pa.binary()),
            pa.array([c.tobytes() for _, c in known], pa.binary())], names=["feature", "values", "counts"])


def _cuts(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 thresholds halfway between neighbouring values: all of them, or those nearest to equal shares of the rows."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) >= bins:
        below = np.cumsum(counts)
        share = below[-1] * np.arange(1, bins) / bins
        at = np.searchsorted(below, share)
        before = np.maximum(at - 1, 0)
        at = np.where(np.abs(below[before] - share) < np.abs(below[at] - share), before, at)
        middle = middle[np.unique(np.minimum(at, len(middle) - 1))]
    return np.unique(middle)


def thresholds(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Each feature's thresholds, from all rows' values; a bin's rows are at most its threshold."""
    def cut(table: pa.Table) -> pa.Table:
        v, c = (np.frombuffer(b"".join(table.column(k).to_pylist()), t) for k, t in (("values", np.float64), ("counts", np.int64)))
        made = _cuts(*_shortened(v, c), bins)
        return pa.table({"feature": table.column("feature").slice(0, 1), "cuts": pa.array([made.tolist()], pa.list_(pa.float64()))})

    short = rows.select("features", "label").mapInArrow(_summaries, "feature int, values binary, counts binary")
    found = short.groupBy("feature").applyInArrow(cut, "feature int, cuts array<double>").collect()
    return [np.array(r.cuts, np.float64) for r in sorted(found, key=lambda r: r.feature)]


def blocks(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``(block, bins, labels)``, written once: bin numbers of up to ``BLOCK_ROWS`` rows, row by row. A block's number goes with it, so its random weights are always the same."""
    def packed(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, (x, y) in enumerate(_gathered(batches, BLOCK_ROWS)):
            b = np.empty(x.shape, np.uint16)
            for f, cut in enumerate(cuts):
                b[:, f] = np.searchsorted(cut, x[:, f])
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | i], pa.int64()), pa.array([b.tobytes()], pa.binary()), pa.array([y.astype(np.uint8).tobytes()], pa.binary())],
                                             names=["block", "bins", "labels"])

    return cut_lineage(rows.select("features", "label").mapInArrow(packed, "block bigint, bins binary, labels binary"), "blocks")


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for block, bins, labels in zip(*(batch.column(c) for c in ("block", "bins", "labels"))):
            yield block.as_py(), np.frombuffer(bins.as_buffer(), np.uint16).reshape(-1, width), np.frombuffer(labels.as_buffer(), np.uint8)


def _weights(r: Rules, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block was drawn for a tree: Poisson with the subsampling rate."""
    u = np.random.Generator(np.random.SFC64([r.seed & 0xFFFFFFFFFFFFFFFF, tree, block])).random(n, np.float32)
    out, term, total, k = np.zeros(n, np.uint8), math.exp(-r.rate), 0.0, 0
    while (total := total + term) < 1 - 1e-7 and k < 100:
        out += u >= np.float32(total)
        k += 1
        term *= r.rate / k
    return out


# --- splits ---------------------------------------------------------------------------------------------------------

def _half_gini(n: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Half of Gini impurity times rows."""
    return np.divide(n1 * (n - n1), n, out=np.zeros(len(n)), where=n > 0)


def _best(below: np.ndarray, below1: np.ndarray, n: np.ndarray, n1: np.ndarray, width: np.ndarray, least: float):
    """For nodes whose cells lie one after the other: the least impurity of a cut (infinite where none is allowed), its bin, rows up to it.

    ``below`` are the rows of a node up to and with a cell, ``below1`` those of the second class.
    """
    starts = np.cumsum(width) - width
    rest, rest1 = np.repeat(n, width) - below, np.repeat(n1, width) - below1
    allowed = (below >= least) & (rest >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = below1 * (below - below1) / below + rest1 * (rest - rest1) / rest
    left[~allowed] = np.inf
    least_of = np.minimum.reduceat(left, starts)
    hit = np.flatnonzero(left == np.repeat(least_of, width))[::-1]
    at = np.empty(len(width), np.int64)
    at[np.repeat(np.arange(len(width)), width)[hit]] = hit
    return least_of, at - starts, below[at], below1[at]


def _drawn(r: Rules, width: int, nodes: int, *of: int) -> np.ndarray:
    """The features that each of ``nodes`` nodes looks at, ascending."""
    if r.picked >= width:
        return np.tile(np.arange(width), (nodes, 1))
    u = np.random.Generator(np.random.SFC64([r.seed & 0xFFFFFFFFFFFFFFFF, *of])).random((nodes, width), np.float32)
    return np.sort(np.argpartition(u, r.picked, axis=1)[:, :r.picked], axis=1)


def _cells(flat: np.ndarray, base: np.ndarray, node: np.ndarray, weight: np.ndarray, feature: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Sums of weights by node and bin of the node's ``feature``; a row's bins begin at ``base``."""
    starts = np.cumsum(width) - width
    return np.bincount(starts.take(node) + flat.take(base + feature.take(node)), weight, int(width.sum()))


NODE_CELLS = 1 << 22        # evaluated at a time


def subtree(flat: np.ndarray, width: int, labels: np.ndarray, drawn: np.ndarray, widths: np.ndarray, r: Rules, depth: int, *of: int) -> dict[str, np.ndarray]:
    """All nodes below and with the one whose rows these are, by level; ``depth`` levels of splits at most. Children are -1 in a leaf."""
    base, weight = np.arange(len(labels)) * width, drawn * (1 + labels * FIRST_CLASS)
    n, n1 = np.array([drawn.sum(dtype=np.float64)]), np.array([drawn[labels == 1].sum(dtype=np.float64)])
    node, ids, made, levels = np.zeros(len(labels), np.int64), np.zeros(1, np.int64), 1, []
    out = {k: [] for k in ("n", "n1", "left", "feature", "bin", "gain")}
    for level in range(depth + 1):
        m = len(n)
        feature, cut, gain, left = np.full(m, -1), np.zeros(m, np.int64), np.full(m, -1.0), np.full(m, -1)
        ln, ln1 = np.zeros(m), np.zeros(m)
        opened = np.flatnonzero((n >= 2 * r.least) & (n1 > 0) & (n1 < n)) if level < depth else ids[:0]
        if len(opened):
            new = np.full(m, -1)
            new[opened] = np.arange(len(opened))
            node = new.take(node)
            stay = node >= 0
            if not stay.all():
                node, base, weight = node[stay], base[stay], weight[stay]
            feats = _drawn(r, width, m, *of, level)[opened]
            on, on1 = n[opened], n1[opened]
            least = np.full(len(opened), np.inf)
            for j in range(feats.shape[1]):
                f = feats[:, j]
                w = widths[f]
                cells = _cells(flat, base, node, weight, f, w)
                upto = np.concatenate([[0], np.cumsum(w)])
                first = 0
                while first < len(f):
                    last = max(first + 1, int(np.searchsorted(upto, upto[first] + NODE_CELLS, side="right")) - 1)
                    below = np.cumsum(cells[upto[first]:upto[last]])
                    own = w[first:last]
                    begin = np.cumsum(own) - own
                    below -= np.repeat(np.where(begin > 0, below[begin - 1], 0.0), own)
                    below1 = np.floor(below / FIRST_CLASS)
                    below -= below1 * FIRST_CLASS
                    s, b, a, a1 = _best(below, below1, on[first:last], on1[first:last], own, r.least)
                    better = np.flatnonzero(s < least[first:last])
                    to = opened[first + better]
                    least[first + better], feature[to], cut[to], ln[to], ln1[to] = s[better], f[first + better], b[better], a[better], a1[better]
                    first = last
            got = np.where(np.isfinite(least), 2 * (_half_gini(on, on1) - least) / on, -1.0)
            split = opened[(got > 0) & (got >= r.gain)]
            gain[opened] = got
        else:
            split = opened
        closed = np.ones(m, bool)
        closed[split] = False
        feature[closed], gain[closed] = -1, -1.0
        left[split] = made + 2 * np.arange(len(split))
        for k, v in zip(out, (n, n1, left, feature, cut, gain)):
            out[k].append(v)
        levels.append(ids)
        if not len(split):
            break
        rank = np.full(m, -1)
        rank[split] = 2 * np.arange(len(split))
        own = opened.take(node)
        to = rank.take(own)
        stay = to >= 0
        own, to, base, weight = own[stay], to[stay], base[stay], weight[stay]
        node = to + (flat.take(base + feature.take(own)) > cut.take(own))
        ids = made + np.arange(2 * len(split))
        made += len(ids)
        n, n1 = (np.stack([a[split], b[split] - a[split]], 1).ravel() for a, b in ((ln, n), (ln1, n1)))
    return _merged({k: np.concatenate(v) for k, v in out.items()}, levels)


def _merged(t: dict[str, np.ndarray], levels: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Sibling leaves that predict the same become one leaf, from below; what they leave is numbered anew, by level."""
    says, leaf, left = 2 * t["n1"] > t["n"], t["left"] < 0, t["left"].copy()
    for ids in reversed(levels):
        inner = ids[~leaf[ids]]
        a = left[inner]
        leaf[inner[leaf[a] & leaf[a + 1] & (says[a] == says[a + 1])]] = True
    kept = np.zeros(len(left), bool)
    kept[0] = True
    for ids in levels:
        inner = ids[kept[ids] & ~leaf[ids]]
        kept[left[inner]] = kept[left[inner] + 1] = True
    number = np.cumsum(kept) - 1
    t["left"] = np.where(leaf, -1, number[np.where(leaf, 0, left)])
    t["feature"], t["gain"] = np.where(leaf, -1, t["feature"]), np.where(leaf, -1.0, t["gain"])
    return {k: v[kept] for k, v in t.items()}


# --- upper nodes ----------------------------------------------------------------------------------------------------

OPEN, GROUP, LEAF, INNER = range(4)


@dataclass
class Top:
    """The upper nodes of a tree; a child's number is larger than its parent's."""

    left: list[int] = field(default_factory=lambda: [-1])
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    gain: list[float] = field(default_factory=lambda: [-1.0])
    depth: list[int] = field(default_factory=lambda: [0])
    state: list[int] = field(default_factory=lambda: [OPEN])
    n: list[int] = field(default_factory=lambda: [0])
    n1: list[int] = field(default_factory=lambda: [0])

    def placed(self, flat: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The node that each row has come to."""
        left, feature, cut = np.array(self.left), np.array(self.feature), np.array(self.cut)
        node = np.zeros(len(base), np.int64)
        for _ in range(max(self.depth)):
            to, f = left.take(node), feature.take(node)
            inner = to >= 0
            node = np.where(inner, to + (flat.take(base + np.where(inner, f, 0)) > cut.take(node)), node)
        return node

    def add(self, parent: int, depth: int, n: int, n1: int, r: Rules) -> None:
        ends = depth == r.depth or n < 2 * r.least or n1 in (0, n)
        for k, v in (("left", -1), ("feature", -1), ("cut", 0), ("gain", -1.0), ("depth", depth), ("n", n), ("n1", n1),
                     ("state", LEAF if ends else OPEN if n > GROUP_ROWS else GROUP)):
            getattr(self, k).append(v)


def _split_open(stored: DataFrame, tops: list[Top], r: Rules, widths: np.ndarray, ready: list[tuple[int, int]]) -> None:
    """One pass: split the nodes ``ready``, (tree, node) each, by the counts of all rows."""
    width = len(widths)
    feats = {(t, i): _drawn(r, width, 1, t, i, 1 << 20)[0] for t, i in ready}
    slots: dict[int, list[int]] = {}
    for t, i in ready:
        slots.setdefault(t, []).append(i)

    def counted(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        rows = 0

        def given():
            for (t, j), cells in held.items():
                own = widths[[feats[t, i][j] for i in slots[t]]]
                ends = np.cumsum(own)
                some = [k for k in range(len(own)) if cells[ends[k] - own[k]:ends[k]].any()]
                if some:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([t] * len(some), pa.int32()), pa.array([slots[t][k] for k in some], pa.int32()), pa.array([j] * len(some), pa.int32()),
                        pa.array([cells[ends[k] - own[k]:ends[k]].tobytes() for k in some], pa.binary())], names=["tree", "node", "slot", "cells"])

        for block, bins, labels in _unpacked(batches, width):
            flat = bins.ravel()
            for t, nodes in slots.items():
                drawn = _weights(r, t, block, len(labels))
                at = np.flatnonzero(drawn)
                which = np.full(len(tops[t].left), -1)
                which[nodes] = np.arange(len(nodes))
                node = which.take(tops[t].placed(flat, at * width))
                stay = node >= 0
                node, at = node[stay], at[stay]
                weight = drawn.take(at) * (1 + labels.take(at) * FIRST_CLASS)
                for j in range(r.picked if r.picked < width else width):
                    f = np.array([feats[t, i][j] for i in nodes])
                    cells = _cells(flat, at * width, node, weight, f, widths[f])
                    held[t, j] = held[t, j] + cells if (t, j) in held else cells
            rows += len(labels)
            if rows > 1 << 22:
                yield from given()
                held, rows = {}, 0
        yield from given()

    def chosen(table: pa.Table) -> pa.Table:
        t, i = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        total: dict[int, list[np.ndarray]] = {}
        for j, cells in zip(table.column("slot").to_pylist(), table.column("cells").to_pylist()):
            both = np.frombuffer(cells)
            n1 = np.floor(both / FIRST_CLASS)
            pair = total.setdefault(j, [np.zeros(len(both)), np.zeros(len(both))])
            pair[0] += both - n1 * FIRST_CLASS
            pair[1] += n1
        found = None
        for j, (n, n1) in sorted(total.items()):
            whole = np.array([n.sum()]), np.array([n1.sum()])
            s, b, a, a1 = _best(np.cumsum(n), np.cumsum(n1), *whole, np.array([len(n)]), r.least)
            gain = float(2 * (_half_gini(*whole) - s)[0] / whole[0][0]) if np.isfinite(s[0]) else -1.0
            if found is None or gain > found["gain"]:
                found = dict(tree=t, node=i, feature=int(feats[t, i][j]), cut=int(b[0]), gain=gain, n=int(whole[0][0]), n1=int(whole[1][0]), a=int(a[0]), a1=int(a1[0]))
        return pa.Table.from_pylist([found], SPLIT)

    counts = stored.mapInArrow(counted, "tree int, node int, slot int, cells binary")
    for s in counts.groupBy("tree", "node").applyInArrow(chosen, "tree int, node int, feature int, cut int, gain double, n bigint, n1 bigint, a bigint, a1 bigint").collect():
        top = tops[s.tree]
        top.n[s.node], top.n1[s.node] = s.n, s.n1
        if s.gain > 0 and s.gain >= r.gain:
            top.feature[s.node], top.cut[s.node], top.gain[s.node], top.left[s.node], top.state[s.node] = s.feature, s.cut, s.gain, len(top.left), INNER
            top.add(s.node, top.depth[s.node] + 1, s.a, s.a1, r)
            top.add(s.node, top.depth[s.node] + 1, s.n - s.a, s.n1 - s.a1, r)
        else:
            top.state[s.node] = LEAF
    for t, i in ready:      # no row was drawn for it
        if tops[t].state[i] == OPEN:
            tops[t].state[i] = LEAF


SPLIT = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), ("gain", pa.float64()),
                   ("n", pa.int64()), ("n1", pa.int64()), ("a", pa.int64()), ("a1", pa.int64())])
NODES = pa.schema([("tree", pa.int32()), ("root", pa.int32()), ("id", pa.int32()), ("left", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64()),
                   ("gain", pa.float64()), ("n", pa.float64()), ("n1", pa.float64())])
NODE_COLUMNS = "tree int, root int, id int, left int, feature int, threshold double, gain double, n double, n1 double"


def _lower(stored: DataFrame, tops: list[Top], r: Rules, cuts: list[np.ndarray]) -> DataFrame:
    """The nodes below and with those of state GROUP: a group's rows meet in one task."""
    width, widths = len(cuts), np.array([len(c) + 1 for c in cuts])
    placed = {t: np.array([i if s == GROUP else -1 for i, s in enumerate(top.state)]) for t, top in enumerate(tops) if GROUP in top.state}

    def sent(batches):
        for block, bins, labels in _unpacked(batches, width):
            flat = bins.ravel()
            for t, group in placed.items():
                drawn = _weights(r, t, block, len(labels))
                at = np.flatnonzero(drawn)
                own = group.take(tops[t].placed(flat, at * width))
                order = np.argsort(own.astype(np.int16 if len(group) < 1 << 15 else np.int32), kind="stable")
                order = order[np.count_nonzero(own < 0):]
                if not len(order):
                    continue
                own, at = own[order], at[order]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                ends = np.append(first, len(own))
                flags = (drawn.take(at) << 1 | labels.take(at)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    pa.array([t] * len(first), pa.int32()), pa.array(own[first], pa.int32()),
                    pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((ends * 2 * width).astype(np.int32)), pa.py_buffer(bins.take(at, axis=0))]),
                    pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flags)])], names=["tree", "root", "bins", "flags"])

    def grown(table: pa.Table) -> pa.Table:
        t, root = table.column("tree")[0].as_py(), table.column("root")[0].as_py()
        flat = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint16)
        flags = np.frombuffer(b"".join(table.column("flags").to_pylist()), np.uint8)
        got = subtree(flat, width, flags & 1, flags >> 1, widths, r, r.depth - tops[t].depth[root], t, root)
        size, inner = len(got["n"]), got["left"] >= 0
        threshold = np.zeros(size)
        for f in range(width):
            own = inner & (got["feature"] == f)
            threshold[own] = cuts[f][got["bin"][own]]
        return pa.table([np.full(size, t), np.full(size, root), np.arange(size), got["left"], got["feature"], threshold, got["gain"], got["n"], got["n1"]],
                        names=NODES.names).cast(NODES)

    spark = stored.sparkSession
    size = stored.agg(F.sum(F.octet_length("bins"))).first()[0] or 0
    sent_bytes = size * r.trees * (1 - math.exp(-r.rate))
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sent_bytes / PART_BYTES))
    with settings(spark, {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        pieces = stored.mapInArrow(sent, "tree int, root int, bins binary, flags binary")
        return cut_lineage(pieces.groupBy("tree", "root").applyInArrow(grown, NODE_COLUMNS), "nodes")


# --- the model ------------------------------------------------------------------------------------------------------

def _whole(spark: SparkSession, tops: list[Top], lower: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """All nodes of all trees, numbered so that a child comes after its parent, leaves that say the same merged among the upper nodes as below."""
    roots = {(x.tree, x.root): x for x in lower.groupBy("tree", "root").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.when(F.col("id") == 0, F.struct((F.col("left") < 0).alias("leaf"), (2 * F.col("n1") > F.col("n")).alias("says")))).alias("is")).collect()}
    upper, places = [], []
    for t, top in enumerate(tops):
        count = len(top.left)
        top.state = [LEAF if s == GROUP and (t, i) not in roots else s for i, s in enumerate(top.state)]    # no row was drawn for it
        leaf, says = [False] * count, [False] * count
        for i in reversed(range(count)):
            if top.state[i] == GROUP:
                leaf[i], says[i] = roots[t, i]["is"].leaf, roots[t, i]["is"].says
            else:
                a = top.left[i]
                leaf[i] = top.state[i] != INNER or (leaf[a] and leaf[a + 1] and says[a] == says[a + 1])
                says[i] = 2 * top.n1[i] > top.n[i]
        kept, number = {0}, {}
        for i in range(count):
            if i in kept:
                number[i] = len(number)
                if top.state[i] == INNER and not leaf[i]:
                    kept |= {top.left[i], top.left[i] + 1}
        used = len(number)
        for i, mine in number.items():
            if top.state[i] == GROUP:
                places.append((t, i, mine, used))
                used += roots[t, i].size - 1
            else:
                inner = top.state[i] == INNER and not leaf[i]
                upper.append((t, mine, number[top.left[i]] if inner else -1, number[top.left[i] + 1] if inner else -1, top.feature[i] if inner else -1,
                              float(cuts[top.feature[i]][top.cut[i]]) if inner else 0.0, top.gain[i] if inner else -1.0, float(top.n[i]), float(top.n1[i])))
    shape = "tree int, id int, left int, right int, feature int, threshold double, gain double, n double, n1 double"
    where = F.broadcast(spark.createDataFrame(places, "tree int, root int, mine int, used int"))

    def renamed(c):
        return F.when(c <= 0, F.when(c == 0, F.col("mine")).otherwise(-1)).otherwise(F.col("used") + c - 1)

    below = lower.join(where, ["tree", "root"]).select(
        "tree", renamed(F.col("id")).alias("id"), renamed(F.col("left")).alias("left"), F.when(F.col("left") < 0, -1).otherwise(renamed(F.col("left") + 1)).alias("right"),
        "feature", "threshold", "gain", "n", "n1")
    return spark.createDataFrame(upper, shape).unionByName(below)


def _saved(forest: RandomForestClassifier, nodes: DataFrame, width: int, path: str) -> None:
    """The files of a pipeline with the library's own forest model."""
    spark, now, uid = nodes.sparkSession, int(time.time() * 1000), forest.uid
    given, usual = ({p.name: v for p, v in m.items()} for m in (forest._paramMap, forest._defaultParamMap))

    def described(kind: str, name: str, own: dict, **more) -> str:
        return json.dumps({"class": kind, "timestamp": now, "sparkVersion": spark.version, "uid": name, **own, **more})

    def text(line: str, to: str) -> None:
        spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(to)

    pipeline = f"PipelineModel_{uid.rsplit('_', 1)[-1]}"
    text(described("org.apache.spark.ml.PipelineModel", pipeline, {"paramMap": {"stageUids": [uid]}, "defaultParamMap": {}}), f"{path}/metadata")
    stage, trees = f"{path}/stages/0_{uid}", forest.getNumTrees()
    text(described(MODEL, uid, {"paramMap": given, "defaultParamMap": usual}, numFeatures=width, numClasses=2, numTrees=trees), f"{stage}/metadata")
    of_tree = {k: {a: b for a, b in m.items() if a not in OF_FORESTS} for k, m in (("paramMap", given), ("defaultParamMap", usual))}
    spark.createDataFrame([(t, described(TREE, f"dtc_{uid.rsplit('_', 1)[-1]}_{t}", of_tree), 1.0) for t in range(trees)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{stage}/treesMetadata")
    p, leaf = F.col("n1") / F.col("n"), F.col("left") < 0
    nodes.select(F.col("tree").alias("treeID"), F.struct(
        "id", F.when(2 * F.col("n1") > F.col("n"), 1.0).otherwise(0.0).alias("prediction"), F.when(F.col("n") > 0, 2 * p * (1 - p)).otherwise(0.0).alias("impurity"),
        F.array(F.col("n") - F.col("n1"), F.col("n1")).alias("impurityStats"), F.col("n").cast("bigint").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"), F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
                 F.lit(-1).alias("numCategories")).alias("split")).alias("nodeData")).write.parquet(f"{stage}/data")


def grown(forest: RandomForestClassifier, rows: DataFrame, dealt: DataFrame, width: int) -> str:
    """Train ``forest`` on rows ``(features array<double>, label)``, also given as they are dealt out to tasks; the folder of its saved pipeline."""
    r, spark = rules(forest, width), rows.sparkSession
    cuts = thresholds(rows, r.bins)
    widths = np.array([len(c) + 1 for c in cuts])
    stored = blocks(dealt, cuts)
    n = stored.agg(F.sum(F.octet_length("labels"))).first()[0] or 0
    tops = [Top() for _ in range(r.trees)]
    for top in tops:
        top.state[0] = LEAF if r.depth == 0 else OPEN if n > GROUP_ROWS else GROUP
    while ready := [(t, i) for t, top in enumerate(tops) for i, s in enumerate(top.state) if s == OPEN][:OPEN_NODES]:
        _split_open(stored, tops, r, widths, ready)
    path = run_folder(spark, "fitted")
    _saved(forest, _whole(spark, tops, _lower(stored, tops, r, cuts), cuts), width, path)
    return path
