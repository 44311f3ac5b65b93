"""Ordered computations that stay balanced when one key holds a large share of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here the ordered space (key, order) is cut into
ranges of bounded size, the window runs per (key, range), and only what crosses a range border is settled in a second,
small step. Range borders come from a bounded sample, like the ones of Spark's own range partitioner, but as a value in
the plan, so every branch of a query sees the same borders. Where no key has more than ``CHUNK_ROWS`` rows the plain window
is used. All results are exact on both ways.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from latewing.session import cut_lineage

CHUNK_ROWS = 1_000_000   # rows one window task may hold
PER_PIECE = 16           # sampled rows per border
LEVELS = 3               # steps of the border search

_CHUNK, _POS, _N = "_chunk", "_pos", "_n"


def with_chunk(df: DataFrame, cols: Sequence[str], rows: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add an int column that grows with the tuple ``cols`` and splits the table into ranges of similar size.

    ``rows`` may be an upper bound. Columns must be comparable; tuples that are equal share a range.
    """
    pieces = ceil(rows / chunk_rows) + 1
    width = max(2, ceil(pieces ** (1 / LEVELS)))
    # Hash sample of about PER_PIECE rows per piece: the same rows whatever the partitioning.
    grain = 1 << 30
    keep = max(1, min(grain, round(grain * pieces * PER_PIECE / max(rows, 1))))
    tuple_col = F.struct(*[F.col(c) for c in cols])
    sample = (
        df.where(F.pmod(F.xxhash64(*cols), F.lit(grain)) < keep).select(tuple_col.alias("t")).distinct()
        .agg(F.sort_array(F.collect_list("t")).alias("a"))
    )
    # All borders, every width-th, every width²-th …: a search looks at a few short slices instead of all borders.
    def each(n: int) -> Column:
        return F.filter("a", lambda _, i: (i + 1) % n == 0)

    levels = [f"l{k}" for k in range(LEVELS)]
    # The borders are few by construction. As JSON they fold into one literal of the plan, the same for every branch;
    # a subquery's value would have to be carried through the rows. Any values will do as borders, so nothing is lost.
    text = sample.select(F.to_json(F.struct(*[each(PER_PIECE * width ** k).alias(n) for k, n in enumerate(levels)]))).first()[0]
    element = T.StructType([T.StructField(c, df.schema[c].dataType) for c in cols])
    borders = F.from_json(F.lit(text), T.StructType([T.StructField(n, T.ArrayType(element)) for n in levels]))
    df = df.withColumn(_CHUNK, F.size(F.filter(borders[levels[-1]], lambda x: x <= tuple_col)))
    for name in reversed(levels[:-1]):
        near = F.slice(borders[name], F.col(_CHUNK) * width + 1, F.lit(width))
        df = df.withColumn(_CHUNK, F.col(_CHUNK) * width + F.size(F.filter(near, lambda x: x <= tuple_col)))
    return df


def _fits(df: DataFrame, key: Sequence[str], rows: int, chunk_rows: int) -> bool:
    """Whether a plain window is safe: few rows in all, or, as measured by a two-step count, in every key."""
    if rows <= chunk_rows:
        return True
    if not key:
        return False
    largest = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) <= chunk_rows


def known_size(df: DataFrame, rows: int | None, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, int]:
    """An aggregate whose bound is small stays as it is; else it is written out, which settles its true size."""
    if rows is not None and rows <= chunk_rows:
        return df, rows
    df = cut_lineage(df, "ordered")
    return df, df.count()


def windowed(
    df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Callable[[WindowSpec], dict[str, Column]],
    back: int = 0, ahead: int = 0, rows: int | None = None, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add window columns that look at most ``back`` rows behind and ``ahead`` rows in front of the current one.

    ``order`` must be a total order inside a key. ``rows`` is the table size or an upper bound of it.
    """
    rows = df.count() if rows is None else rows
    if _fits(df, key, rows, chunk_rows):
        return df.withColumns(columns(Window.partitionBy(*key).orderBy(*order)))
    local = with_chunk(df, [*key, *order], rows, chunk_rows)
    part = Window.partitionBy(*key, _CHUNK)
    w = part.orderBy(*order)
    marked = local.withColumns({**columns(w), _POS: F.row_number().over(w), _N: F.count(F.lit(1)).over(part)})
    open_ended = (F.col(_POS) <= back) | (F.col(_N) - F.col(_POS) < ahead)
    reach = back + ahead
    context = (F.col(_POS) <= reach) | (F.col(_N) - F.col(_POS) < reach)
    names = list(columns(w))
    closed = marked.where(~open_ended).drop(_CHUNK, _POS, _N)
    border = (
        marked.where(context).withColumn("_open", open_ended).drop(*names)
        .withColumns(columns(Window.partitionBy(*key).orderBy(*order)))
        .where("_open").drop("_open", _CHUNK, _POS, _N)
    )
    return closed.unionByName(border)


def running(
    df: DataFrame, key: Sequence[str], order: Sequence[str], sums: dict[str, str],
    totals: dict[str, str] | None = None, rows: int | None = None, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Inclusive running sums ``{out: column}`` along ``order`` inside ``key``; an empty key means the whole table.

    ``totals`` adds whole-key sums in the same way.
    """
    rows = df.count() if rows is None else rows
    totals = totals or {}
    frame = (Window.unboundedPreceding, Window.currentRow)
    if _fits(df, key, rows, chunk_rows):
        part = Window.partitionBy(*key)
        w = part.orderBy(*order).rowsBetween(*frame)
        return df.withColumns(
            {o: F.sum(c).over(w) for o, c in sums.items()} | {o: F.sum(c).over(part) for o, c in totals.items()})
    local = with_chunk(df, [*key, *order], rows, chunk_rows)
    w = Window.partitionBy(*key, _CHUNK).orderBy(*order).rowsBetween(*frame)
    inside = local.withColumns({o: F.sum(c).over(w) for o, c in sums.items()})
    # A key that began in an earlier range carries its sums into this one: at most one key per range, so the table of
    # carried sums has no more rows than there are ranges and can be broadcast.
    before = Window.partitionBy(*key).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        local.groupBy(*key, _CHUNK).agg(*[F.sum(c).alias(f"_s_{o}") for o, c in sums.items()])
        .withColumns({f"_c_{o}": F.sum(f"_s_{o}").over(before) for o in sums} | {"_k": F.count(F.lit(1)).over(before)})
        .where("_k > 0")
        .select(*[F.col(k).alias(f"_o_{k}") for k in key], F.col(_CHUNK).alias("_oc"), *[f"_c_{o}" for o in sums])
    )
    on = F.col(_CHUNK) == F.col("_oc")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    out = inside.join(F.broadcast(carried), on, "left").withColumns(
        {o: F.coalesce(F.col(o) + F.col(f"_c_{o}"), F.col(o), F.col(f"_c_{o}")) for o in sums}
    ).drop(_CHUNK, "_oc", *[f"_o_{k}" for k in key], *[f"_c_{o}" for o in sums])
    if not totals:
        return out
    whole = df.groupBy(*[F.col(k).alias(f"_t_{k}") for k in key]).agg(
        *[F.sum(c).alias(o) for o, c in totals.items()])
    if not key:
        return out.withColumn("_t", whole.select(F.struct(*totals)).scalar()).select(*out.columns, "_t.*")
    same = None
    for k in key:
        cond = F.col(k).eqNullSafe(F.col(f"_t_{k}"))
        same = cond if same is None else same & cond
    return out.join(whole, same, "left").drop(*[f"_t_{k}" for k in key])


def following_min(
    df: DataFrame, key: Sequence[str], order: Sequence[str], mins: dict[str, str], rows: int | None = None, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """For each row the smallest value of ``{out: column}`` among the rows after it along ``order`` inside ``key``; NULL at the end.

    The window runs backwards, since a frame that is open ahead is built anew for every row.
    """
    rows = df.count() if rows is None else rows
    behind = (Window.unboundedPreceding, -1)
    reverse = [F.desc(c) for c in order]
    if _fits(df, key, rows, chunk_rows):
        w = Window.partitionBy(*key).orderBy(*reverse).rowsBetween(*behind)
        return df.withColumns({o: F.min(c).over(w) for o, c in mins.items()})
    local = with_chunk(df, [*key, *order], rows, chunk_rows)
    w = Window.partitionBy(*key, _CHUNK).orderBy(*reverse).rowsBetween(*behind)
    inside = local.withColumns({o: F.min(c).over(w) for o, c in mins.items()})
    # What later ranges of a key hold: a row for each range of a key but its last, so no more rows than ranges.
    later = Window.partitionBy(*key).orderBy(F.desc(_CHUNK)).rowsBetween(*behind)
    carried = (
        local.groupBy(*key, _CHUNK).agg(*[F.min(c).alias(f"_m_{o}") for o, c in mins.items()])
        .withColumns({f"_c_{o}": F.min(f"_m_{o}").over(later) for o in mins} | {"_k": F.count(F.lit(1)).over(later)})
        .where("_k > 0")
        .select(*[F.col(k).alias(f"_o_{k}") for k in key], F.col(_CHUNK).alias("_oc"), *[f"_c_{o}" for o in mins])
    )
    on = F.col(_CHUNK) == F.col("_oc")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return inside.join(F.broadcast(carried), on, "left").withColumns(
        {o: F.least(F.col(o), F.col(f"_c_{o}")) for o in mins}
    ).drop(_CHUNK, "_oc", *[f"_o_{k}" for k in key], *[f"_c_{o}" for o in mins])
