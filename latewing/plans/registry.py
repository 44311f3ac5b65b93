"""Query registration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from latewing.sources.views import SQL


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    """Prefix a statement with the named views as common table expressions."""
    if not views:
        return sql.strip()
    ctes = ",\n".join(f"{v} AS ({SQL[v]})" for v in views)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, views: tuple[str, ...] | str = ()):
    """Register ``fn(spark, sf_dir)``; without SQL only its rows are checked."""
    views = (views,) if isinstance(views, str) else views

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, fn, None if sql is None else with_views(sql, views))
        return fn

    return add


def r(c: str | Column, dp: int = 4, name: str | None = None) -> Column:
    """Rounded output column, so that summation order does not show."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, dp).alias(name or c)
