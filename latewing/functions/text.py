"""String expressions: codes, periods, clock times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from latewing.functions.casts import _c

# Fixed value: a counter such as " (1)" at the end of a carrier code.
CODE_SUFFIX = r"\s*\(\d+\)\s*$"


def normalise_code(c) -> Column:
    return F.upper(F.trim(F.regexp_replace(_c(c), CODE_SUFFIX, "")))


def has_suffix(c) -> Column:
    return _c(c).rlike(CODE_SUFFIX)


def period_plain(year, month) -> Column:
    """``2024-4``: not padded, NULL if a part is NULL."""
    return F.concat(_c(year).cast("string"), F.lit("-"), _c(month).cast("string"))


def period_padded(year, month) -> Column:
    """``2024-04``."""
    return F.concat(_c(year).cast("string"), F.lit("-"), F.lpad(_c(month).cast("string"), 2, "0"))


def clock(hhmm) -> Column:
    """HHMM number as ``HH:MM``; NULL and 0 print as N/A."""
    t = _c(hhmm).cast("int")
    hours = F.lpad(F.floor(t / 100).cast("string"), 2, "0")
    minutes = F.lpad((t % 100).cast("string"), 2, "0")
    return F.when(t.isNull() | (t == 0), "N/A").otherwise(F.concat(hours, F.lit(":"), minutes))
