"""Text to number and number to text, NULL instead of an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_via_double(c) -> Column:
    """Text to int, accepting "0.00"; truncates toward zero; NaN, overflow and junk become NULL."""
    return _c(c).try_cast("double").try_cast("int")


def int_direct(c) -> Column:
    """Strict text to int: "1835" passes, "1835.0" becomes NULL."""
    return _c(c).try_cast("int")


def double_or_null(c) -> Column:
    """Text to double; both junk and "NaN" become NULL."""
    d = _c(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def nan_to_null(c) -> Column:
    return F.when(~F.isnan(_c(c)), _c(c))


def fill_round_int(c) -> Column:
    """NULL as 0, round half to even, int."""
    return F.bround(F.coalesce(_c(c), F.lit(0.0)), 0).cast("int")


def hash_bucket(c, n: int = 10000) -> Column:
    """Stateless code in 0..n-1; never negative, also for the smallest int."""
    return F.pmod(F.hash(_c(c)), F.lit(n))
