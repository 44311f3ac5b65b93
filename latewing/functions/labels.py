"""Category and flag expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from latewing.functions.casts import _c


def status(arr_delay, cut: float = 15.0) -> Column:
    """Early below 0, On-time up to and including the cut, Delayed above; NULL stays NULL."""
    d = _c(arr_delay)
    return F.when(d < 0, "Early").when(d <= cut, "On-time").when(d > cut, "Delayed")


def status_rank(s) -> Column:
    s = _c(s)
    return F.when(s == "Early", 0).when(s == "On-time", 1).when(s == "Delayed", 2)


def season(month) -> Column:
    """Meteorological season of a month number; December counts for its own year."""
    m = _c(month)
    return (
        F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer").when(m.isin(9, 10, 11), "Fall")
    )


def confusion_type(label, prediction) -> Column:
    """Name of the confusion cell; a NULL on either side gives NULL."""
    y, z = _c(label), _c(prediction)
    return (
        F.when((y == 1) & (z == 1), "True Positive").when((y == 0) & (z == 0), "True Negative")
        .when((y == 0) & (z == 1), "False Positive").when((y == 1) & (z == 0), "False Negative")
    )


def correct_flag(label, prediction) -> Column:
    return F.when(_c(label) == _c(prediction), 1).otherwise(0)


def correct_word(label, prediction) -> Column:
    return F.when(_c(label) == _c(prediction), "Correct").otherwise("Wrong")


def at_threshold(p, threshold: float = 0.5) -> Column:
    return F.when(_c(p) >= threshold, 1).otherwise(0)


def confidence_band(p, lo: float = 0.3, hi: float = 0.7) -> Column:
    """``high`` outside [lo, hi], ``low`` inside, judged on the percentage rounded to one decimal."""
    pct = F.round(_c(p) * 100, 1)
    return F.when((pct > hi * 100) | (pct < lo * 100), "high").when(pct.isNotNull(), "low")


def day_part(hhmm) -> Column:
    """Part of day of an HHMM number: night 0-6, morning 6-12, afternoon 12-18, evening 18-24."""
    h = F.floor(_c(hhmm) / 100)
    return F.when(h < 6, "night").when(h < 12, "morning").when(h < 18, "afternoon").when(h.isNotNull(), "evening")


def rate_band(rate, low: float = 0.15, high: float = 0.25) -> Column:
    r = _c(rate)
    return F.when(r < low, "reliable").when(r > high, "unreliable").when(r.isNotNull(), "middle")


def correlation_strength(r) -> Column:
    a = F.abs(_c(r))
    return F.when(a > 0.3, "Strong").when(a > 0.1, "Moderate").when(a.isNotNull(), "Weak")


def mapped(c, names: dict) -> Column:
    """Value looked up in a small fixed dictionary; unknown values become NULL."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _c(c))
