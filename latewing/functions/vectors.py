"""Access to ML vectors without a Python worker."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, functions as F

from latewing.functions.casts import _c


def vec_get(vec, i: int, default: float | None = None) -> Column:
    """Slot ``i``; a missing vector or slot gives ``default``."""
    v = F.when(_c(vec).isNotNull(), F.get(vector_to_array(_c(vec)), F.lit(i)))
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def delay_probability(vec="probability") -> Column:
    return vec_get(vec, 1, 0.0)
