"""Whole-number vectors for the exact vector operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers beyond this are taken as this, so that sums of squares and products of up to 128 components fit a long.
LARGEST = 1 << 27


def is_finite(vector: Column) -> Column:
    """Whether vector is not null and each of its components is a finite number."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as double, an array of ints within LARGEST."""
    within = lambda x: F.least(F.greatest(x.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    return F.transform(vector, lambda x: F.floor(within(x)).cast("int"))
