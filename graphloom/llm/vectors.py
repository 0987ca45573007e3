"""Column predicates for embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~broken, F.lit(False))


def nonzero(vector: Column) -> Column:
    return F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
