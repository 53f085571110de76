"""Quantiles of values per group: exact, or from a mergeable sketch of bounded size.

The sketch (KLL) keeps some thousand values however many there are. A returned value's rank is off by at most
``RANK_ERROR`` of the rows with a probability of 99 %, and exact while a group has fewer than ``SKETCH`` values; it is always
one of the values. Exact quantiles interpolate, and keep a counter per distinct value of the group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SKETCH = 2048
RANK_ERROR = 0.0014


def state(value: Column, shares: list[float], exact: bool) -> Column:
    """Aggregate over the non-null values."""
    if exact:
        return F.percentile(value, F.array(*map(F.lit, shares)))
    return F.kll_sketch_agg_double(value.cast("double"), F.lit(SKETCH))


def read(column: Column, count: Column, shares: list[float], exact: bool) -> Column:
    """The quantiles as an array, from an aggregated ``state`` and the number of values; null without values."""
    if exact:
        return column.cast("array<double>")
    return F.when(count > 0, F.kll_sketch_get_quantile_double(column, F.array(*map(F.lit, shares))))
