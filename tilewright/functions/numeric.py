"""Small column helpers shared by the rule functions."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}


def clip(value: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def all_of(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result & condition
    return result


def any_of(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def within(columns: dict[str, Column], bounds: list[tuple[str, str, float]]) -> Column:
    """Conjunction of (column, comparison, value) bounds."""
    return all_of([COMPARE[op](columns[name], F.lit(value)) for name, op, value in bounds])


def contains_any(text: Column, words: list[str]) -> Column:
    return any_of([text.contains(word) for word in words])


def fixed2(value: Column) -> Column:
    """Two-decimal text."""
    return F.format_string("%.2f", value)
