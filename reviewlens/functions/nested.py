"""Helpers for arrays of words kept inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also when used inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_of(df: DataFrame, array: str, name: str, *keep: str) -> DataFrame:
    """One row per element of an array column that was costly to work out.

    The outer form of the generator keeps the planner from adding a filter on the size of
    the array, which it would push down to where the array is made and so make it twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
