"""Null-safe numeric expressions. Missing is NULL, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def no_nan(value: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(value), value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating-point column."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*(no_nan(F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields))


def simple_return(before: Column, after: Column) -> Column:
    """``after / before - 1``; NULL if either is NULL or the base is zero."""
    return F.when(before.isNotNull() & after.isNotNull() & (before != 0), after / before - 1)


def n_observed(columns: list[str]) -> Column:
    """How many of the columns hold a value."""
    return reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns))


def any_missing(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


def enough_observed(columns: list[str], fraction: float) -> Column:
    """At least ``ceil(fraction * n)`` of the n columns hold a value."""
    return n_observed(columns) >= -int(-(fraction * len(columns)) // 1)
