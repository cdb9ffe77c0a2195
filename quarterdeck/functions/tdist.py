"""Student's t distribution without scipy, by the continued fraction of the incomplete beta function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def upper_tail(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isnan(t) or df < 1:
        return math.nan
    p = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return p if t > 0 else 1 - p


@pandas_udf(DoubleType())
def _tails(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([upper_tail(float(a), float(b)) if a == a and b == b and a is not None and b is not None else np.nan for a, b in zip(t, df)])


def t_upper_tail(t: Column, df: Column) -> Column:
    """P(T > t) of a column of statistics; NULL where either is missing. Statistics are few rows, one per test."""
    p = _tails(t.cast("double"), df.cast("double"))
    return F.when(t.isNotNull() & df.isNotNull() & ~F.isnan(p), p)
