"""Tail probabilities for the few rows of a test result."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: power series for small x, continued fraction beyond."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _t_sf(t: float, df: float) -> float:
    half = 0.5 * _beta_i(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), na_action="ignore")

    return tail(z)


def chi2_sf(x: Column, df: Column) -> Column:
    """Upper tail of chi-square."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else _gamma_q(k / 2, a / 2) for a, k in zip(x, df)], dtype="float64")

    return tail(x, df)


def t_sf(t: Column, df: Column) -> Column:
    """Upper tail of Student's t."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else _t_sf(a, k) for a, k in zip(t, df)], dtype="float64")

    return tail(t, df)
