"""Tail probabilities in closed form or continued fractions, and pandas UDFs of them for result tables of a few rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi2_sf(x: float, df: int) -> float:
    """P(chi-squared with integer df > x)."""
    if x is None or df is None or math.isnan(x) or df < 1:
        return math.nan
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term = total = 1.0
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    term, total = 1.0, 0.0
    for i in range(1, df, 2):
        term = term * x / i if i > 1 else 1.0
        total += term
    return math.erfc(math.sqrt(half)) + math.sqrt(2 * x / math.pi) * math.exp(-half) * total


def normal_two_sided(z: float) -> float:
    return math.nan if z is None or math.isnan(z) else min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def regularized_beta(x: float, a: float, b: float) -> float:
    """I_x(a, b) by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - regularized_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def student_two_sided(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or df <= 0:
        return math.nan
    return 0.0 if math.isinf(t) else regularized_beta(df / (df + t * t), df / 2, 0.5)


def student_quantile(p: float, df: float) -> float:
    """The t with P(T < t) = p, p over one half, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - student_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([math.nan if pd.isna(a) or pd.isna(b) else chi2_sf(a, int(b)) for a, b in zip(x, df, strict=True)])


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(v) for v in z])


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_two_sided(a, b) for a, b in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def student_975(df: pd.Series) -> pd.Series:
    return pd.Series([student_quantile(0.975, d) if d > 0 else math.nan for d in df])
