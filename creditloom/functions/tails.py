"""Tail probabilities. Inputs are single statistics (one per report row), never row-level data."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) for a chi-square variable: finite sum, starting from exp or erfc."""
    if x is None or math.isnan(x) or df < 1:
        return float("nan")
    if x <= 0:
        return 1.0
    h = x / 2.0
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, df // 2):
            term *= h / k
            total += term
        return math.exp(-h) * total
    term = math.sqrt(h) / math.gamma(1.5)
    total = 0.0
    for k in range(1, (df - 1) // 2 + 1):
        total += term
        term *= h / (k + 0.5)
    return math.erfc(math.sqrt(h)) + math.exp(-h) * total


def chi2_tail_column(x: Column, df: int) -> Column:
    """Same as a column: closed form in SQL for even ``df``, Arrow batches over the report rows otherwise."""
    if df % 2 == 0:
        h = x / F.lit(2.0)
        total = F.lit(1.0)
        for k in range(1, df // 2):
            total = total + F.pow(h, F.lit(float(k))) / F.lit(float(math.factorial(k)))
        return F.exp(-h) * total

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: chi2_tail(v, df))

    return tail(x)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def student_two_sided(t: float, df: float, steps: int = 2000) -> float:
    """Two-sided tail of Student's t by Simpson's rule on the angle form of the integral."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    # P(|T| > t) = 2 * integral_{atan(t/sqrt(df))}^{pi/2} c * cos(a)^(df-1) da
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    lo, hi = math.atan(abs(t) / math.sqrt(df)), math.pi / 2
    width = (hi - lo) / steps

    def density(a: float) -> float:
        c = max(math.cos(a), 0.0)
        if c == 0.0:
            return math.exp(log_c) if df == 1 else 0.0
        return math.exp(log_c + (df - 1) * math.log(c))

    total = density(lo) + density(hi)
    total += sum((4 if i % 2 else 2) * density(lo + i * width) for i in range(1, steps))
    return min(1.0, 2.0 * total * width / 3.0)


def pearson_two_sided(r: float, n: int) -> float:
    """p-value of a correlation coefficient over ``n`` pairs."""
    if n is None or n < 3 or r is None or math.isnan(r):
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    return student_two_sided(r * math.sqrt((n - 2) / (1.0 - r * r)), n - 2)
