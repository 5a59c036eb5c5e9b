"""Student-t and chi-squared quantiles for samples of any size, as columns.

The quantiles have no closed form, so they come from a Pandas UDF over the rows
of a grouped table, one small computation for each distinct sample size.
"""

import math
from functools import lru_cache
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Above so many degrees of freedom the expansions about the normal quantile are exact to double precision.
NORMAL_FROM = 1_000_000
_KIND = "t double, chi_lo double, chi_hi double, g_crit double"


def _fraction(terms, least: float = 1e-300) -> float:
    """The continued fraction 1 + a1 / (1 + a2 / (1 + ...)), by Lentz's forward evaluation."""
    value, c, d = 1.0, 1.0, 0.0
    for a in terms:
        d = 1.0 / (1.0 + a * d or least)
        c = 1.0 + a / c or least
        value *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return value


def _beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_cdf(1 - x, b, a)

    def terms():
        for m in range(100_000):
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            yield (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2))

    front = a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return math.exp(front) / a / _fraction(terms())


def _gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function, by its power series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def _solve(f, p: float, low: float, high: float) -> float:
    """The root of the increasing f(x) = p, by bisection to the last digit."""
    while True:
        mid = (low + high) / 2
        if mid in (low, high):
            return mid
        low, high = (mid, high) if f(mid) < p else (low, mid)


@lru_cache(maxsize=10_000)
def t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t for p >= 1/2: P(T > t) = I(df / (df + t^2); df/2, 1/2) / 2."""
    if df > NORMAL_FROM:  # Hill's expansion
        z = NormalDist().inv_cdf(p)
        return z * (1 + (z**2 + 1) / (4 * df) + (5 * z**4 + 16 * z**2 + 3) / (96 * df**2))
    return _solve(lambda t: -0.5 * _beta_cdf(df / (df + t * t), df / 2, 0.5), p - 1, 0.0, 1e6)


@lru_cache(maxsize=10_000)
def chi2_quantile(p: float, df: int) -> float:
    if df > NORMAL_FROM:  # Cornish and Fisher
        z = NormalDist().inv_cdf(p)
        return df + z * math.sqrt(2 * df) + 2 / 3 * (z**2 - 1) + (z**3 - 7 * z) / (9 * math.sqrt(2 * df))
    return _solve(lambda x: _gamma_cdf(x / 2, df / 2), p, 0.0, 20.0 * df + 100)


@lru_cache(maxsize=10_000)
def quantile_row(n: int, alpha: float = 0.05) -> tuple[float | None, ...]:
    """(t, chi_lo, chi_hi, g_crit) of a sample of n: two-sided quantiles of n - 1 degrees of freedom, from two values on, and
    Grubbs' critical value, from three."""
    if n < 2:
        return (None,) * 4
    crit = None
    if n >= 3:
        t = t_quantile(1 - alpha / (2 * n), n - 2)
        crit = (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))
    return t_quantile(1 - alpha / 2, n - 1), chi2_quantile(1 - alpha / 2, n - 1), chi2_quantile(alpha / 2, n - 1), crit


def with_quantiles(rows: DataFrame, n: str = "n", alpha: float = 0.05) -> DataFrame:
    """The rows with t, chi_lo, chi_hi and g_crit for their sample sizes."""

    @F.pandas_udf(_KIND)
    def of(size: pd.Series) -> pd.DataFrame:
        known = {int(k): quantile_row(int(k), alpha) for k in size.dropna().unique()}
        return pd.DataFrame([known.get(k, (None,) * 4) for k in size], columns=["t", "chi_lo", "chi_hi", "g_crit"], dtype=float)

    q: Column = of(F.col(n).cast("long"))
    return rows.withColumn("quantiles", q).select(*rows.columns, "quantiles.*")
