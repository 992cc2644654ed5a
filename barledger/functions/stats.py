"""Aggregate expressions with the numeric conventions of the analytics.

All are native, partially aggregable expressions: a hot group is reduced map-side first.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den``; a zero or missing denominator gives ``default``."""
    out = F.try_divide(num, den)
    return out if default is None else F.coalesce(out, F.lit(default))


def positive_ratio(num: Column, den: Column, default: float = 0.0) -> Column:
    return F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(default))


def compound(ret: Column) -> Column:
    """Product of (1 + r) minus one; 0 on an empty group."""
    return F.coalesce(F.product(1 + ret), F.lit(1.0)) - 1


def mean_where(value: Column, cond: Column, default: float | None = 0.0) -> Column:
    out = F.avg(F.when(cond, value))
    return out if default is None else F.coalesce(out, F.lit(default))


def sum_where(value: Column, cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness (G1); NULL below three values, 0 without variance."""
    n = F.count(x)
    g1 = F.try_divide(F.skewness(x) * F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.coalesce(F.nanvl(g1, F.lit(0.0)), F.lit(0.0)))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis (G2); NULL below four values, 0 without variance."""
    n = F.count(x)
    g2 = F.try_divide(((n + 1) * F.kurtosis(x) + 6) * (n - 1), (n - 2) * (n - 3))
    flat = F.coalesce(F.stddev_pop(x), F.lit(0.0)) == 0
    return F.when(n >= 4, F.when(flat, F.lit(0.0)).otherwise(g2))


def annualised(total: Column, n: Column, periods: int) -> Column:
    return F.pow(1 + total, F.try_divide(F.lit(float(periods)), n)) - 1


def annual_vol(ret: Column, periods: int) -> Column:
    return F.stddev_samp(ret) * F.sqrt(F.lit(float(periods)))


def sharpe(mean: Column, vol: Column, periods: int, risk_free: float = 0.0) -> Column:
    return positive_ratio(mean * periods - risk_free, vol)
