"""Tail probabilities for the test statistics (t, chi-square, normal).

SciPy is not available on the executors, so the published continued-fraction
and series expansions of the regularised incomplete beta / gamma functions are
used.  They are applied through Arrow-batched pandas UDFs to one-row
statistic frames; all heavy lifting (ranks, counts, sums) runs in Spark.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_EPS = 1e-15
_TINY = 1e-300


def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    cc, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 500):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        cc = 1.0 + aa / cc if abs(1.0 + aa / cc) > _TINY else _TINY
        h *= d * cc
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        cc = 1.0 + aa / cc if abs(1.0 + aa / cc) > _TINY else _TINY
        de = d * cc
        h *= de
        if abs(de - 1.0) < _EPS:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def gammainc_upper_reg(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * _EPS:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - gln))
    b = x + 1.0 - a
    cc, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        cc = b + an / cc
        cc = _TINY if abs(cc) < _TINY else cc
        d = 1.0 / d
        de = d * cc
        h *= de
        if abs(de - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or df <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


def chi2_sf(x: float, df: float) -> float:
    if x is None or df is None or df <= 0 or math.isnan(x):
        return float("nan")
    return gammainc_upper_reg(df / 2.0, x / 2.0)


def norm_sf(z: float) -> float:
    if z is None or math.isnan(z):
        return float("nan")
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _vec(fn, *series):
    return pd.Series([fn(*(None if pd.isna(v) else float(v) for v in vals))
                      for vals in zip(*series)], dtype="float64")


@F.pandas_udf(DoubleType())
def _t_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(t_two_sided_p, t, df)


@F.pandas_udf(DoubleType())
def _chi2_p_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _vec(chi2_sf, x, df)


@F.pandas_udf(DoubleType())
def _norm_sf_udf(z: pd.Series) -> pd.Series:
    return _vec(norm_sf, z)


def t_test_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of a Student t statistic."""
    return _t_p_udf(t.cast("double"), df.cast("double"))


def chi2_p(x: Column, df: Column) -> Column:
    return _chi2_p_udf(x.cast("double"), df.cast("double"))


def normal_sf(z: Column) -> Column:
    return _norm_sf_udf(z.cast("double"))
