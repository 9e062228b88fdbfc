"""Tail probabilities as Arrow-batched column functions (neither Spark nor this box has them built in)."""

from __future__ import annotations

from math import erf, lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma, _erf = np.vectorize(lgamma, otypes=[float]), np.vectorize(erf, otypes=[float])


def normal_cdf(z):
    return 0.5 * (1 + _erf(np.asarray(z, float) / np.sqrt(2)))


def beta_cdf(x, a, b):
    """The regularised incomplete beta function by Lentz's continued fraction."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    x = np.clip(x, 0, 1)
    swap = x > (a + 1) / (a + b + 2)
    x1, a1, b1 = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a1 * np.log(np.maximum(x1, tiny)) + b1 * np.log1p(-np.minimum(x1, 1 - 1e-16)) + _lgamma(a1 + b1) - _lgamma(a1) - _lgamma(b1)) / a1
        c, d = np.ones_like(x1), 1 - (a1 + b1) * x1 / (a1 + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for step in (m * (b1 - m) * x1 / ((a1 + 2 * m - 1) * (a1 + 2 * m)), -(a1 + m) * (a1 + b1 + m) * x1 / ((a1 + 2 * m) * (a1 + 2 * m + 1))):
                d, c = 1 + step * d, 1 + step / c
                d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-14):
                break
    out = np.where(x1 <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def gamma_cdf(x, a):
    """The regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    x, a = np.broadcast_arrays(np.asarray(x, float), np.asarray(a, float))
    safe = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(safe) - safe - _lgamma(a))
    term = total = 1 / a
    for n in range(1, 1000):
        term = term * safe / (a + n)
        total = total + term
        if np.all(np.abs(term) < 1e-15 * np.abs(total)):
            break
    b = safe + 1 - a
    c, d = np.full_like(safe, 1e300), 1 / np.where(np.abs(b) < 1e-300, 1e-300, b)
    h = d
    for n in range(1, 1000):
        an, b = -n * (n - a), b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return np.where(x <= 0, 0.0, np.where(x < a + 1, front * total, 1 - front * h))


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def f_upper(f, d1, d2):
    f = np.maximum(np.asarray(f, float), 0)
    return beta_cdf(d2 / (d2 + d1 * f), np.asarray(d2, float) / 2, np.asarray(d1, float) / 2)


def chi2_upper(x, df):
    return 1 - gamma_cdf(np.asarray(x, float) / 2, np.asarray(df, float) / 2)


def _of(series: pd.Series, value) -> pd.Series:
    return pd.Series(value, index=series.index, dtype=float).where(series.notna())


@F.pandas_udf(DoubleType())
def p_normal(z: pd.Series) -> pd.Series:
    """Two-sided."""
    return _of(z, 2 * (1 - normal_cdf(z.abs().fillna(0))))


@F.pandas_udf(DoubleType())
def p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided."""
    return _of(t, t_two_sided(t.fillna(0), df.clip(lower=1).fillna(1)))


@F.pandas_udf(DoubleType())
def p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _of(f, f_upper(f.fillna(0), d1.fillna(1), d2.clip(lower=1).fillna(1)))


@F.pandas_udf(DoubleType())
def p_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _of(x, chi2_upper(x.fillna(0), df.clip(lower=1).fillna(1)))
