"""Distribution functions, vectorised in NumPy: incomplete beta and gamma, and t and chi-squared quantiles by bisection."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1)[np.isfinite(h)] < 1e-15):
                break
        got = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(flip, 1 - got, got)


def gammainc(a, x) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, x))
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - _lgamma(a))
        term = 1 / a
        total = term.copy()
        for k in range(1, 2000):
            term = term * x / (a + k)
            total = total + term
            if np.all((term < total * 1e-16) | (x > a + 1) | ~np.isfinite(total)):
                break
        low = front * total
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d.copy()
        for k in range(1, 2000):
            num = -k * (k - a)
            b = b + 2
            d = 1 / np.where((v := num * d + b) == 0, 1e-300, v)
            c = np.where((v := b + num / c) == 0, 1e-300, v)
            h = h * d * c
            if np.all((np.abs(d * c - 1) < 1e-15) | (x <= a + 1) | ~np.isfinite(h)):
                break
        high = 1 - front * h
    return np.where(x <= 0, 0.0, np.where(x <= a + 1, low, high))


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(all="ignore"):
        return np.where(np.isinf(t), 0.0, betainc(df / 2, 0.5, df / (df + t * t)))


def _bisect(cdf, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    for _ in range(200):
        mid = (low + high) / 2
        under = cdf(mid) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
        if np.all(high - low <= 1e-14 * np.maximum(1, np.abs(high))):
            break
    return (low + high) / 2


def t_quantile(p: float, df) -> np.ndarray:
    df = np.asarray(df, float)
    upper = max(p, 1 - p)
    got = _bisect(lambda t: 1 - t_two_sided(t, df) / 2, np.full(df.shape, upper), np.zeros(df.shape), np.full(df.shape, 1e8))
    return np.where(df > 0, got if p >= 0.5 else -got, np.nan)


def chi2_quantile(p: float, df) -> np.ndarray:
    df = np.asarray(df, float)
    got = _bisect(lambda x: gammainc(np.maximum(df, 1e-9) / 2, x / 2), np.full(df.shape, p), np.zeros(df.shape), df + 60 * np.sqrt(2 * np.abs(df)) + 200)
    return np.where(df > 0, got, np.nan)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_two_sided(z) -> np.ndarray:
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=[float])(np.asarray(z, float))


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation under normality: by the t distribution with n - 2 degrees of freedom.

    Null for a null correlation; 1 for n = 2; 0 for a correlation of 1 or -1.
    """
    rv, nv = r.to_numpy(float), n.to_numpy(float)
    df = nv - 2
    with np.errstate(all="ignore"):
        t2 = df * rv**2 / (1 - rv**2)
        p = betainc(np.where(df > 0, df, 1) / 2, 0.5, np.where(df > 0, df, 1) / (np.where(df > 0, df, 1) + np.where(np.isfinite(t2), t2, 1)))
    p = np.where(np.abs(rv) >= 1, 0.0, p)
    p = np.where(df == 0, 1.0, np.where(df < 0, np.nan, p))
    out = pd.Series(p)
    return out.where(~np.isnan(rv) & ~np.isnan(p), None)


def _quantile_udf(function, p: float):
    @F.pandas_udf(DoubleType())
    def quantile(df: pd.Series) -> pd.Series:
        got = pd.Series(function(p, df.to_numpy(float)))
        return got.where(got.notna(), None)

    return quantile


def t_quantile_of(p: float, df):
    return _quantile_udf(t_quantile, p)(df)


def chi2_quantile_of(p: float, df):
    return _quantile_udf(chi2_quantile, p)(df)
