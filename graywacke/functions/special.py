"""Distribution functions in numpy, and as Arrow functions for columns: meant for aggregated rows, of which there are few."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def log_gamma(x) -> np.ndarray:
    """A function, as tasks get it by its name: what np.vectorize returns can't be sent to them once it has been called."""
    return np.vectorize(math.lgamma, otypes=[float])(x)


def beta_inc(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function, by Lentz's continued fraction on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.clip(np.where(flip, 1 - x, x), 0, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < 1e-300, 1e-300, 1 - (a + b) * x / (a + 1))
        total = d.copy()
        for m in range(1, 2000):
            for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + n * d, 1 + n / c
                d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                total = total * d * c
            if np.all(np.abs(d * c - 1) < 1e-16):
                break
        value = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * total))
    return np.where(flip, 1 - value, value)


def gamma_inc(a, x) -> np.ndarray:
    """The regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    def one(a: float, x: float) -> float:
        if not x > 0:
            return 0.0 if x == 0 else math.nan
        front = math.exp(a * math.log(x) - x - math.lgamma(a))
        if x < a + 1:
            term = total = 1 / a
            n = a
            while term > total * 1e-17:
                n += 1
                term *= x / n
                total += term
            return front * total
        b, c = x + 1 - a, 1e300
        d = h = 1 / b
        for i in range(1, 10_000):
            n = -i * (i - a)
            b += 2
            d, c = 1 / (n * d + b), b + n / c
            h *= d * c
            if abs(d * c - 1) < 1e-16:
                break
        return 1 - front * h

    return np.vectorize(one, otypes=[float])(a, x)


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x, k) -> np.ndarray:
    return 1 - gamma_inc(np.asarray(k, float) / 2, np.asarray(x, float) / 2)


def normal_two_sided(z) -> np.ndarray:
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=[float])(z)


def normal_quantile(p: float) -> float:
    return _invert(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), p, -40.0, 40.0)


def t_quantile(p: float, df: float) -> float:
    upper = lambda t: float(t_two_sided(t, df)) / 2
    return _invert(lambda t: 1 - upper(t) if t >= 0 else upper(t), p, -1e4, 1e4)


def _invert(cdf, p: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def noncentral_t_upper(t: float, df: float, shift: float) -> float:
    """P(T > t) of the noncentral t, t > 0: a Poisson mixture of incomplete betas (Lenth, 1989)."""
    x, half = t * t / (t * t + df), shift * shift / 2
    j = np.arange(0, int(half + 20 * math.sqrt(half + 1)) + 60)
    weight = np.exp(-half + j * math.log(half) - log_gamma(j + 1)) if half else np.where(j == 0, 1.0, 0.0)
    odd = shift / math.sqrt(2) * (np.exp(-half + j * math.log(half) - log_gamma(j + 1.5)) if half else np.where(j == 0, 1 / math.gamma(1.5), 0.0))
    below = 0.5 * math.erfc(shift / math.sqrt(2)) + 0.5 * float((weight * beta_inc(j + 0.5, df / 2, x) + odd * beta_inc(j + 1, df / 2, x)).sum())
    return 1 - below


def _positive(degrees: pd.Series) -> pd.Series:
    """Degrees of freedom; none, where there are none left."""
    degrees = degrees.astype(float)
    return degrees.where(degrees > 0)


@F.pandas_udf(DoubleType())
def p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a t statistic."""
    return pd.Series(t_two_sided(t.astype(float), _positive(df)))


@F.pandas_udf(DoubleType())
def p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f.astype(float), _positive(d1), _positive(d2)))


@F.pandas_udf(DoubleType())
def p_chi2(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper(x.astype(float), _positive(k)))


@F.pandas_udf(DoubleType())
def p_z(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z.astype(float)))
