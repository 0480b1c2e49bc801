"""Special functions in NumPy, and the tails of distributions as pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def each(f, x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    return np.array([f(v) for v in x.ravel().tolist()], dtype=float).reshape(x.shape)


def lgamma(x: np.ndarray) -> np.ndarray:
    return each(math.lgamma, x)


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    """P(|Z| > |z|)."""
    return each(math.erfc, np.abs(np.asarray(z, dtype=float)) / math.sqrt(2))


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 8 and the asymptotic series."""
    x = np.array(x, dtype=float, ndmin=1)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    r = 1 / x**2
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, dtype=float, ndmin=1)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out[low] += 1 / x[low] ** 2
        x[low] += 1
    r = 1 / x**2
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a+1, Lentz's
    continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(10_000):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= (step := d * c)
        if abs(step - 1) < 1e-16:
            break
    return scale * h


def chi2_sf(x: np.ndarray, df: np.ndarray | float) -> np.ndarray:
    x, df = np.broadcast_arrays(np.asarray(x, dtype=float), np.asarray(df, dtype=float))
    return np.array([1.0 if d <= 0 else gamma_q(d / 2, max(v, 0) / 2) if math.isfinite(v) else (0.0 if v > 0 else math.nan) for v, d in zip(x.ravel(), df.ravel(), strict=True)]).reshape(x.shape)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= (step := d * c)
        if abs(step - 1) < 1e-16:
            break
    return front * h / a


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return np.array([beta_i(d / 2, 0.5, d / (d + v * v)) if math.isfinite(v) and d > 0 else math.nan for v, d in zip(np.asarray(t, float), np.asarray(df, float), strict=True)])


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2x2 table: all tables no likelier than the one seen."""
    row, col, n = a + b, a + c, a + b + c + d
    low, high = max(0, col - (n - row)), min(row, col)
    k = np.arange(low, high + 1)
    logs = lgamma(row + 1) + lgamma(n - row + 1) + lgamma(col + 1) + lgamma(n - col + 1) - lgamma(n + 1) - (lgamma(k + 1) + lgamma(row - k + 1) + lgamma(col - k + 1) + lgamma(n - row - col + k + 1))
    p = np.exp(logs)
    return float(min(1.0, p[p <= p[a - low] * (1 + 1e-7)].sum()))


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(np.where(np.isfinite(z), normal_two_sided(np.nan_to_num(z)), np.nan))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x.to_numpy(), df.to_numpy()))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(), df.to_numpy()))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_exact(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d, strict=True)])
