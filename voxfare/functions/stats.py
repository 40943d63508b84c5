"""Tail probabilities and quantiles for the few rows of a finished test table.

The tests themselves run as Spark aggregates; only their one-row-per-test results pass through these
functions, in Arrow batches.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    floor = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > floor else floor)
    total = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > floor else floor)
            c = c if abs(c) > floor else floor
            step = c * d
            total *= step
        if abs(step - 1.0) < 1e-15:
            break
    return total


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the two-sided tail; ``p`` above one half."""
    tail = 2.0 * (1.0 - p)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > tail:
        high *= 2.0
    for _ in range(200):
        mid = (low + high) / 2.0
        if mid in (low, high):
            break
        if t_two_sided(mid, df) > tail:
            low = mid
        else:
            high = mid
    return (low + high) / 2.0


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def chi2_upper(x: float, df: float) -> float:
    """Upper tail of chi-squared through the incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    if df == 1:
        return math.erfc(math.sqrt(x / 2.0))
    a, y = df / 2.0, x / 2.0
    log_front = a * math.log(y) - y - math.lgamma(a)
    if y < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= y / n
            total += term
        return 1.0 - total * math.exp(log_front)
    b = y + 1.0 - a
    c, d = 1e300, 1.0 / b
    total = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b)
        c = b + num / c
        step = c * d
        total *= step
        if abs(step - 1.0) < 1e-15:
            break
    return total * math.exp(log_front)


def _rowwise(fn, *series: pd.Series) -> pd.Series:
    values = [
        float(fn(*args)) if all(a is not None and np.isfinite(a) for a in args) else None
        for args in zip(*(s.to_numpy(dtype="float64", na_value=np.nan) for s in series))
    ]
    return pd.Series(values, dtype="float64")


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def _t_q(p: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(t_quantile, p, df)


@F.pandas_udf(DoubleType())
def _z_p(z: pd.Series) -> pd.Series:
    return _rowwise(normal_upper, z)


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(chi2_upper, x, df)


def t_pvalue(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic."""
    return _t_p(t.cast("double"), df.cast("double"))


def t_critical(confidence: float, df: Column) -> Column:
    """Half-width factor of a two-sided interval."""
    return _t_q(F.lit((1.0 + confidence) / 2.0), df.cast("double"))


def normal_pvalue(z: Column) -> Column:
    """Upper-tail p-value of a z statistic."""
    return _z_p(z.cast("double"))


def chi2_pvalue(x: Column, df: Column) -> Column:
    return _chi2_p(x.cast("double"), df.cast("double"))


def stars(p: Column) -> Column:
    """Significance marks."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def effect_label(d: Column) -> Column:
    """Verbal size of a standardised difference."""
    size = F.abs(d)
    return (
        F.when(size >= 0.8, "Large")
        .when(size >= 0.5, "Medium")
        .when(size >= 0.2, "Small")
        .when(size.isNotNull(), "Negligible")
    )


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W statistic and p-value by Royston's 1995 approximation, for samples of 3 to 5,000 values; exact for 3.

    Fewer or all equal values give NaN.
    """
    x = np.sort(np.asarray(x, dtype="float64"))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return float("nan"), float("nan")
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssq = float(m @ m)
    u = 1.0 / math.sqrt(n)
    last = m[-1] / math.sqrt(ssq) + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    elif n <= 5:  # only the outer weights are fitted
        a = m / math.sqrt((ssq - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
    else:
        prev = m[-2] / math.sqrt(ssq) + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
        a = m / math.sqrt((ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2))
        a[-1], a[-2], a[0], a[1] = last, prev, -last, -prev
    centred = x - x.mean()
    w = min(1.0, float((a @ x) ** 2 / (centred @ centred)))
    if n == 3:
        return w, min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w == 1.0:
        return w, 1.0
    if n <= 11:  # fitted constants of the small samples
        limit = 0.459 * n - 2.273
        if math.log1p(-w) >= limit:
            return w, 0.0
        y = -math.log(limit - math.log1p(-w))
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y = math.log1p(-w)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], math.log(n))
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], math.log(n)))
    return w, normal_upper((y - mu) / sigma)
