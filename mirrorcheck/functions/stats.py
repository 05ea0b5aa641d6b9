"""Scalar tails of the normal, chi-square and Kolmogorov laws, as Python numbers and as columns."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def critical_value(level: float) -> float:
    """Two-sided normal critical value; the level must lie in [0.5, 1)."""
    if not isinstance(level, (int, float)) or math.isnan(level) or not 0.5 <= level < 1:
        raise ValueError("level must be one number in [0.5, 1)")
    return normal_quantile(0.5 * (1 + level))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi_square_tail(x: float, df: float) -> float:
    """Upper tail of the chi-square law: series for small x, continued fraction otherwise."""
    if df <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1.0 - total * scale)
    b = z + 1.0 - a
    c = 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        step = d * c
        h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return scale * h


def kolmogorov_tail(lam: Column, terms: int = 60) -> Column:
    """Asymptotic two-sided Kolmogorov p-value as a column expression.

    The alternating series is used from lam = 0.5 on; below it the p-value differs
    from one by less than 1e-4 and the theta-function form is used.
    """
    square = lam * lam
    alternating = F.lit(0.0)
    for k in range(1, terms + 1):
        alternating = alternating + F.lit(2.0 if k % 2 else -2.0) * F.exp(F.lit(-2.0 * k * k) * square)
    theta = F.lit(0.0)
    for k in range(1, 6):
        theta = theta + F.exp(F.lit(-((2 * k - 1) ** 2) * math.pi ** 2 / 8.0) / square)
    small = F.lit(1.0) - F.lit(math.sqrt(2.0 * math.pi)) / lam * theta
    return F.when(lam <= 0, F.lit(1.0)).when(lam < 0.5, small).otherwise(alternating)
