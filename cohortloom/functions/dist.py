"""Distribution functions on the driver, and the normal ones as Columns."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

normal_cdf = NormalDist().cdf
normal_quantile = NormalDist().inv_cdf


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees >= x), by the series or the continued fraction of the incomplete gamma function."""
    if df <= 0 or x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_quantile_1(p: float) -> float:
    """Quantile of the chi-square distribution with one degree."""
    return normal_quantile(0.5 + p / 2) ** 2


def normal_pdf_col(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


#: Chebyshev coefficients of erfc (relative error under 1.2e-7), constant term first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_cdf_col(x: Column) -> Column:
    """The normal distribution function without leaving the JVM."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + z / 2)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + c
    tail = t * F.exp(-z * z + poly) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)
