"""Statistics of counts as Column expressions over grouped data, all with built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def xlogx(x: Column) -> Column:
    """x log2 x, 0 at 0."""
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def weighted_mean(x: str, w: str | None = None) -> Column:
    """Mean over rows where ``x`` is not null; 0 if there is none."""
    if w is None:
        return F.coalesce(F.avg(x), F.lit(0.0))
    weight = F.when(F.col(x).isNotNull(), F.col(w))
    return F.coalesce(F.sum(F.col(x) * F.col(w)) / F.sum(weight), F.lit(0.0))


def weighted_variance(x: str, w: str) -> Column:
    """Sample variance with weights; 0 if the weights sum to 1 or less, or where rounding makes it negative."""
    weight = F.when(F.col(x).isNotNull(), F.col(w))
    total, one, two = F.sum(weight), F.sum(F.col(x) * F.col(w)), F.sum(F.col(x) * F.col(x) * F.col(w))
    return F.when(total > 1, F.greatest((two - one * one / total) / (total - 1), F.lit(0.0))).otherwise(F.lit(0.0))


def laplacian(distance: Column) -> Column:
    return 1 / (1 + distance)


def exponential(distance: Column) -> Column:
    return F.exp(-distance)


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / (c if abs(c) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, freedom: int) -> float:
    """Probability of a larger absolute t by chance."""
    return 1.0 if freedom < 1 else incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def ln_factorial(n: float) -> float:
    return math.lgamma(n + 1)
