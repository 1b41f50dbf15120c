"""Measures of contingency tables and distributions, on arrays of counts as numpy and on tail probabilities."""

from __future__ import annotations

import math

import numpy as np

from .measures import incomplete_beta


def _fine(table) -> np.ndarray:
    t = np.asarray(table, float)
    return t[t.sum(axis=1) > 0][:, t.sum(axis=0) > 0]


def reduced(table) -> np.ndarray:
    """The table without empty rows and columns."""
    return _fine(table)


def expected(table) -> np.ndarray:
    t = _fine(table)
    return np.outer(t.sum(axis=1), t.sum(axis=0)) / t.sum()


def chi_squared(table, yates: bool = False) -> float:
    """Pearson's statistic; with ``yates`` differences are a half less for 2 x 2 tables."""
    t = _fine(table)
    if min(t.shape) < 2:
        return 0.0
    e = expected(t)
    d = np.abs(t - e) - (0.5 if yates and t.shape == (2, 2) else 0.0)
    return float((np.maximum(d, 0) ** 2 / e).sum())


def cochran(table) -> bool:
    """Whether expected counts allow the statistic: all above 1, and at most a fifth below 5."""
    e = expected(table)
    return bool((e > 1).all() and (e < 5).mean() <= 0.2)


def cramers_v(table) -> float:
    t = _fine(table)
    k = min(t.shape) - 1
    return math.sqrt(chi_squared(t) / (t.sum() * k)) if k > 0 else 0.0


def _h(x: np.ndarray) -> float:
    p = x[x > 0] / x.sum()
    return float(-(p * np.log2(p)).sum()) if len(p) else 0.0


def entropy_rows(table) -> float:
    return _h(np.asarray(table, float).sum(axis=1))


def entropy_columns(table) -> float:
    return _h(np.asarray(table, float).sum(axis=0))


def conditional_on_rows(table) -> float:
    """Entropy of the column given the row."""
    t = np.asarray(table, float)
    return float(sum(r.sum() * _h(r) for r in t if r.sum()) / t.sum())


def conditional_on_columns(table) -> float:
    return conditional_on_rows(np.asarray(table, float).T)


def gain_ratio(table) -> float:
    """What the rows tell about the columns, by the entropy of the rows; 0 where that is 0."""
    split = entropy_rows(table)
    return (entropy_columns(table) - conditional_on_rows(table)) / split if split > 1e-12 else 0.0


def symmetrical_uncertainty(table) -> float:
    both = entropy_rows(table) + entropy_columns(table)
    return 2 * (entropy_columns(table) - conditional_on_rows(table)) / both if both > 1e-12 else 0.0


def tau(table) -> float:
    """Goodman and Kruskal's measure: how far the rows lower the chance of a wrong column."""
    t = np.asarray(table, float)
    n = t.sum()
    before = 1 - ((t.sum(axis=0) / n) ** 2).sum()
    after = sum(r.sum() / n * (1 - ((r / r.sum()) ** 2).sum()) for r in t if r.sum())
    return float((before - after) / before) if before > 1e-12 else 0.0


def incomplete_gamma(a: float, x: float) -> float:
    """The lower regularised function, by its series or its continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= x / k
            total += term
        return front * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b if abs(an * d + b) > tiny else tiny)
        c = b + an / c if abs(b + an / c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def chi_squared_tail(x: float, freedom: int) -> float:
    return 1 - incomplete_gamma(freedom / 2, x / 2) if x > 0 else 1.0


def f_tail(f: float, a: int, b: int) -> float:
    return incomplete_beta(b / 2, a / 2, b / (b + a * f)) if f > 0 else 1.0


def normal_quantile(p: float) -> float:
    """The inverse of the normal distribution function, by halving and Newton steps."""
    if not 0 < p < 1:
        raise ValueError("a probability between 0 and 1 is needed")
    low, high = -40.0, 40.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if 0.5 * math.erfc(-x / math.sqrt(2)) < p else (low, x)
    return (low + high) / 2


def ln_binomial(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
