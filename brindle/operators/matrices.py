"""Matrices that are tall tables: sums of products in one pass, decompositions of the small square matrix that is left.

Rows stay where they are; what comes to the driver is columns x columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The transpose times the matrix."""
    x = [F.col(c).cast("double") for c in columns]
    k = len(x)
    r = df.agg(*[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return np.array([[r[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])


def times(df: DataFrame, columns: list[str], matrix: np.ndarray, names: list[str]) -> DataFrame:
    """The table times a small matrix: a column for each of its columns."""
    return df.withColumns({n: sum((F.col(c).cast("double") * F.lit(float(matrix[i, j])) for i, c in enumerate(columns)), F.lit(0.0)) for j, n in enumerate(names)})


def transpose_times(df: DataFrame, columns: list[str], vector: str) -> np.ndarray:
    r = df.agg(*[F.sum(F.col(c).cast("double") * F.col(vector)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return np.array([r[f"v{i}"] or 0.0 for i in range(len(columns))])


def cholesky(a: np.ndarray) -> np.ndarray:
    """The lower triangle whose product with its transpose is a symmetric positive matrix; else an error."""
    a = np.asarray(a, float)
    if not np.allclose(a, a.T, atol=1e-9 * max(1.0, np.abs(a).max(initial=0))):
        raise ValueError("the matrix is not symmetric")
    return np.linalg.cholesky(a)


def triangle(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The upper triangle of the tall table's orthogonal decomposition, its diagonal positive."""
    return cholesky(gram(df, columns)).T


def orthogonal(df: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """The table with the columns of the orthogonal factor."""
    return times(df, columns, np.linalg.inv(triangle(df, columns)), names)


def singular_values(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Singular values from the largest, and right singular vectors as columns (largest entry positive)."""
    values, vectors = np.linalg.eigh(gram(df, columns))
    order = np.argsort(values)[::-1]
    vectors = vectors[:, order]
    return np.sqrt(np.maximum(values[order], 0)), vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(columns))])


def rank(df: DataFrame, columns: list[str]) -> int:
    s = singular_values(df, columns)[0]
    return int((s > s.max(initial=0) * 1e-8).sum())


def condition(df: DataFrame, columns: list[str]) -> float:
    s = singular_values(df, columns)[0]
    return float(s[0] / s[-1]) if s[-1] > 0 else float("inf")


def least_squares(df: DataFrame, columns: list[str], y: str) -> np.ndarray:
    """Coefficients without an intercept, through the triangle."""
    r = triangle(df, columns)
    return np.linalg.solve(r, np.linalg.solve(r.T, transpose_times(df, columns, y)))


def lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Lower (ones on the diagonal), upper and the order of rows, by the largest pivot of each column."""
    u = np.array(a, float)
    n = len(u)
    low, order = np.eye(n), list(range(n))
    for k in range(min(u.shape)):
        p = k + int(np.abs(u[k:, k]).argmax())
        if p != k:
            u[[k, p]], order[k], order[p] = u[[p, k]], order[p], order[k]
            low[[k, p], :k] = low[[p, k], :k]
        if u[k, k] != 0:
            for i in range(k + 1, n):
                low[i, k] = u[i, k] / u[k, k]
                u[i, k:] -= low[i, k] * u[k, k:]
                u[i, k] = 0.0
    return low, u, order


def determinant(a: np.ndarray) -> float:
    _, u, order = lu(a)
    swaps = sum(1 for i, x in enumerate(order) for y in order[i + 1 :] if x > y)
    return float((-1) ** swaps * np.prod(np.diag(u)))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and vectors of a symmetric matrix from the largest value."""
    values, vectors = np.linalg.eigh(np.asarray(a, float))
    return values[::-1], vectors[:, ::-1]


def minimise(df: DataFrame, loss: Callable[[list[float]], tuple[Column, list[Column]]], start: list[float], low: list[float] | None = None, high: list[float] | None = None, rounds: int = 50, tolerance: float = 1e-6) -> tuple[list[float], float]:
    """Parameters that minimise a sum over rows, within bounds, by quasi-Newton steps: ``loss`` gives a row's value and
    derivatives as columns, and every evaluation is one aggregation."""
    n = len(start)
    low, high = np.array(low if low is not None else [-np.inf] * n), np.array(high if high is not None else [np.inf] * n)

    def at(x: np.ndarray) -> tuple[float, np.ndarray]:
        value, parts = loss([float(v) for v in x])
        r = df.agg(F.sum(value).alias("v"), *[F.sum(p).alias(f"d{i}") for i, p in enumerate(parts)]).first()
        return float(r["v"] or 0.0), np.array([float(r[f"d{i}"] or 0.0) for i in range(n)])

    x, h = np.clip(np.array(start, float), low, high), np.eye(n)
    value, g = at(x)
    h /= max(1.0, np.linalg.norm(g))
    for _ in range(rounds):
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if not free.any() or np.abs(g[free]).max() < tolerance * max(1.0, abs(value)):
            break
        step = np.where(free, -(h @ np.where(free, g, 0)), 0)
        if step @ g >= 0:
            step, h = np.where(free, -g, 0), np.eye(n) / max(1.0, np.linalg.norm(g))
        size = 1.0
        for _ in range(30):
            new = np.clip(x + size * step, low, high)
            v, d = at(new)
            if v <= value + 1e-4 * (new - x) @ g:
                break
            size /= 2
        s, y = new - x, d - g
        if np.abs(s).max(initial=0) < 1e-12:
            break
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            h = (np.eye(n) - r * np.outer(s, y)) @ h @ (np.eye(n) - r * np.outer(y, s)) + r * np.outer(s, s)
        x, value, g = new, v, d
    return [float(v) for v in x], value
