"""Univariate and conditional estimators, and local scores of a Bayes network, as aggregations of counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import xlogx


def discrete(df: DataFrame, column: str, laplace: bool = True) -> DataFrame:
    """value, probability; with ``laplace`` one is added to each count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).count()
    total = counts.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k"))
    add = 1 if laplace else 0
    return counts.join(F.broadcast(total)).select("value", F.round((F.col("count") + add) / (F.col("n") + add * F.col("k")), 8).alias("probability"))


def conditional_discrete(df: DataFrame, column: str, given: str) -> DataFrame:
    """given, value, probability with one added to each count of a value that the column takes."""
    both = df.where(F.col(column).isNotNull() & F.col(given).isNotNull()).groupBy(F.col(given).alias("given"), F.col(column).alias("value")).count()
    k = both.agg(F.count_distinct("value").alias("k"))
    total = both.groupBy("given").agg(F.sum("count").alias("n"))
    return both.join(total, "given").join(F.broadcast(k)).select("given", "value", F.round((F.col("count") + 1) / (F.col("n") + F.col("k")), 8).alias("probability"))


def normal(df: DataFrame, column: str, precision: float) -> DataFrame:
    """mean and deviation of values rounded to ``precision``; the deviation is a sixth of it at least."""
    x = F.round(F.col(column) / precision) * precision
    return df.where(F.col(column).isNotNull()).agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.greatest(F.stddev_pop(x), F.lit(precision / 6)), 6).alias("deviation"))


def poisson(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).agg(F.round(F.avg(column), 8).alias("rate"))


def kernel(df: DataFrame, column: str, points: list[float], width: float) -> DataFrame:
    """point, density: a Gaussian kernel on every value, at a given list of points, in one pass."""
    x = F.col(column).cast("double")
    scale = 1 / (width * math.sqrt(2 * math.pi))
    cells = F.array(*[F.struct(F.lit(float(p)).alias("point"), (F.avg(F.exp(-F.pow((x - p) / width, F.lit(2.0)) / 2)) * scale).alias("density")) for p in points])
    return df.where(x.isNotNull()).agg(cells.alias("c")).select(F.explode("c").alias("x")).select("x.point", F.round("x.density", 8).alias("density"))


def local_score(df: DataFrame, node: str, parents: list[str]) -> DataFrame:
    """entropy, aic and mdl scores (log base e) of a node given its parents, larger is better for the last two."""
    counts = df.groupBy(*parents, node).count()
    by_parents = counts.groupBy(*parents).agg(F.sum("count").alias("t"), F.sum(xlogx(F.col("count"))).alias("s")) if parents else counts.agg(F.sum("count").alias("t"), F.sum(xlogx(F.col("count"))).alias("s"))
    ln2 = math.log(2)
    one = by_parents.agg((F.sum(F.col("s") - xlogx(F.col("t"))) * ln2).alias("ll"), F.sum("t").alias("n"), F.count(F.lit(1)).alias("q"))
    k = counts.agg(F.count_distinct(node).alias("k"))
    free = F.col("q") * (F.col("k") - 1)
    return one.join(F.broadcast(k)).select(F.round(F.col("ll"), 4).alias("entropy"), F.round(F.col("ll") - free, 4).alias("aic"), F.round(F.col("ll") - free * F.log(F.col("n").cast("double")) / 2, 4).alias("mdl"))


def k2(df: DataFrame, order: list[str], most_parents: int = 2) -> list[tuple[str, list[str]]]:
    """Greedy parents for each node among those before it, while the mdl score rises."""
    out = []
    for i, node in enumerate(order):
        parents: list[str] = []
        best = local_score(df, node, []).first()["mdl"]
        while len(parents) < most_parents:
            tries = [(local_score(df, node, [*parents, p]).first()["mdl"], -j, p) for j, p in enumerate(order[:i]) if p not in parents]
            if not tries or max(tries)[0] <= best + 1e-9:
                break
            best, _, p = max(tries)
            parents.append(p)
        out.append((node, parents))
    return out


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, correlation of every pair of columns, in one pass."""
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r")) for i, a in enumerate(columns) for b in columns[i + 1 :]])
    return df.agg(cells.alias("c")).select(F.explode("c").alias("x")).select("x.a", "x.b", F.round("x.r", 6).alias("correlation"))


def principal_components(df: DataFrame, columns: list[str], variance: float = 0.95) -> tuple[list[float], list[list[float]]]:
    """Eigenvalues and vectors of the correlation matrix up to a share of the variance."""
    import numpy as np

    r = np.eye(len(columns))
    for row in correlations(df, columns).collect():
        i, j = columns.index(row["a"]), columns.index(row["b"])
        r[i, j] = r[j, i] = row["correlation"] or 0.0
    values, vectors = np.linalg.eigh(r)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), variance - 1e-12)) + 1
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(columns))])
    return values[:k].tolist(), (vectors * signs)[:, :k].T.tolist()
