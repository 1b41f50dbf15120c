"""Clusterers: k-means with fixed starts, farthest-first centres, cluster summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import cut
from .transforms import ranges_of


def nearest(df: DataFrame, columns: list[str], centres: list[tuple[float, ...]], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """``df`` with the index of the nearest centre (first on ties) and the squared distance on the min-max scale."""
    def distance(centre: tuple[float, ...]):
        total = F.lit(0.0)
        for c, x in zip(columns, centre):
            a, z = bounds[c]
            d = (F.col(c).cast("double") - F.lit(float(x))) / F.lit(float(z - a) if a is not None and z > a else 1.0)
            total = total + d * d
        return total

    best = F.array_min(F.array(*[F.struct(distance(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    return df.withColumn("_b", best).withColumn("cluster", F.col("_b.i")).withColumn("squared", F.col("_b.d")).drop("_b")


def k_means(df: DataFrame, columns: list[str], k: int, key: str, rounds: int = 10) -> tuple[DataFrame, list[tuple[float, ...]]]:
    """Lloyd's rounds from the k rows of smallest hashed key; each round is one aggregation of k rows."""
    data = cut(df.dropna(subset=columns))
    bounds = ranges_of(data, columns)
    start = data.orderBy(F.md5(F.col(key).cast("string")), key).select(*columns).limit(k).collect()
    centres = [tuple(float(x) for x in r) for r in start]
    for _ in range(rounds):
        means = nearest(data, columns, centres, bounds).groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns]).collect()
        new = list(centres)
        for r in means:
            new[r["cluster"]] = tuple(r[c] for c in columns)
        if all(abs(x - y) < 1e-12 for a, b in zip(new, centres) for x, y in zip(a, b)):
            break
        centres = new
    return nearest(data, columns, centres, bounds), centres


def farthest_first(df: DataFrame, columns: list[str], k: int, key: str) -> list[tuple[float, ...]]:
    """Centres: the row of smallest key, then k - 1 times the row farthest from all centres (smallest key on ties)."""
    data = cut(df.dropna(subset=columns))
    bounds = ranges_of(data, columns)
    row = data.agg(F.min_by(F.struct(*columns), key)).first()[0]
    centres = [tuple(float(x) for x in row)]
    while len(centres) < k:
        row = nearest(data, columns, centres, bounds).agg(F.min_by(F.struct(*columns), F.struct(-F.col("squared"), F.col(key)))).first()[0]
        centres.append(tuple(float(x) for x in row))
    return centres
