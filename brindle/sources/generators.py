"""Synthetic tables: rows labelled by a decision list, and Gaussian clusters on a grid."""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decision_list(spark: SparkSession, rows: int, attributes: int = 10, classes: int = 2, rules: int = 6, seed: int = 1) -> DataFrame:
    """Boolean attributes a1.. and a class from the first rule that holds (the last class if none)."""
    rng = random.Random(seed)
    df = spark.range(rows).select("id", *[(F.rand(seed * 1000 + i) < 0.5).alias(f"a{i + 1}") for i in range(attributes)])
    label = F.lit(f"c{classes}")
    for r in range(rules):
        tests = [(F.col(f"a{i + 1}") == bool(rng.getrandbits(1))) for i in rng.sample(range(attributes), rng.randint(1, 3))]
        both = tests[0]
        for t in tests[1:]:
            both = both & t
        label = F.when(both, F.lit(f"c{r % classes + 1}")).otherwise(label)
    return df.withColumn("class", label)


def grid_clusters(spark: SparkSession, clusters: int, rows: int, radius: float = 1.0, distance: float = 4.0, dimensions: int = 2, seed: int = 1) -> DataFrame:
    """rows for each cluster, normal around the points of a grid."""
    side = max(1, round(clusters ** (1 / dimensions) + 0.499))
    c = F.floor(F.col("id") / rows).cast("int")
    df = spark.range(clusters * rows).withColumn("cluster", c)
    return df.select("cluster", *[(F.floor(F.col("cluster") / side**i) % side * distance + F.randn(seed * 100 + i) * radius).alias(f"x{i + 1}") for i in range(dimensions)])


@dataclass(frozen=True)
class Test:
    """One test of a generated rule: a column against a value by =, !=, <, <=, > or >=."""

    column: str
    operator: str
    value: object

    def predicate(self) -> Column:
        c, v = F.col(self.column), F.lit(self.value)
        made = {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[self.operator]
        return F.coalesce(made, F.lit(False))


def rule(tests: list[Test]) -> Column:
    """Whether all tests hold; missing values fail."""
    out = F.lit(True)
    for t in tests:
        out = out & t.predicate()
    return out
