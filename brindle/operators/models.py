"""What learners share: models that are Column expressions, coded attributes, and counts of all nodes in one pass.

A model never holds rows.  It is an expression over the attributes, so that prediction is a narrow projection inside code
generation, and learning is a loop of aggregations whose results are bounded by nodes x codes x classes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import labels_of

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numeric(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column].split("(")[0] in NUMERIC


@dataclass
class Model:
    """A classifier: ``distribution`` is an array of weights in the order of ``labels`` (they need not sum to one)."""

    labels: list[str]
    distribution: Column

    def probabilities(self) -> Column:
        """Weights that sum to one; equal ones where there is none."""
        flat = F.array(*[F.lit(1.0 / max(1, len(self.labels)))] * len(self.labels))
        total = lambda d: F.aggregate(d, F.lit(0.0), lambda s, x: s + x)
        return let(self.distribution, lambda d: F.when(total(d) > 0, F.transform(d, lambda x: x / total(d))).otherwise(flat))

    def vote(self) -> Column:
        """The label of the largest weight, the first on ties."""
        best = let(self.distribution, lambda d: F.array_min(F.transform(d, lambda x, i: F.named_struct(F.lit("s"), -F.round(x, 12), F.lit("i"), i))))
        return F.array(*[F.lit(x) for x in self.labels])[best["i"]]

    def apply(self, df: DataFrame, out: str = "prediction", distribution: str | None = "distribution") -> DataFrame:
        """Adds the label of the largest probability (the first on ties) and all probabilities."""
        if not self.labels:
            return df.withColumn(out, F.lit(None).cast("string"))
        if not distribution:
            return df.withColumn(out, self.vote())
        df = df.withColumn(distribution, self.probabilities())
        return df.withColumn(out, Model(self.labels, F.col(distribution)).vote())


def adding(cell: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """A step of ``aggregate`` that adds a part of each element (nothing where it is null)."""
    return lambda s, x: s + F.coalesce(cell(x), F.lit(0.0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written into the plan once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


@dataclass
class Regressor:
    value: Column

    def apply(self, df: DataFrame, out: str = "prediction", distribution: str | None = None) -> DataFrame:
        return df.withColumn(out, self.value.cast("double"))


Learn = Callable[..., Model]


@dataclass
class Coding:
    """An attribute as small whole numbers: its labels in order, or bins between cuts (a value at a cut goes left)."""

    column: str
    labels: list | None = None
    cuts: list[float] | None = None

    @property
    def size(self) -> int:
        return len(self.labels) if self.labels is not None else len(self.cuts) + 1

    def code(self) -> Column:
        if self.labels is not None:
            c = F.col(self.column).cast("string")
            at = F.array_position(F.array(*[F.lit(str(x)) for x in self.labels]) if self.labels else F.array().cast("array<string>"), c)
            return F.when(at > 0, (at - 1).cast("int"))
        x = F.col(self.column).cast("double")
        return F.when(x.isNotNull(), F.size(F.filter(F.array(*[F.lit(float(c)) for c in self.cuts]).cast("array<double>"), lambda c: c < x)))

    def test(self, kind: str, i: int) -> Column:
        """code = i, code <= i or code > i on the column itself; null where it is missing."""
        if kind == "=":
            return F.col(self.column).cast("string") == str(self.labels[i])
        x, c = F.col(self.column).cast("double"), F.lit(float(self.cuts[i]))
        return x <= c if kind == "<=" else x > c


def coded(df: DataFrame, columns: list[str], bins: int = 32, most_labels: int = 1000) -> list[Coding]:
    """Labels of text columns, and quantile cuts of numeric ones, in one pass for all of the latter."""
    numbers = [c for c in columns if numeric(df, c)]
    cuts: dict[str, list[float]] = {}
    if numbers:
        at = [i / bins for i in range(1, bins)]
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(f"q{i}") for i, c in enumerate(numbers)], *[F.max(F.col(c).cast("double")).alias(f"z{i}") for i, c in enumerate(numbers)]).first()
        cuts = {c: [x for x in sorted(set(row[f"q{i}"] or [])) if x < row[f"z{i}"]] for i, c in enumerate(numbers)}
    return [Coding(c, cuts=cuts[c]) if c in cuts else Coding(c, labels=labels_of(df, c, most_labels)) for c in columns]


def classes_of(df: DataFrame, label: str) -> list[str]:
    return labels_of(df.select(F.col(label).cast("string").alias(label)), label, 1000)


def cell_counts(df: DataFrame, node: Column, codings: list[Coding], label: str, classes: list[str], weight: Column | None = None) -> dict[int, list[np.ndarray]]:
    """{node: for each attribute an array (codes + 1, classes) of weights}; the last row holds missing values.

    One shuffle of (node, attribute, code, class) after a map-side combine, whatever the number of nodes.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    cells = F.array(*[F.struct(F.lit(i).alias("a"), c.code().alias("v")) for i, c in enumerate(codings)])
    long = df.where(F.col(label).isNotNull()).select(node.alias("node"), F.col(label).cast("string").alias("y"), w.alias("w"), F.explode(cells).alias("x"))
    out: dict[int, list[np.ndarray]] = {}
    at = {y: i for i, y in enumerate(classes)}
    for r in long.where("node IS NOT NULL").groupBy("node", "x.a", "x.v", "y").agg(F.sum("w").alias("w")).collect():
        if r["y"] in at:
            tables = out.setdefault(r["node"], [np.zeros((c.size + 1, len(classes))) for c in codings])
            tables[r["a"]][-1 if r["v"] is None else r["v"], at[r["y"]]] += r["w"]
    return out


def cell_moments(df: DataFrame, node: Column, codings: list[Coding], target: str, weight: Column | None = None) -> dict[int, list[np.ndarray]]:
    """The same with three columns for a numeric target: weight, weight * y and weight * y * y."""
    w, y = F.lit(1.0) if weight is None else weight.cast("double"), F.col(target).cast("double")
    cells = F.array(*[F.struct(F.lit(i).alias("a"), c.code().alias("v")) for i, c in enumerate(codings)])
    long = df.where(y.isNotNull()).select(node.alias("node"), w.alias("w"), (w * y).alias("wy"), (w * y * y).alias("wyy"), F.explode(cells).alias("x"))
    out: dict[int, list[np.ndarray]] = {}
    for r in long.where("node IS NOT NULL").groupBy("node", "x.a", "x.v").agg(*[F.sum(c).alias(c) for c in ("w", "wy", "wyy")]).collect():
        tables = out.setdefault(r["node"], [np.zeros((c.size + 1, 3)) for c in codings])
        tables[r["a"]][-1 if r["v"] is None else r["v"]] += (r["w"], r["wy"], r["wyy"])
    return out


def entropy(counts: np.ndarray) -> np.ndarray:
    """Entropy in bits along the last axis; 0 for nothing."""
    total = counts.sum(axis=-1, keepdims=True)
    p = np.divide(counts, total, out=np.zeros_like(counts, dtype=float), where=total > 0)
    return -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(axis=-1)


def constant(classes: list[str], counts: np.ndarray) -> Model:
    return Model(classes, F.array(*[F.lit(float(x)) for x in counts]))


def class_counts(df: DataFrame, label: str, classes: list[str], weight: Column | None = None) -> np.ndarray:
    got = {r["y"]: r["w"] for r in df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("y")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("w")).collect()}
    return np.array([got.get(c, 0.0) for c in classes])
