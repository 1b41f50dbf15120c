"""Learners that look at training rows when asked, blocks of queries at a time, and interval votes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .models import Model, classes_of
from .neighbours import nearest


def weighted_neighbours(train: DataFrame, queries: DataFrame, columns: list[str], key: str, label: str, k: int, weighting: str = "none") -> DataFrame:
    """query, prediction of the k nearest rows; votes weigh one, 1 / distance ('inverse') or 1 - distance ('similarity')."""
    found = nearest(train, queries, columns, key, k).join(train.select(F.col(key).alias("neighbour"), F.col(label).cast("string").alias("label")), "neighbour").where("label IS NOT NULL")
    d = F.col("distance")
    weight = {"none": F.lit(1.0), "inverse": 1 / (d + 0.001), "similarity": F.greatest(1 - d / math.sqrt(max(1, len(columns))), F.lit(0.0))}[weighting]
    votes = found.groupBy("query", "label").agg(F.round(F.sum(weight), 9).alias("w"))
    return votes.groupBy("query").agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("prediction"))


def locally_weighted(train: DataFrame, queries: DataFrame, columns: list[str], key: str, target: str, k: int = 20, ridge: float = 1e-6) -> DataFrame:
    """query, prediction: a linear fit to the k nearest rows, weighted down to 0 at the farthest of them.

    Only k rows for each query are joined back; sums of products are taken for each query and solved in Arrow batches.
    """
    d = len(columns) + 1
    found = nearest(train, queries, columns, key, k)
    found = found.withColumn("_far", F.max("distance").over(Window.partitionBy("query")))  # k rows
    rows = found.join(train.select(F.col(key).alias("neighbour"), *[F.col(c).cast("double").alias(f"x{i + 1}") for i, c in enumerate(columns)], F.col(target).cast("double").alias("y")), "neighbour").withColumn("x0", F.lit(1.0))
    w = F.greatest(1 - F.col("distance") / (F.col("_far") * 1.000001 + 1e-12), F.lit(1e-6))
    sums = rows.groupBy("query").agg(F.array(*[F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(d) for j in range(d)]).alias("a"), F.array(*[F.sum(w * F.col(f"x{i}") * F.col("y")) for i in range(d)]).alias("b"))
    asked = sums.join(queries.select(F.col(key).alias("query"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns]).alias("q")), "query")

    @F.pandas_udf("double")
    def solve(a: pd.Series, b: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for m, v, x in zip(a, b, q):
            m = np.asarray(m, float).reshape(d, d)
            m = m + ridge * np.diag([0.0, *np.maximum(np.diag(m)[1:], 1e-12)])
            out.append(float(np.linalg.lstsq(m, np.asarray(v, float), rcond=None)[0] @ np.asarray(x, float)))
        return pd.Series(out)

    return asked.select("query", solve("a", "b", "q").alias("prediction"))


def entropic_neighbours(train: DataFrame, queries: DataFrame, columns: list[str], key: str, label: str, blend: float = 20.0) -> DataFrame:
    """query, prediction: every training row votes with the probability of turning the query into it by random steps,
    exponential in the scaled distance; the scale of each attribute makes about ``blend`` percent of the rows count.

    Queries are compared with all rows through sums over cells: rows are first counted by their coded attributes and class,
    so a query meets the distinct cells and not the rows.
    """
    from .models import coded

    codings = coded(train, columns, 24)
    codes = [c.code() for c in codings]
    cells = train.where(F.col(label).isNotNull()).groupBy(*[c.alias(f"c{i}") for i, c in enumerate(codes)], F.col(label).cast("string").alias("label")).count()
    asked = queries.select(F.col(key).alias("query"), *[c.alias(f"q{i}") for i, c in enumerate(codes)])
    kinds = asked.groupBy(*[f"q{i}" for i in range(len(codes))]).agg(F.min("query").alias("_one"))
    weight: Column = F.lit(1.0)
    for i, c in enumerate(codings):
        s = max(1e-3, blend / 100 * c.size / 2)
        step = F.exp(-F.abs(F.col(f"c{i}") - F.col(f"q{i}")) / s) if c.cuts is not None else F.when(F.col(f"c{i}") == F.col(f"q{i}"), 1.0).otherwise(blend / 100 / max(1, c.size - 1))
        weight = weight * F.coalesce(step, F.lit(0.5))
    # Codes are few by construction: distinct queries by distinct cells, not rows by rows.
    met = kinds.join(cells, F.lit(True), "inner")
    votes = met.groupBy("_one", *[f"q{i}" for i in range(len(codes))], "label").agg(F.round(F.sum(F.col("count") * weight), 9).alias("w"))
    best = votes.groupBy(*[f"q{i}" for i in range(len(codes))]).agg(F.min_by("label", F.struct(-F.col("w"), F.col("label"))).alias("prediction"))
    on = [asked[f"q{i}"].eqNullSafe(best[f"q{i}"]) for i in range(len(codes))]
    return asked.join(best, on).select("query", "prediction")


def feature_intervals(df: DataFrame, columns: list[str], label: str, bias: float = 0.6) -> Model:
    """Every attribute votes by the share of each class (relative to the class's size) in the value's interval, weighted by
    the attribute's confidence raised to ``bias``; intervals end at the classes' smallest and largest values."""
    from .models import Coding, cell_counts, class_counts, coded, entropy, let, numeric

    classes = classes_of(df, label)
    numbers = [c for c in columns if numeric(df, c)]
    ends: dict[str, list[float]] = {c: [] for c in numbers}
    if numbers:
        for r in df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("y")).agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(numbers) for n, f in (("a", F.min), ("z", F.max))]).collect():
            for i, c in enumerate(numbers):
                ends[c] += [x for x in (r[f"a{i}"], r[f"z{i}"]) if x is not None]
    others = coded(df, [c for c in columns if c not in numbers]) if len(numbers) < len(columns) else []
    codings = [Coding(c, cuts=sorted(set(ends[c]))) if c in numbers else next(o for o in others if o.column == c) for c in columns]
    tables = cell_counts(df, F.lit(0), codings, label, classes).get(0, [])
    total = np.maximum(class_counts(df, label, classes), 1e-300)
    scores: list[Column] = [F.lit(0.0)] * len(classes)
    lit = lambda v: F.array(*[lit(x) for x in v]) if isinstance(v, (list, np.ndarray)) else F.lit(float(v))
    whole = float(entropy(total))
    for c, t in zip(codings, tables):
        share = t[:-1] / total
        rows = share.sum(axis=1, keepdims=True)
        share = np.divide(share, rows, out=np.full_like(share, 1 / len(classes)), where=rows > 0)
        known = t[:-1]
        gain = whole - float((known.sum(axis=1) * entropy(known)).sum() / max(known.sum(), 1e-300))
        weight = (1 + max(gain, 0.0)) ** bias
        code = c.code()
        for y in range(len(classes)):
            scores[y] = scores[y] + F.coalesce(F.try_element_at(lit(weight * share[:, y]), code + 1), F.lit(0.0))
    return Model(classes, F.array(*scores))


def pipes_model(df: DataFrame, columns: list[str], label: str) -> Model:
    """The class in whose range (numbers) or set of labels most attributes lie."""
    from .models import coded, cell_counts, numeric

    classes = classes_of(df, label)
    scores: list[Column] = [F.lit(0.0)] * len(classes)
    rows = df.where(F.col(label).isNotNull())
    numbers = [c for c in columns if numeric(df, c)]
    if numbers:
        got = {r["y"]: r for r in rows.groupBy(F.col(label).cast("string").alias("y")).agg(*[f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(numbers) for n, f in (("a", F.min), ("z", F.max))]).collect()}
        for y, name in enumerate(classes):
            for i, c in enumerate(numbers):
                low, high = got[name][f"a{i}"], got[name][f"z{i}"]
                if low is not None:
                    scores[y] = scores[y] + F.coalesce(F.col(c).between(low, high).cast("double"), F.lit(0.0))
    others = [c for c in columns if c not in numbers]
    if others:
        codings = coded(df, others)
        for c, t in zip(codings, cell_counts(df, F.lit(0), codings, label, classes).get(0, [])):
            for y in range(len(classes)):
                seen = [c.labels[i] for i in range(c.size) if t[i, y] > 0]
                scores[y] = scores[y] + F.coalesce(F.col(c.column).isin(seen).cast("double"), F.lit(0.0))
    return Model(classes, F.array(*scores))
