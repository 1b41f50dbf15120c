"""Entropy cuts by minimum description length, and compositions of learners."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import cut, numbered, with_folds


def cumulated(df: DataFrame, column: str, label: str, labels: list) -> DataFrame:
    """v and, for each label, how many rows have a value up to v; blocks of distinct values carry offsets."""
    both = df.where(F.col(column).isNotNull() & F.col(label).isNotNull())
    counts = both.groupBy(F.col(column).cast("double").alias("v")).agg(*[F.sum((F.col(label) == x).cast("long")).alias(f"c{i}") for i, x in enumerate(labels)])
    laid = numbered(counts, "v").withColumn("_b", F.floor(F.col("rid") / 4096))
    names = [f"c{i}" for i in range(len(labels))]
    sums = {r["_b"]: r for r in laid.groupBy("_b").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    rows, run = [], [0] * len(names)
    for b in sorted(sums):
        rows.append((b, *run))
        run = [a + sums[b][c] for a, c in zip(run, names)]
    offsets = df.sparkSession.createDataFrame(rows, "_b long, " + ", ".join(f"o{i} long" for i in range(len(names))))
    w = Window.partitionBy("_b").orderBy("v")
    return cut(laid.join(offsets, "_b").select("v", *[(F.col(f"o{i}") + F.sum(c).over(w)).alias(c) for i, c in enumerate(names)]))


def _entropy(parts: list) -> float:
    total = sum(parts)
    return -sum(p / total * math.log2(p / total) for p in parts if p) if total else 0.0


def _entropy_column(parts: list[Column]) -> Column:
    total = sum(parts[1:], parts[0])
    return -sum((F.when(p > 0, p / total * F.log2(p / total)).otherwise(F.lit(0.0)) for p in parts), F.lit(0.0))


def mdl_cuts(df: DataFrame, column: str, label: str) -> list[float]:
    """Cuts between neighbouring values that lower the class entropy by more than describing them costs."""
    from .columns import labels_of

    labels = labels_of(df, label, 1000)
    if not labels:
        return []
    table = cumulated(df, column, label, labels)
    names = [f"c{i}" for i in range(len(labels))]
    found: list[float] = []
    last = table.agg(F.max_by(F.struct("v", *names), "v").alias("x")).first()["x"]
    todo = [(-math.inf, [0] * len(names), last["v"], [last[c] for c in names])] if last else []
    while todo:
        low, base, high, top = todo.pop()
        whole = [t - b for t, b in zip(top, base)]
        n = sum(whole)
        left = [F.col(c) - b for c, b in zip(names, base)]
        right = [F.lit(t) - F.col(c) for c, t in zip(names, top)]
        inside = table.where((F.col("v") > low) & (F.col("v") < high))
        size = sum(left[1:], left[0])
        info = (size * _entropy_column(left) + (F.lit(n) - size) * _entropy_column(right)) / F.lit(max(n, 1))
        best = inside.agg(F.min(F.struct(F.round(info, 12).alias("info"), "v", *names)).alias("x"), F.count(F.lit(1)).alias("k")).first()
        if not best["k"]:
            continue
        x = best["x"]
        a, b = [x[c] - y for c, y in zip(names, base)], [t - x[c] for c, t in zip(names, top)]
        gain = _entropy(whole) - x["info"]
        classes = lambda p: sum(1 for q in p if q)
        delta = math.log2(3 ** classes(whole) - 2) - (classes(whole) * _entropy(whole) - classes(a) * _entropy(a) - classes(b) * _entropy(b))
        if gain <= (math.log2(best["k"]) + delta) / n:
            continue
        above = table.where(F.col("v") > x["v"]).agg(F.min("v")).first()[0]
        found.append((x["v"] + above) / 2)
        middle = [x[c] for c in names]
        todo += [(low, base, x["v"], middle), (x["v"], middle, high, top)]
    return sorted(found)


def cross_validated(df: DataFrame, label: str, folds: int, key: str, learn: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """fold, n, right: ``learn(train, test)`` gives key and prediction for test rows; training never sees them."""
    dealt = cut(with_folds(df, folds, key))
    out: DataFrame | None = None
    for f in range(folds):
        test = dealt.where(F.col("fold") == f)
        got = learn(dealt.where(F.col("fold") != f).drop("fold"), test.drop("fold"))
        row = test.select(key, label).join(got, key, "left").agg(F.lit(f).alias("fold"), F.count(F.lit(1)).alias("n"), F.sum(F.coalesce((F.col("prediction") == F.col(label)).cast("long"), F.lit(0))).alias("right"))
        out = row if out is None else out.unionByName(row)
    return out


def vote(df: DataFrame, predictions: list[str], out: str = "vote") -> DataFrame:
    """The commonest of several prediction columns, the smallest on ties; nulls do not vote."""
    cells = F.array_sort(F.array_compact(F.array(*predictions)))
    counted = F.transform(F.array_distinct(cells), lambda x: F.struct((-F.size(F.filter(cells, lambda y: y == x))).alias("n"), x.alias("x")))
    return df.withColumn(out, F.array_min(counted)["x"])


def best_threshold(df: DataFrame, positive: str, score: str) -> DataFrame:
    """threshold, f_measure: the largest F, of the largest threshold on ties."""
    from .evaluation import threshold_counts

    c = threshold_counts(df, positive, score)
    f = F.round(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)
    return c.select("threshold", f.alias("f_measure")).agg(F.max(F.struct("f_measure", "threshold")).alias("x")).select("x.threshold", "x.f_measure")


def least_cost(df: DataFrame, probabilities: dict[str, str], costs: dict[tuple[str, str], float], out: str = "prediction") -> DataFrame:
    """The label of least expected cost from columns of probabilities; costs are (actual, predicted)."""
    options = [F.struct(sum((F.col(c) * costs.get((actual, predicted), 0.0) for actual, c in probabilities.items()), F.lit(0.0)).alias("cost"), F.lit(predicted).alias("label")) for predicted in sorted(probabilities)]
    return df.withColumn(out, F.array_min(F.array(*options))["label"])
