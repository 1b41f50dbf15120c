"""More estimators: conditional densities of numbers given labels or numbers, and clusters with densities."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import cut
from .transforms import ranges_of

ROOT = math.sqrt(2 * math.pi)


def normal_density(x: Column, mean: Column, deviation: Column) -> Column:
    z = (x - mean) / deviation
    return F.exp(-z * z / 2) / (deviation * ROOT)


def normal_given_label(df: DataFrame, column: str, given: str, precision: float) -> DataFrame:
    """given, mean, deviation of values rounded to ``precision``; the deviation is a sixth of it at least."""
    x = F.round(F.col(column) / precision) * precision
    return df.where(F.col(column).isNotNull() & F.col(given).isNotNull()).groupBy(F.col(given).alias("given")).agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.greatest(F.stddev_pop(x), F.lit(precision / 6)), 6).alias("deviation"))


def kernel_given_label(df: DataFrame, column: str, given: str, points: list[float], width: float) -> DataFrame:
    """given, point, density: Gaussian kernels on the values of each label."""
    x = F.col(column).cast("double")
    cells = F.array(*[F.struct(F.lit(float(p)).alias("point"), F.avg(normal_density(F.lit(float(p)), x, F.lit(width))).alias("density")) for p in points])
    rows = df.where(x.isNotNull() & F.col(given).isNotNull()).groupBy(F.col(given).alias("given")).agg(cells.alias("c"))
    return rows.select("given", F.explode("c").alias("x")).select("given", "x.point", F.round("x.density", 8).alias("density"))


def label_given_kernel(df: DataFrame, column: str, given: str, points: list[float], width: float) -> DataFrame:
    """point, value, probability of a label given a number: each label's share of the kernels on the number."""
    x = F.col(given).cast("double")
    cells = F.array(*[F.struct(F.lit(float(p)).alias("point"), F.sum(normal_density(F.lit(float(p)), x, F.lit(width))).alias("d")) for p in points])
    rows = df.where(x.isNotNull() & F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(cells.alias("c")).select("value", F.explode("c").alias("x")).select("value", "x.point", "x.d")
    total = rows.groupBy("point").agg(F.sum("d").alias("t"))
    return rows.join(F.broadcast(total), "point").select("point", "value", F.round(F.col("d") / F.col("t"), 8).alias("probability"))


def label_given_normal(df: DataFrame, column: str, given: str, points: list[float]) -> DataFrame:
    """point, value, probability: the labels' normals of the number, times their shares."""
    x = F.col(given).cast("double")
    per = df.where(x.isNotNull() & F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.count(F.lit(1)).alias("n"))
    at = per.select("value", "n", F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("point"), "m", "s").withColumn("d", F.col("n") * normal_density(F.col("point"), F.col("m"), F.greatest("s", F.lit(1e-6))))
    total = at.groupBy("point").agg(F.sum("d").alias("t"))
    return at.join(F.broadcast(total), "point").select("point", "value", F.round(F.try_divide(F.col("d"), F.col("t")), 8).alias("probability"))


def kernel_given_kernel(df: DataFrame, column: str, given: str, points: list[tuple[float, float]], width: float, given_width: float) -> DataFrame:
    """point, given, density of a number given another: kernels of both, weighted by those of the other."""
    x, y = F.col(column).cast("double"), F.col(given).cast("double")
    cells = []
    for p, g in points:
        w = normal_density(F.lit(float(g)), y, F.lit(given_width))
        cells.append(F.struct(F.lit(float(p)).alias("point"), F.lit(float(g)).alias("given"), F.try_divide(F.sum(w * normal_density(F.lit(float(p)), x, F.lit(width))), F.sum(w)).alias("density")))
    return df.where(x.isNotNull() & y.isNotNull()).agg(F.array(*cells).alias("c")).select(F.explode("c").alias("x")).select("x.point", "x.given", F.round("x.density", 8).alias("density"))


def normal_given_normal(df: DataFrame, column: str, given: str, points: list[tuple[float, float]]) -> DataFrame:
    """point, given, density of a number given another under a joint normal."""
    x, y = F.col(column).cast("double"), F.col(given).cast("double")
    rows = df.where(x.isNotNull() & y.isNotNull())
    s = rows.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("c"))
    at = s.select("*", F.explode(F.array(*[F.struct(F.lit(float(p)).alias("point"), F.lit(float(g)).alias("given")) for p, g in points])).alias("z"))
    mean = F.col("mx") + F.try_divide(F.col("c"), F.col("vy")) * (F.col("z.given") - F.col("my"))
    deviation = F.sqrt(F.greatest(F.col("vx") - F.try_divide(F.col("c") * F.col("c"), F.col("vy")), F.lit(1e-12)))
    return at.select("z.point", "z.given", F.round(normal_density(F.col("z.point"), mean, deviation), 8).alias("density"))


def mahalanobis(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key, distance: the squared distance to the mean in units of the covariance, and the density of a normal there."""
    x = [F.col(c).cast("double") for c in columns]
    k = len(columns)
    rows = df.dropna(subset=columns)
    r = rows.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) + 1e-12 * np.eye(k)
    inverse, determinant = np.linalg.inv(cov), np.linalg.det(cov)
    d = [v - F.lit(r[f"m{i}"]) for i, v in enumerate(x)]
    q = sum((d[i] * d[j] * F.lit(float(inverse[i, j])) for i in range(k) for j in range(k)), F.lit(0.0))
    return rows.select(key, F.round(q, 6).alias("distance"), F.round(F.exp(-q / 2) / F.lit((2 * math.pi) ** (k / 2) * math.sqrt(max(determinant, 1e-300))), 10).alias("density"))


def density_of_clusters(df: DataFrame, columns: list[str], cluster: str) -> list[tuple[tuple[float, ...], tuple[float, ...], float]]:
    """(means, deviations, prior) of each cluster, with one row added to each: what turns any clusterer into a density."""
    rows = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).orderBy(cluster).collect()
    total = sum(r["n"] for r in rows)
    return [(tuple(float(r[f"m{i}"] or 0.0) for i in range(len(columns))), tuple(max(float(r[f"s{i}"] or 0.0), 1e-6) for i in range(len(columns))), (r["n"] + 1) / (total + len(rows))) for r in rows]


def log_likelihood(df: DataFrame, columns: list[str], parts: list[tuple[tuple[float, ...], tuple[float, ...], float]]) -> DataFrame:
    """rows and the mean log density under the mixture."""
    logs = []
    for means, deviations, prior in parts:
        s = F.lit(math.log(prior))
        for c, m, d in zip(columns, means, deviations):
            z = (F.col(c).cast("double") - F.lit(m)) / F.lit(d)
            s = s - z * z / 2 - F.lit(math.log(d * ROOT))
        logs.append(s)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    value = top + F.log(sum((F.exp(x - top) for x in logs), F.lit(0.0)))
    return df.dropna(subset=columns).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(value), 6).alias("log_likelihood"))


def classes_to_clusters(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """cluster, label, rows, wrong: the assignment of labels to clusters (each label once) that leaves the fewest rows wrong;
    a cluster without a label has all of its rows wrong."""
    cells = df.where(F.col(label).isNotNull()).groupBy(F.col(cluster).cast("string").alias("c"), F.col(label).cast("string").alias("y")).count().collect()
    clusters, labels = sorted({r["c"] for r in cells}), sorted({r["y"] for r in cells})
    n = {(r["c"], r["y"]): r["count"] for r in cells}
    total = {c: sum(n.get((c, y), 0) for y in labels) for c in clusters}
    if len(clusters) * 2 ** len(labels) > 1 << 22:
        raise ValueError("too many labels for an exact assignment")
    best: dict[frozenset, tuple[int, tuple]] = {frozenset(): (0, ())}
    for c in clusters:
        new: dict[frozenset, tuple[int, tuple]] = {}
        for used, (wrong, made) in best.items():
            for y in [None, *[y for y in labels if y not in used]]:
                key = used | ({y} if y is not None else set())
                option = (wrong + total[c] - (n.get((c, y), 0) if y is not None else 0), (*made, "" if y is None else y))
                if key not in new or option < new[key]:
                    new[key] = option
        best = new
    _, made = min(best.values())
    rows = [(c, y or None, total[c], total[c] - n.get((c, y), 0)) for c, y in zip(clusters, made)]
    return df.sparkSession.createDataFrame(rows, "cluster string, label string, rows long, wrong long")


def cobweb(df: DataFrame, columns: list[str], key: str, acuity: float = 1.0, cutoff: float = 0.0028, cells: int = 4096, bins: int = 8) -> DataFrame:
    """key, cluster: a hierarchy by category utility, grown over cells instead of rows.

    Rows are first counted in cells of coded attributes (one aggregation; at most ``cells`` of them come to the driver, more
    is an error); cells then enter the tree one by one, largest first, each to the child, new child, merge or split of the
    best utility; a row belongs to the leaf-level concept of its cell.
    """
    from .models import coded

    codings = coded(df.dropna(subset=columns), columns, bins)
    data = df.dropna(subset=columns)
    codes = [c.code().alias(f"c{i}") for i, c in enumerate(codings)]
    found = data.groupBy(*codes).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *[f"c{i}" for i in range(len(codings))]).limit(cells + 1).collect()
    if len(found) > cells:
        raise ValueError(f"more than {cells} cells: use fewer bins")
    sizes = [c.size for c in codings]

    def blank() -> dict:
        return {"n": 0, "t": [np.zeros(s) for s in sizes], "kids": [], "cells": []}

    def add(node: dict, cell: tuple, n: int) -> None:
        node["n"] += n
        node["cells"].append(cell)
        for t, v in zip(node["t"], cell):
            t[v] += n

    score = lambda node: sum(float(((t / node["n"]) ** 2).sum()) for t in node["t"]) if node["n"] else 0.0

    def utility(parent: dict, kids: list[dict]) -> float:
        return sum(k["n"] / parent["n"] * (score(k) - score(parent)) for k in kids) / max(1, len(kids))

    def both(a: dict, b: dict) -> dict:
        return {"n": a["n"] + b["n"], "t": [x + y for x, y in zip(a["t"], b["t"])], "kids": [a, b], "cells": a["cells"] + b["cells"]}

    def with_cell(node: dict, cell: tuple, n: int) -> dict:
        made = {"n": node["n"], "t": [t.copy() for t in node["t"]], "kids": node["kids"], "cells": list(node["cells"])}
        add(made, cell, n)
        return made

    root = blank()
    for r in found:
        cell, n = tuple(r[f"c{i}"] for i in range(len(codings))), r["n"]
        node = root
        while True:
            single = len(node["cells"]) == 1 and not node["kids"]
            if single:
                old = {"n": node["n"], "t": [t.copy() for t in node["t"]], "kids": [], "cells": list(node["cells"])}
            add(node, cell, n)
            if len(node["cells"]) == 1:
                break
            new = blank()
            add(new, cell, n)
            if single:
                node["kids"] = [old, new]
                break
            options = [(utility(node, [*[k for k in node["kids"] if k is not kid], with_cell(kid, cell, n)]), -i, kid) for i, kid in enumerate(node["kids"])]
            options.sort(key=lambda o: o[:2], reverse=True)
            alone = utility(node, [*node["kids"], new])
            if alone > options[0][0] + cutoff * 0 and alone >= cutoff:
                node["kids"].append(new)
                break
            first = options[0][2]
            if len(options) > 1:
                second = options[1][2]
                joined = both(first, second)
                rest = [k for k in node["kids"] if k is not first and k is not second]
                if rest and utility(node, [*rest, with_cell(joined, cell, n)]) > options[0][0]:
                    node["kids"] = [*rest, joined]
                    first = joined
            if options[0][0] < cutoff and not first["kids"]:
                add(first, cell, n)
                first["kids"] = []
                break
            node = first
    numbers: dict[tuple, int] = {}
    for i, kid in enumerate(root["kids"] or [root]):
        for cell in kid["cells"]:
            numbers[cell] = i
    table = df.sparkSession.createDataFrame([(*c, i) for c, i in sorted(numbers.items())], ", ".join(f"_c{i} int" for i in range(len(codings))) + ", cluster int")
    rows = data.select(key, *codes)
    return rows.join(F.broadcast(table), [F.col(f"c{i}") == F.col(f"_c{i}") for i in range(len(codings))]).select(key, "cluster")


def widths(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """A kernel width for each column: its range by the root of the rows."""
    n = max(1, cut(df.select(*columns)).count())
    return {c: max((z - a) / math.sqrt(n), 1e-6) if a is not None else 1.0 for c, (a, z) in ranges_of(df, columns).items()}
