"""Function learners: mistake-driven weights, kernels, robust and boosted regressions, radial bases."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import Model, Regressor, classes_of
from .relational import cut
from .rows import uniform


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def poly_kernel(a: Column, b: Column, exponent: float = 1.0, lower: bool = False) -> Column:
    """(a . b) ** exponent, with ``lower`` (a . b + 1) ** exponent."""
    return F.pow(dot(a, b) + (1.0 if lower else 0.0), F.lit(float(exponent)))


def normalized_poly_kernel(a: Column, b: Column, exponent: float = 2.0, lower: bool = False) -> Column:
    k = lambda x, y: poly_kernel(x, y, exponent, lower)
    return F.try_divide(k(a, b), F.sqrt(k(a, a) * k(b, b)))


def rbf_kernel(a: Column, b: Column, gamma: float = 0.01) -> Column:
    return F.exp(-F.lit(gamma) * (dot(a, a) - 2 * dot(a, b) + dot(b, b)))


def _mixed(df: DataFrame, columns: list[str], label: str, key: str, update, rounds: int, start: np.ndarray) -> np.ndarray:
    """Weights of a sequential learner by iterative mixing: every partition learns from where all stood, in the order of a
    hash, and the partitions' weights are averaged by rows.  What travels is one vector a partition and round."""
    data = cut(df.where(F.col(label).isNotNull()).dropna(subset=columns).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(label).alias("y"), F.md5(F.col(key).cast("string")).alias("h")).repartitionByRange("h").sortWithinPartitions("h"))
    weights = start
    names = [f"x{i}" for i in range(len(columns))]
    for _ in range(rounds):
        now = weights

        def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, n = now.copy(), 0
            for f in frames:
                w = update(w, f[names].to_numpy(float), f["y"].to_numpy(float))
                n += len(f)
            yield pd.DataFrame({"n": [n], "w": [w.tolist()]})

        parts = data.mapInPandas(learn, "n long, w array<double>").where("n > 0").collect()
        if not parts:
            return weights
        total = sum(p["n"] for p in parts)
        weights = sum(np.array(p["w"]) * (p["n"] / total) for p in parts)
    return weights


def _two(df: DataFrame, label: str) -> tuple[list[str], DataFrame]:
    classes = classes_of(df, label)
    if len(classes) != 2:
        raise ValueError("two classes are needed")
    return classes, df.withColumn("_y", F.when(F.col(label).isNotNull(), F.when(F.col(label).cast("string") == classes[1], 1.0).otherwise(-1.0)))


def winnow(df: DataFrame, columns: list[str], label: str, key: str, rate: float = 2.0, rounds: int = 5, balanced: bool = True) -> Model:
    """Multiplicative updates on 0/1 attributes where a prediction is wrong."""
    classes, data = _two(df, label)
    d = len(columns)
    threshold = d / 2 if not balanced else 0.0

    def update(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        up, down = w[:d], w[d:]
        for row, t in zip(x, y):
            s = row @ (up - down) if balanced else row @ up
            if (s > threshold) != (t > 0):
                factor = np.where(row > 0, rate if t > 0 else 1 / rate, 1.0)
                up = up * factor
                down = down / factor if balanced else down
        return np.concatenate([up, down])

    w = _mixed(data, columns, "_y", key, update, rounds, np.concatenate([np.ones(d), np.ones(d) if balanced else np.zeros(d)]))
    weights = w[:d] - w[d:] if balanced else w[:d]
    s = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(v)) for c, v in zip(columns, weights)), F.lit(-float(threshold)))
    return Model(classes, F.array((s <= 0).cast("double"), (s > 0).cast("double")))


def voted_perceptron(df: DataFrame, columns: list[str], label: str, key: str, rounds: int = 5) -> Model:
    """The mean of all weight vectors that a perceptron passes through, the linear form of its vote."""
    classes, data = _two(df, label)
    d = len(columns) + 1

    def update(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        v, total, n = w.copy(), np.zeros(d), 0
        for row, t in zip(np.hstack([np.ones((len(x), 1)), x]), y):
            if t * (row @ v) <= 0:
                v = v + t * row
            total += v
            n += 1
        return total / max(n, 1)

    w = _mixed(data, columns, "_y", key, update, rounds, np.zeros(d))
    s = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(v)) for c, v in zip(columns, w[1:])), F.lit(float(w[0])))
    return Model(classes, F.array(1 / (1 + F.exp(s)), 1 / (1 + F.exp(-s))))


def least_median_squares(df: DataFrame, columns: list[str], y: str, key: str, samples: int = 30, size: int | None = None, seed: int = 1) -> Regressor:
    """Of regressions through small hashed samples, the one of the least median squared residual, all measured in one pass;
    then least squares over the rows within 2.5 robust deviations of it."""
    from .learners import linear_regression

    data = df.dropna(subset=[*columns, y])
    size = size or len(columns) + 2
    per = max(1, samples * size)
    drawn = data.orderBy(uniform(F.col(key), seed), key).limit(per).select(*columns, y).collect()  # samples x size rows
    fits = []
    for a in range(0, len(drawn) - size + 1, size):
        rows = np.array([[1.0, *[float(r[c]) for c in columns]] for r in drawn[a : a + size]])
        fits.append(np.linalg.lstsq(rows, np.array([float(r[y]) for r in drawn[a : a + size]]), rcond=None)[0])
    if not fits:
        return Regressor(F.lit(0.0))
    value = lambda b: sum((F.col(c).cast("double") * F.lit(float(v)) for c, v in zip(columns, b[1:])), F.lit(float(b[0])))
    row = data.agg(*[F.percentile_approx(F.pow(F.col(y) - value(b), F.lit(2.0)), 0.5, 10_000).alias(f"m{i}") for i, b in enumerate(fits)]).first()
    at = min(range(len(fits)), key=lambda i: (row[f"m{i}"], i))
    scale = 1.4826 * (1 + 5 / max(1, len(drawn))) * math.sqrt(max(row[f"m{at}"], 0.0))
    close = data.where(F.abs(F.col(y) - value(fits[at])) <= 2.5 * max(scale, 1e-12))
    fitted = linear_regression(close, columns, y)
    return Regressor(value(np.array([fitted["(intercept)"], *[fitted[c] for c in columns]])))


def selected_regression(df: DataFrame, columns: list[str], y: str, ridge: float = 1e-8) -> dict[str, float]:
    """Least squares with backward elimination by the Akaike criterion, all subsets from one matrix of sums."""
    rows = df.dropna(subset=[*columns, y])
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in columns], F.col(y).cast("double")]
    k = len(terms)
    r = rows.agg(*[F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    g = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    n = max(g[0, 0], 1.0)

    def fit(used: list[int]) -> tuple[float, np.ndarray]:
        a, b = g[np.ix_(used, used)] + ridge * np.eye(len(used)), g[used, -1]
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        rss = max(g[-1, -1] - 2 * beta @ b + beta @ g[np.ix_(used, used)] @ beta, 1e-12)
        return n * math.log(rss / n) + 2 * len(used), beta

    used = list(range(k - 1))
    score, beta = fit(used)
    while len(used) > 1:
        tries = [(fit([u for u in used if u != i])[0], i) for i in used[1:]]
        if min(tries)[0] >= score:
            break
        used = [u for u in used if u != min(tries)[1]]
        score, beta = fit(used)
    names = ["(intercept)", *columns]
    return {names[u]: float(b) for u, b in zip(used, beta)}


def pace_regression(df: DataFrame, columns: list[str], y: str) -> dict[str, float]:
    """Least squares in an orthogonal basis, each coordinate shrunk by the empirical Bayes estimate of its share of signal."""
    rows = df.dropna(subset=[*columns, y])
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in columns], F.col(y).cast("double")]
    k = len(terms)
    r = rows.agg(*[F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    g = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    a, b, n = g[:-1, :-1], g[:-1, -1], g[0, 0]
    upper = np.linalg.cholesky(a + 1e-9 * np.trace(a) / k * np.eye(k - 1)).T
    z = np.linalg.solve(upper.T, b)
    noise = max((g[-1, -1] - z @ z) / max(n - k + 1, 1), 1e-12)
    strength = z[1:] ** 2 / noise
    signal = max(float(np.mean(np.maximum(strength - 1, 0))), 0.0)
    odds = np.exp(np.clip(strength / 2 * signal / (1 + signal), 0, 700)) / math.sqrt(1 + signal)
    share = float(np.mean(odds / (1 + odds)))
    keep = signal / (1 + signal) * (share * odds / (share * odds + 1 - share + 1e-300)) if signal > 0 else np.zeros(k - 2)
    beta = np.linalg.solve(upper, np.concatenate([z[:1], z[1:] * keep]))
    return dict(zip(["(intercept)", *columns], map(float, beta)))


def radial_basis(df: DataFrame, columns: list[str], label: str, key: str, centres: int = 4, numeric_label: bool = False) -> Model | Regressor:
    """k-means centres of the normalised columns, and a logistic or linear model of Gaussian distances to them."""
    from .clusters import k_means
    from .learners import linear_regression
    from .transforms import ranges_of

    data = df.dropna(subset=[*columns, label])
    bounds = ranges_of(data, columns)
    _, found = k_means(data, columns, centres, key)
    width = max(0.1, 1 / math.sqrt(2 * centres))

    def activation(c: tuple[float, ...]) -> Column:
        d = sum((F.pow((F.col(n).cast("double") - F.lit(float(v))) / F.lit(float(max(bounds[n][1] - bounds[n][0], 1e-12))), F.lit(2.0)) for n, v in zip(columns, c)), F.lit(0.0))
        return F.exp(-d / (2 * width * width))

    units = {f"_u{i}": activation(c) for i, c in enumerate(found)}
    if numeric_label:
        fitted = linear_regression(data.withColumns(units), list(units), label, ridge=1e-6)
        return Regressor(sum((units[u] * F.lit(fitted[u]) for u in units), F.lit(fitted["(intercept)"])))
    classes = classes_of(df, label)
    return Model(classes, F.array(*[additive_score(data.withColumns(units).withColumn("_t", (F.col(label).cast("string") == c).cast("double")), units) for c in classes]))


def additive_score(data: DataFrame, units: dict[str, Column]) -> Column:
    """A linear fit of a 0/1 target on the units, cut to [0, 1]."""
    from .learners import linear_regression

    fitted = linear_regression(data, list(units), "_t", ridge=1e-6)
    return F.least(F.greatest(sum((units[u] * F.lit(fitted[u]) for u in units), F.lit(fitted["(intercept)"])), F.lit(0.0)), F.lit(1.0))


def simple_logistic(df: DataFrame, columns: list[str], label: str, rounds: int = 20) -> Model:
    """Boosted simple regressions: in each round every class takes the column whose weighted least squares fits its working
    response best; one aggregation a round gives the sums of all columns and classes."""
    classes = classes_of(df, label)
    data = cut(df.where(F.col(label).isNotNull()).dropna(subset=columns).select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("string").alias("_y")))
    k = len(classes)
    f = [dict.fromkeys(["", *columns], 0.0) for _ in classes]
    score = lambda y: sum((F.col(c) * F.lit(f[y][c]) for c in columns if f[y][c]), F.lit(f[y][""]))
    for _ in range(rounds):
        top = F.array_max(F.array(*[score(y) for y in range(k)]))
        exps = [F.exp(score(y) - top) for y in range(k)]
        total = sum(exps[1:], exps[0])
        aggs = []
        for y, name in enumerate(classes):
            p = exps[y] / total
            w = F.greatest(p * (1 - p), F.lit(1e-4))
            z = F.least(F.greatest(((F.col("_y") == name).cast("double") - p) / w, F.lit(-3.0)), F.lit(3.0))
            aggs += [F.sum(w).alias(f"w{y}"), F.sum(w * z).alias(f"z{y}"), F.sum(w * z * z).alias(f"zz{y}")]
            for i, c in enumerate(columns):
                aggs += [F.sum(w * F.col(c)).alias(f"x{y}_{i}"), F.sum(w * F.col(c) * F.col(c)).alias(f"xx{y}_{i}"), F.sum(w * F.col(c) * z).alias(f"xz{y}_{i}")]
        r = data.agg(*aggs).first()
        if not r["w0"]:
            break
        for y in range(k):
            w, z = r[f"w{y}"], r[f"z{y}"]
            fits = []
            for i, c in enumerate(columns):
                xx = r[f"xx{y}_{i}"] - r[f"x{y}_{i}"] ** 2 / w
                slope = (r[f"xz{y}_{i}"] - r[f"x{y}_{i}"] * z / w) / xx if xx > 1e-12 else 0.0
                fits.append((-(slope**2) * max(xx, 0.0), i, slope, (z - slope * r[f"x{y}_{i}"]) / w))
            _, i, slope, intercept = min(fits)
            f[y][columns[i]] += slope * (k - 1) / k
            f[y][""] += intercept * (k - 1) / k
    top = F.array_max(F.array(*[score(y) for y in range(k)]))
    return Model(classes, F.array(*[F.exp(score(y) - top) for y in range(k)]))
