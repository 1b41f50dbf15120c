"""Attribute selection: evaluators of single attributes and of subsets, searches over subsets, and their composition."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .models import Learn, numeric
from .neighbours import nearest
from .transforms import ranges_of

Merit = Callable[[list[str]], float]


def ranked(merits: DataFrame, merit: str, least: float | None = None, keep: int | None = None) -> DataFrame:
    """attribute, merit, rank by merit (ties by name), above a threshold and up to a number: one row an attribute."""
    rows = merits if least is None else merits.where(F.col(merit) >= least)
    out = rows.select("attribute", F.col(merit).alias("merit"), F.row_number().over(Window.orderBy(F.col(merit).desc(), "attribute")).alias("rank"))
    return out if keep is None else out.where(F.col("rank") <= keep)


def relief(df: DataFrame, columns: list[str], label: str, key: str, k: int = 10, sample: DataFrame | None = None) -> DataFrame:
    """attribute, weight: how much values differ between a row and its k nearest of other classes (weighted by the class's
    share), less how much they differ to its k nearest of its own."""
    rows = df.where(F.col(label).isNotNull()).dropna(subset=columns)
    asked = rows if sample is None else sample.where(F.col(label).isNotNull()).dropna(subset=columns)
    counts = {r["y"]: r["n"] for r in rows.groupBy(F.col(label).cast("string").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, bounds = sum(counts.values()), ranges_of(rows, columns)
    parts: DataFrame | None = None
    for y in sorted(counts):
        # One more neighbour, as a row of the class finds itself.
        near = nearest(rows.where(F.col(label).cast("string") == y), asked, columns, key, k + 1, bounds).where("query <> neighbour")
        w = Window.partitionBy("query").orderBy("rank")
        near = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("query", "neighbour", F.lit(y).alias("_y"))
        parts = near if parts is None else parts.unionByName(near)
    one = asked.select(F.col(key).alias("query"), F.col(label).cast("string").alias("_own"), *[F.col(c).cast("double").alias(f"_q{i}") for i, c in enumerate(columns)])
    two = rows.select(F.col(key).alias("neighbour"), *[F.col(c).cast("double").alias(f"_n{i}") for i, c in enumerate(columns)])
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, n / total)])
    hit = F.col("_y") == F.col("_own")
    weight = F.when(hit, F.lit(-1.0)).otherwise(share[F.col("_y")] / (1 - share[F.col("_own")]))
    span = {c: max((bounds[c][1] or 0) - (bounds[c][0] or 0), 1e-12) for c in columns}
    sums = [F.sum(weight * F.abs(F.col(f"_q{i}") - F.col(f"_n{i}")) / F.lit(float(span[c]))).alias(f"s{i}") for i, c in enumerate(columns)]
    r = parts.join(one, "query").join(two, "neighbour").agg(*sums)
    m = asked.agg((F.count(F.lit(1)) * k).alias("m"))
    cells = F.array(*[F.struct(F.lit(c).alias("attribute"), (F.coalesce(F.col(f"s{i}"), F.lit(0.0)) / F.col("m")).alias("weight")) for i, c in enumerate(columns)])
    return r.join(F.broadcast(m)).select(F.explode(cells).alias("x")).select("x.attribute", F.round("x.weight", 6).alias("weight"))


def svm_elimination(df: DataFrame, columns: list[str], label: str, per_round: int = 1) -> list[str]:
    """Attributes from best to worst: a linear machine is trained and the smallest squared weights leave, again and again."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from .relational import cut

    classes = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(F.col(label).cast("string")).distinct().limit(1001).collect())
    data = cut(df.where(F.col(label).isNotNull()).dropna(subset=columns))
    left, out = list(columns), []
    while len(left) > 1:
        made = VectorAssembler(inputCols=left, outputCol="_raw").transform(data)
        made = StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True).fit(made).transform(made)
        weights = [0.0] * len(left)
        for c in classes[1:] if len(classes) == 2 else classes:
            model = LinearSVC(featuresCol="_features", labelCol="_t", maxIter=20, regParam=0.01).fit(made.withColumn("_t", (F.col(label).cast("string") == c).cast("double")))
            weights = [w + x * x for w, x in zip(weights, model.coefficients)]
        worst = sorted(range(len(left)), key=lambda i: (weights[i], -i))[: min(per_round, len(left) - 1)]
        out = [left[i] for i in reversed(worst)] + out
        left = [c for i, c in enumerate(left) if i not in worst]
    return left + out


def wrapper(learn: Learn, df: DataFrame, label: str, key: str, folds: int = 3) -> Merit:
    """The cross-validated share of right answers with a subset (0 for none)."""
    from .meta import cross_error

    return lambda subset: round(1 - cross_error(learn, df, subset, label, key, folds), 9) if subset else 0.0


def by_classifier(learn: Learn, train: DataFrame, test: DataFrame, label: str) -> Merit:
    """The share of right answers on separate test rows with a subset."""
    def merit(subset: list[str]) -> float:
        if not subset:
            return 0.0
        got = learn(train, subset, label).apply(test.where(F.col(label).isNotNull()), "_p", None)
        return round(float(got.agg(F.avg((F.col("_p") == F.col(label).cast("string")).cast("double"))).first()[0] or 0.0), 9)

    return merit


def _cached(merit: Merit) -> Merit:
    seen: dict[tuple[str, ...], float] = {}

    def get(subset: list[str]) -> float:
        key = tuple(sorted(subset))
        if key not in seen:
            seen[key] = merit(sorted(subset))
        return seen[key]

    return get


def best_first(attributes: list[str], merit: Merit, stale: int = 5, start: list[str] | None = None, backward: bool = False) -> list[str]:
    """Expands the best open subset, until ``stale`` expansions in a row bring nothing better."""
    merit = _cached(merit)
    first = sorted(start if start is not None else attributes if backward else [])
    best, top, opened, closed, idle = first, merit(first), [first], {tuple(first)}, 0
    while opened and idle < stale:
        opened.sort(key=lambda s: (-merit(s), len(s), s))
        now = opened.pop(0)
        idle += 1
        for a in attributes:
            new = sorted(set(now) - {a}) if backward else sorted({*now, a})
            if tuple(new) in closed:
                continue
            closed.add(tuple(new))
            opened.append(new)
            if merit(new) > top + 1e-9:
                best, top, idle = new, merit(new), 0
    return best


def greedy_stepwise(attributes: list[str], merit: Merit, backward: bool = False) -> list[str]:
    merit = _cached(merit)
    now = sorted(attributes) if backward else []
    while True:
        options = [sorted(set(now) - {a}) for a in now] if backward else [sorted({*now, a}) for a in attributes if a not in now]
        best = max(options, key=lambda s: (merit(s), [-attributes.index(a) for a in s]), default=None)
        if best is None or (merit(best) < merit(now) if backward else merit(best) <= merit(now) + 1e-9):
            return now
        now = best


def random_search(attributes: list[str], merit: Merit, share: float = 0.25, seed: int = 1) -> list[str]:
    """A share of all subsets, drawn at random; the best, and of equals the smaller, stays."""
    merit, rng = _cached(merit), random.Random(seed)
    tries = [[]] + [sorted(a for a in attributes if rng.random() < 0.5) for _ in range(max(1, int(share * 2 ** len(attributes))))]
    return min(tries, key=lambda s: (-merit(s), len(s), s))


def genetic_search(attributes: list[str], merit: Merit, population: int = 10, generations: int = 10, crossover: float = 0.6, mutation: float = 0.05, seed: int = 1) -> list[str]:
    """Subsets as bit strings: parents by rank, one-point crossover, flipped bits; the best met stays."""
    merit, rng = _cached(merit), random.Random(seed)
    say = lambda bits: sorted(a for a, b in zip(attributes, bits) if b)
    alive = [[rng.random() < 0.5 for _ in attributes] for _ in range(population)]
    best = min(alive, key=lambda b: (-merit(say(b)), len(say(b))))
    for _ in range(generations):
        order = sorted(alive, key=lambda b: (-merit(say(b)), len(say(b))))
        children = [list(order[0])]
        while len(children) < population:
            a, b = rng.choices(order, weights=range(population, 0, -1), k=2)
            at = rng.randrange(1, len(attributes)) if rng.random() < crossover and len(attributes) > 1 else len(attributes)
            children.append([not x if rng.random() < mutation else x for x in a[:at] + b[at:]])
        alive = children
        best = min([best, *alive], key=lambda b: (-merit(say(b)), len(say(b))))
    return say(best)


def race_search(attributes: list[str], errors: Callable[[list[str], int], list[float]], folds: int = 5, significance: float = 0.1) -> list[str]:
    """Forward selection in which candidates race fold by fold: one whose errors are significantly above the best's so far
    drops out.  ``errors(subset, fold)`` gives a row of errors of the test rows in that fold."""
    from ..functions.measures import t_two_sided

    def race(options: list[list[str]]) -> tuple[list[str], float]:
        runs: dict[int, list[float]] = {i: [] for i in range(len(options))}
        for f in range(folds):
            for i in runs:
                runs[i] += errors(options[i], f)
            lead = min(runs, key=lambda i: (sum(runs[i]) / len(runs[i]), i))
            for i in [i for i in runs if i != lead]:
                d = [a - b for a, b in zip(runs[i], runs[lead])]
                mean = sum(d) / len(d)
                var = sum((x - mean) ** 2 for x in d) / max(1, len(d) - 1)
                t = mean / (var / len(d)) ** 0.5 if var > 0 else (float("inf") if mean > 0 else 0.0)
                if mean > 0 and (t == float("inf") or t_two_sided(t, len(d) - 1) < significance):
                    del runs[i]
        best = min(runs, key=lambda i: (sum(runs[i]) / len(runs[i]), i))
        return options[best], sum(runs[best]) / len(runs[best])

    now, level = [], race([[]])[1]
    while left := [a for a in attributes if a not in now]:
        best, value = race([[*now, a] for a in left])
        if value >= level - 1e-12:
            break
        now, level = best, value
    return now


def rank_search(order: list[str], merit: Merit) -> list[str]:
    """Of the ranking's prefixes the best; of equals the shorter."""
    merit = _cached(merit)
    return max((order[:k] for k in range(len(order) + 1)), key=lambda s: (merit(s), -len(s)))


def select(df: DataFrame, columns: list[str], search: Callable[[list[str], Merit], list[str]], merit: Merit, keep: list[str]) -> DataFrame:
    """The table with the attributes that the search finds, and the columns ``keep``."""
    found = search(columns, merit)
    return df.select(*[c for c in df.columns if c in found or c in keep])


def numeric_columns(df: DataFrame, but: list[str]) -> list[str]:
    return [c for c in df.columns if c not in but and numeric(df, c)]
