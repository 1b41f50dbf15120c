"""Compositions of learners: ``learn(df, columns, label, weight)`` gives a model; all of these give a model again.

Members are trained one after another because each is a loop of cluster-wide jobs; what a member changes (weights, sampled
counts, targets) is a column, so no rows are copied or collected.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import Learn, Model, Regressor, adding, class_counts, classes_of, let
from .relational import cut, with_folds
from .rows import uniform


def aligned(models: list[Model]) -> tuple[list[str], list[list[Column]]]:
    """All labels in order, and each model's probabilities under them."""
    labels = sorted({x for m in models for x in m.labels})
    return labels, [[p[i] for i in range(len(labels))] for p in (_under(m, labels, 1.0) for m in models)]


def _under(m: Model, labels: list[str], weight: float) -> Column:
    """The model's probabilities times a weight, in the order of other labels."""
    return let(m.probabilities(), lambda d: F.array(*[d[m.labels.index(x)] * F.lit(float(weight)) if x in m.labels else F.lit(0.0) for x in labels]))


def averaged(models: list[Model], weights: list[float] | None = None) -> Model:
    """The (weighted) mean of probabilities."""
    labels = sorted({x for m in models for x in m.labels})
    weights = weights or [1.0] * len(models)
    parts = F.array(*[_under(m, labels, w) for m, w in zip(models, weights)])
    at = lambda i: lambda d: d[i]
    return Model(labels, let(parts, lambda every: F.array(*[F.aggregate(every, F.lit(0.0), adding(at(i))) for i in range(len(labels))])))


def voted(models: list[Model], weights: list[float]) -> Model:
    """Weighted votes, each for a model's most probable label."""
    labels = sorted({x for m in models for x in m.labels})

    votes = F.array(*[F.named_struct(F.lit("v"), m.vote(), F.lit("w"), F.lit(float(w))) for m, w in zip(models, weights)])
    of = lambda label: lambda x: F.when(x["v"] == label, x["w"])
    return Model(labels, let(votes, lambda every: F.array(*[F.aggregate(every, F.lit(0.0), adding(of(label))) for label in labels])))


def draws(key: str, member: int, seed: int, mean: float = 1.0) -> Column:
    """How often a member draws a row: a Poisson count from a hash of the key, as drawing with replacement gives."""
    u = uniform(F.concat_ws("/", F.col(key).cast("string"), F.lit(f"m{member}")), seed)
    out, total, p = F.lit(0), 0.0, math.exp(-mean)
    for k in range(12):
        total += p
        out = out + (u >= F.lit(total)).cast("int")
        p *= mean / (k + 1)
    return out.cast("double")


def bagging(learn: Learn, df: DataFrame, columns: list[str], label: str, key: str, members: int = 10, percent: float = 100.0, seed: int = 1) -> Model:
    return averaged([learn(df, columns, label, weight=draws(key, i, seed, percent / 100)) for i in range(members)])


def out_of_bag_error(learn: Learn, df: DataFrame, columns: list[str], label: str, key: str, members: int = 10, seed: int = 1) -> float:
    """Error of the mean of the members that did not draw a row, over the rows that some member did not draw."""
    models = [learn(df, columns, label, weight=draws(key, i, seed)) for i in range(members)]
    labels, parts = aligned(models)
    out = [draws(key, i, seed) == 0 for i in range(members)]
    sums = F.array(*[sum((F.when(o, p[i]).otherwise(F.lit(0.0)) for o, p in zip(out, parts)), F.lit(0.0)) for i in range(len(labels))])
    some = sum((o.cast("int") for o in out), F.lit(0))
    got = Model(labels, sums).apply(df.where((some > 0) & F.col(label).isNotNull()), "_p", None)
    return float(got.agg(F.avg((F.col("_p") != F.col(label).cast("string")).cast("double"))).first()[0] or 0.0)


def random_committee(learn: Callable[..., Model], df: DataFrame, columns: list[str], label: str, members: int = 10, seed: int = 1) -> Model:
    """The mean of members that differ by their seed alone."""
    return averaged([learn(df, columns, label, seed=seed + i) for i in range(members)])


def ada_boost(learn: Learn, df: DataFrame, columns: list[str], label: str, rounds: int = 10, start: Column | None = None) -> tuple[Model, list[float]]:
    """Weights of rows that a member gets right shrink by e / (1 - e); members vote with the logarithm of its inverse.

    Returns the votes' weights too.  Weights are a product of factors, computed from the models and stored in no table.
    """
    models, betas = [], []
    weight = start if start is not None else F.lit(1.0)
    rows = df.where(F.col(label).isNotNull())
    for _ in range(rounds):
        m = learn(rows, columns, label, weight=weight)
        wrong = m.apply(rows.withColumn("_w", weight), "_p", None).select("_w", (F.col("_p") != F.col(label).cast("string")).alias("_e"))
        r = wrong.agg(F.sum("_w").alias("t"), F.sum(F.when(F.col("_e"), F.col("_w")).otherwise(0.0)).alias("e")).first()
        e = (r["e"] or 0.0) / max(r["t"] or 0.0, 1e-300)
        if e >= 0.5 or e <= 0:
            if not models or e <= 0:
                models.append(m)
                betas.append(math.log(1e10) if e <= 0 else 1.0)
            break
        models.append(m)
        betas.append(math.log((1 - e) / e))
        weight = weight * F.when(m.vote() == F.col(label).cast("string"), F.lit(e / (1 - e))).otherwise(F.lit(1.0))
    return voted(models, betas), betas


def multi_boost(learn: Learn, df: DataFrame, columns: list[str], label: str, key: str, rounds: int = 9, committees: int = 3, seed: int = 1) -> Model:
    """Boosting that begins anew in each committee with hashed weights of mean one."""
    models, weights = [], []
    for c in range(committees):
        u = uniform(F.concat_ws("/", F.col(key).cast("string"), F.lit(f"c{c}")), seed)
        start = None if c == 0 else -F.log(F.greatest(1 - u, F.lit(1e-9)))
        m, betas = ada_boost(learn, df, columns, label, max(1, rounds // committees), start)
        models.append(m)
        weights.append(sum(betas))
    return averaged(models, weights)


def logit_boost(df: DataFrame, columns: list[str], label: str, learn: Callable[..., Regressor], rounds: int = 10) -> Model:
    """Two classes: Newton steps of the log odds by weighted regressions of the working response."""
    classes = classes_of(df, label)
    rows = df.where(F.col(label).isNotNull())
    f: Column = F.lit(0.0)
    y = (F.col(label).cast("string") == classes[-1]).cast("double")
    for _ in range(rounds):
        now = rows.withColumn("_p", 1 / (1 + F.exp(-2 * f))).withColumn("_w", F.greatest(F.col("_p") * (1 - F.col("_p")), F.lit(1e-6)))
        now = now.withColumn("_z", F.least(F.greatest((y - F.col("_p")) / F.col("_w"), F.lit(-4.0)), F.lit(4.0)))
        f = f + 0.5 * learn(now, columns, "_z", weight=F.col("_w")).value
    return Model([classes[0], classes[-1]], let(f, lambda t: F.array(1 / (1 + F.exp(2 * t)), 1 / (1 + F.exp(-2 * t)))))


def raced_logit_boost(df: DataFrame, columns: list[str], label: str, key: str, learn: Callable[..., Regressor], chunks: tuple[int, ...] = (2, 4), rounds: int = 4, seed: int = 1) -> Model:
    """Committees that learn one member from each chunk of the rows; of several chunk counts the one with the least log loss
    on a held-out tenth stays."""
    held = uniform(F.concat_ws("/", F.col(key).cast("string"), F.lit("held")), seed) < 0.1
    train, test = df.where(~held), df.where(held & F.col(label).isNotNull())
    best = None
    for n in chunks:
        part = F.floor(uniform(F.col(key), seed) * n)
        m = averaged([logit_boost(train.where(part == i), columns, label, learn, rounds) for i in range(n)])
        p = m.probabilities()
        own = F.element_at(p, F.array_position(F.array(*[F.lit(x) for x in m.labels]), F.col(label).cast("string")).cast("int"))
        loss = test.select(own.alias("p")).agg(F.avg(-F.log(F.greatest("p", F.lit(1e-9))))).first()[0]
        if best is None or (loss is not None and loss < best[0]):
            best = (math.inf if loss is None else loss, m)
    return best[1]


def additive_regression(learn: Callable[..., Regressor], df: DataFrame, columns: list[str], label: str, rounds: int = 10, shrinkage: float = 1.0) -> Regressor:
    """Each round fits what the sum so far leaves over."""
    value: Column = F.lit(float(df.agg(F.avg(label)).first()[0] or 0.0))
    for _ in range(rounds):
        rest = cut(df.withColumn("_rest", F.col(label) - value))
        value = value + F.lit(shrinkage) * learn(rest, columns, "_rest").value
    return Regressor(value)


def decorated(learn: Learn, df: DataFrame, columns: list[str], label: str, key: str, members: int = 5, tries: int = 10, share: float = 1.0, seed: int = 1) -> Model:
    """Members trained on extra made-up rows that carry the label the ensemble finds least likely; a member stays if the
    error on the real rows does not rise."""
    from .models import numeric

    rows = df.where(F.col(label).isNotNull())
    numbers = [c for c in columns if numeric(df, c)]
    stats = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(numbers) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()

    def error(m: Model) -> float:
        return float(m.apply(rows, "_p", None).agg(F.avg((F.col("_p") != F.col(label).cast("string")).cast("double"))).first()[0] or 0.0)

    models = [learn(rows, columns, label)]
    best = error(models[0])
    for t in range(tries):
        if len(models) >= members:
            break
        made = rows.where(uniform(F.concat_ws("/", F.col(key).cast("string"), F.lit(f"t{t}")), seed) < share)
        for i, c in enumerate(numbers):
            u, v = (uniform(F.concat_ws("/", F.col(key).cast("string"), F.lit(f"{s}{t}/{i}")), seed) for s in "uv")
            normal = F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-9)))) * F.cos(2 * math.pi * v)
            made = made.withColumn(c, F.lit(float(stats[f"m{i}"] or 0.0)) + normal * F.lit(float(stats[f"s{i}"] or 0.0)))
        now = averaged(models)
        least = Model(now.labels, let(now.probabilities(), lambda d: F.transform(d, lambda x: 1 - x))).vote()
        m = learn(cut(rows.select(*columns, F.col(label).cast("string").alias(label)).unionByName(made.withColumn("_l", least).select(*columns, F.col("_l").alias(label)))), columns, label)
        e = error(averaged([*models, m]))
        if e <= best:
            models.append(m)
            best = e
    return averaged(models)


def cross_predictions(learns: dict[str, Learn], df: DataFrame, columns: list[str], label: str, key: str, folds: int) -> DataFrame:
    """Rows with <name>_p<i> for each learner and class, by models that did not see the row."""
    classes = classes_of(df, label)
    dealt = cut(with_folds(df.where(F.col(label).isNotNull()), folds, key))
    out: DataFrame | None = None
    for f in range(folds):
        train, test = dealt.where(F.col("fold") != f).drop("fold"), dealt.where(F.col("fold") == f).drop("fold")
        for name, learn in learns.items():
            m = learn(train, columns, label)
            p = m.probabilities()
            test = test.withColumns({f"{name}_p{i}": p[m.labels.index(c)] if c in m.labels else F.lit(0.0) for i, c in enumerate(classes)})
        out = test if out is None else out.unionByName(test)
    return cut(out)


def stacking(learns: dict[str, Learn], top: Learn, df: DataFrame, columns: list[str], label: str, key: str, folds: int = 3, per_class: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A learner over the members' cross-validated probabilities (``per_class``: one linear score a class over that class's
    probabilities alone).  Returns a function that adds ``prediction``."""
    classes = classes_of(df, label)
    level = cross_predictions(learns, df, columns, label, key, folds)
    names = [f"{n}_p{i}" for n in learns for i in range(len(classes))]
    models = {n: learn(df, columns, label) for n, learn in learns.items()}
    if per_class:
        from .functions import additive_score

        scores = [additive_score(level.withColumn("_t", (F.col(label).cast("string") == c).cast("double")), {f"{n}_p{i}": F.col(f"{n}_p{i}") for n in learns}) for i, c in enumerate(classes)]
        final = Model(classes, F.array(*scores))
    else:
        final = top(level, names, label)

    def apply(rows: DataFrame) -> DataFrame:
        out = rows
        for n, m in models.items():
            p = m.probabilities()
            out = out.withColumns({f"{n}_p{i}": p[m.labels.index(c)] if c in m.labels else F.lit(0.0) for i, c in enumerate(classes)})
        return final.apply(out, "prediction", None).drop(*names)

    return apply


def grading(learns: dict[str, Learn], top: Learn, df: DataFrame, columns: list[str], label: str, key: str, folds: int = 3) -> Model:
    """For every member a learner of whether it is right; members that are likely right vote with that probability."""
    level = cross_predictions(learns, df, columns, label, key, folds)
    classes = classes_of(df, label)
    models, trusts = [], []
    for n, learn in learns.items():
        cells = F.array(*[F.col(f"{n}_p{i}") for i in range(len(classes))])
        says = F.array(*[F.lit(c) for c in classes])[(F.array_position(cells, F.array_max(cells)) - 1).cast("int")]
        graded = level.withColumn("_right", F.when(says == F.col(label).cast("string"), "yes").otherwise("no"))
        g = top(graded, columns, "_right")
        trusts.append(g.probabilities()[g.labels.index("yes")] if "yes" in g.labels else F.lit(0.0))
        models.append(learn(df, columns, label))
    labels, parts = aligned(models)
    sums = []
    for i in range(len(labels)):
        total = F.lit(0.0)
        for p, t in zip(parts, trusts):
            total = total + F.when(t >= 0.5, t * (p[i] == F.greatest(*p) if len(p) > 1 else F.lit(True)).cast("double")).otherwise(F.lit(0.0))
        sums.append(total)
    return Model(labels, F.array(*sums))


def cross_error(learn: Learn, df: DataFrame, columns: list[str], label: str, key: str, folds: int = 3) -> float:
    """Share of rows that models which did not see them get wrong."""
    dealt = cut(with_folds(df.where(F.col(label).isNotNull()), folds, key))
    wrong, n = 0, 0
    for f in range(folds):
        m = learn(dealt.where(F.col("fold") != f), columns, label)
        r = m.apply(dealt.where(F.col("fold") == f), "_p", None).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("_p") != F.col(label).cast("string"), F.lit(True))).alias("e")).first()
        wrong, n = wrong + r["e"], n + r["n"]
    return wrong / max(n, 1)


def multi_scheme(learns: dict[str, Learn], df: DataFrame, columns: list[str], label: str, key: str, folds: int = 3) -> tuple[str, Model]:
    """The learner of the least cross-validated error (the first on ties), trained on all rows."""
    errors = {n: cross_error(learn, df, columns, label, key, folds) for n, learn in learns.items()}
    best = min(errors, key=lambda n: (errors[n], list(learns).index(n)))
    return best, learns[best](df, columns, label)


def parameter_selection(make: Callable[[float], Learn], values: list[float], df: DataFrame, columns: list[str], label: str, key: str, folds: int = 3) -> tuple[float, Model]:
    name, model = multi_scheme({str(v): make(v) for v in values}, df, columns, label, key, folds)
    return float(name), model


def attribute_selected(learn: Learn, select: Callable[[DataFrame, list[str], str], list[str]], df: DataFrame, columns: list[str], label: str) -> Model:
    """The learner on the columns that ``select`` takes."""
    return learn(df, select(df, columns, label) or columns[:1], label)


def filtered(learn: Learn, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], df: DataFrame, columns: list[str], label: str) -> Callable[[DataFrame], DataFrame]:
    """The learner on transformed rows; the transform is fitted on the training rows and frozen."""
    transform = fit(df)
    model = learn(transform(df), columns, label)
    return lambda rows: model.apply(transform(rows), "prediction", None)


def reweighted_by_cost(label: str, classes: list[str], counts: np.ndarray, costs: dict[tuple[str, str], float]) -> Column:
    """Row weights by what it costs to get a row of its class wrong, with the sum of weights kept."""
    c = np.array([sum(costs.get((a, p), 0.0) for p in classes if p != a) for a in classes])
    scale = counts.sum() / max(float((c * counts).sum()), 1e-300)
    out = F.lit(0.0)
    for a, x in zip(classes, c):
        out = F.when(F.col(label).cast("string") == a, F.lit(float(x * scale))).otherwise(out)
    return out


def cost_sensitive(learn: Learn, df: DataFrame, columns: list[str], label: str, costs: dict[tuple[str, str], float], minimise: bool = False) -> Model:
    """Rows weighted by cost, or with ``minimise`` the label of least expected cost under the plain model."""
    classes = classes_of(df, label)
    if not minimise:
        return learn(df, columns, label, weight=reweighted_by_cost(label, classes, class_counts(df, label, classes), costs))
    return least_expected(learn(df, columns, label), costs)


def least_expected(m: Model, costs: dict[tuple[str, str], float]) -> Model:
    expected = lambda p: F.array(*[-sum((p[i] * F.lit(float(costs.get((a, x), 0.0))) for i, a in enumerate(m.labels)), F.lit(0.0)) for x in m.labels])
    best = Model(m.labels, let(m.probabilities(), expected)).vote()
    return Model(m.labels, let(best, lambda v: F.array(*[(v == x).cast("double") for x in m.labels])))


def meta_cost(learn: Learn, df: DataFrame, columns: list[str], label: str, key: str, costs: dict[tuple[str, str], float], members: int = 5, seed: int = 1) -> Model:
    """The learner on rows relabelled to the least expected cost under a bagged model."""
    bagged = least_expected(bagging(learn, df, columns, label, key, members, seed=seed), costs)
    return learn(cut(bagged.apply(df.where(F.col(label).isNotNull()), "_new", None).withColumn(label, F.col("_new")).drop("_new")), columns, label)


def one_against_rest(learn: Learn, df: DataFrame, columns: list[str], label: str, codes: list[list[int]] | None = None) -> Model:
    """Two-class models, one a class; or with ``codes`` (a row of 0/1 a class) one a column, and the class whose code the
    members agree with most."""
    classes = classes_of(df, label)
    rows = df.where(F.col(label).isNotNull())
    codes = codes or np.eye(len(classes), dtype=int).tolist()
    ones = []
    for j in range(len(codes[0])):
        positive = [c for c, code in zip(classes, codes) if code[j]]
        m = learn(rows.withColumn("_b", F.when(F.col(label).cast("string").isin(positive), "1").otherwise("0")), columns, "_b")
        ones.append(m.probabilities()[m.labels.index("1")] if "1" in m.labels else F.lit(0.0))
    agree = [sum((p if code[j] else 1 - p for j, p in enumerate(ones)), F.lit(0.0)) for code in codes]
    if codes == np.eye(len(classes), dtype=int).tolist():
        agree = ones
    return Model(classes, F.array(*agree))


def ordinal(learn: Learn, df: DataFrame, columns: list[str], label: str, order: list[str]) -> Model:
    """For k ordered classes, k - 1 models of being above a class; probabilities are differences of neighbours."""
    rows = df.where(F.col(label).isNotNull())
    above = []
    for i in range(len(order) - 1):
        m = learn(rows.withColumn("_b", F.when(F.col(label).cast("string").isin(order[i + 1 :]), "1").otherwise("0")), columns, "_b")
        above.append(m.probabilities()[m.labels.index("1")] if "1" in m.labels else F.lit(0.0))
    parts = [1 - above[0], *[above[i - 1] - above[i] for i in range(1, len(above))], above[-1]]
    return Model(order, F.array(*[F.greatest(p, F.lit(0.0)) for p in parts]))


def by_regression(learn: Callable[..., Regressor], df: DataFrame, columns: list[str], label: str) -> Model:
    """One regression of a 0/1 target for each class; values are cut to [0, 1]."""
    classes = classes_of(df, label)
    rows = df.where(F.col(label).isNotNull())
    values = [learn(rows.withColumn("_t", (F.col(label).cast("string") == c).cast("double")), columns, "_t").value for c in classes]
    return Model(classes, F.array(*[F.least(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) for v in values]))


def by_discretization(learn: Learn, df: DataFrame, columns: list[str], label: str, bins: int = 10) -> Regressor:
    """A classifier of equal-width bins of the target; the mean of the bins' means by probability."""
    from .transforms import equal_width

    binned = equal_width(df.where(F.col(label).isNotNull()), label, bins, "_bin").withColumn("_bin", F.lpad(F.col("_bin").cast("string"), 4, "0"))
    means = {r["_bin"]: float(r["m"]) for r in binned.groupBy("_bin").agg(F.avg(label).alias("m")).collect()}
    m = learn(binned, columns, "_bin")
    return Regressor(let(m.probabilities(), lambda p: sum((p[i] * F.lit(means[x]) for i, x in enumerate(m.labels)), F.lit(0.0))))


def thresholded(m: Model, df: DataFrame, label: str, positive: str) -> tuple[float, Model]:
    """Two classes with the cut of the positive probability that has the largest F on the rows."""
    from .supervised import best_threshold

    p = m.probabilities()[m.labels.index(positive)]
    best = best_threshold(df.where(F.col(label).isNotNull()).select((F.col(label).cast("string") == positive).alias("y"), F.round(p, 9).alias("s")), "y", "s").first()
    at = float(best["threshold"])
    other = next(x for x in m.labels if x != positive)
    return at, Model([positive, other], F.array((F.round(p, 9) >= at).cast("double"), (F.round(p, 9) < at).cast("double")))
