"""Bayesian learners as counts: naive Bayes of mixed attributes, for text, complement, averaged one-dependence, lazy rules."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import Model, cell_counts, class_counts, classes_of, coded, let, numeric


def _softmax(classes: list[str], logs: list[Column]) -> Model:
    return Model(classes, let(F.array(*logs), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))))


def naive_bayes(df: DataFrame, columns: list[str], label: str, weight: Column | None = None, kernels: int = 0) -> Model:
    """Counts with one added for labels; a normal for each number, or with ``kernels`` that many bins of its values as a
    smoothed histogram.  Missing values say nothing."""
    classes = classes_of(df, label)
    w = F.lit(1.0) if weight is None else weight
    prior = class_counts(df, label, classes, weight)
    logs: list[Column] = [F.lit(float(x)) for x in np.log((prior + 1) / (prior.sum() + len(classes)))]
    numbers = [c for c in columns if numeric(df, c) and not kernels]
    others = [c for c in columns if c not in numbers]
    if others:
        codings = coded(df, others, max(kernels, 2))
        tables = cell_counts(df, F.lit(0), codings, label, classes, weight).get(0, [np.zeros((c.size + 1, len(classes))) for c in codings])
        for c, t in zip(codings, tables):
            p = np.log((t[:-1] + 1) / (t[:-1].sum(axis=0) + c.size))
            code = c.code()
            for y in range(len(classes)):
                logs[y] = logs[y] + F.coalesce(F.try_element_at(F.array(*[F.lit(float(v)) for v in p[:, y]]), code + 1), F.lit(0.0))
    if numbers:
        y = F.col(label).cast("string")
        aggs = []
        for i, c in enumerate(numbers):
            x = F.col(c).cast("double")
            here = F.when(x.isNotNull(), w)
            aggs += [F.sum(here).alias(f"n{i}"), F.sum(here * x).alias(f"s{i}"), F.sum(here * x * x).alias(f"q{i}")]
        rows = {r["y"]: r for r in df.where(F.col(label).isNotNull()).groupBy(y.alias("y")).agg(*aggs).collect()}
        for k, name in enumerate(classes):
            for i, c in enumerate(numbers):
                r = rows.get(name)
                n = (r[f"n{i}"] or 0.0) if r else 0.0
                if n <= 0:
                    continue
                mean = r[f"s{i}"] / n
                deviation = max(math.sqrt(max(r[f"q{i}"] / n - mean * mean, 0.0) * (n / (n - 1) if n > 1 else 1)), 1e-3 * max(abs(mean), 1e-3))
                z = (F.col(c).cast("double") - F.lit(mean)) / F.lit(deviation)
                logs[k] = logs[k] + F.coalesce(-z * z / 2 - F.lit(math.log(deviation)), F.lit(0.0))
    return _softmax(classes, logs)


def word_counts(df: DataFrame, key: str, words: str, label: str) -> DataFrame:
    """label, word, n over rows with an array of words."""
    return df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.explode(words).alias("word")).groupBy("label", "word").agg(F.count(F.lit(1)).alias("n"))


def multinomial_model(df: DataFrame, key: str, words: str, label: str, complement: bool = False, normalize: bool = False) -> tuple[DataFrame, DataFrame]:
    """(word, label, weight) for all labels and met words, and (label, prior).

    The weight is log((n + 1) / (total + words)) of the class, or minus that of all other classes together; ``normalize``
    divides by the sum of a label's absolute weights.
    """
    counts = word_counts(df, key, words, label)
    labels = counts.groupBy("label").agg(F.sum("n").alias("total"))
    vocabulary = counts.groupBy("word").agg(F.sum("n").alias("all"))
    sizes = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("whole"))
    grid = vocabulary.join(F.broadcast(labels)).join(F.broadcast(sizes)).join(counts, ["word", "label"], "left")
    n = F.coalesce("n", F.lit(0))
    own = F.log((n + 1) / (F.col("total") + F.col("v")))
    rest = -F.log((F.col("all") - n + 1) / (F.col("whole") - F.col("total") + F.col("v")))
    out = grid.select("word", "label", (rest if complement else own).alias("weight"))
    if normalize:
        scale = out.groupBy("label").agg(F.sum(F.abs("weight")).alias("s"))
        out = out.join(F.broadcast(scale), "label").select("word", "label", (F.col("weight") / F.col("s")).alias("weight"))
    priors = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    rows = priors.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    return out, priors.join(F.broadcast(rows)).select("label", F.log((F.col("n") + 1) / (F.col("t") + F.col("k"))).alias("prior"))


def multinomial_predict(df: DataFrame, key: str, words: str, weights: DataFrame, priors: DataFrame, use_prior: bool = True) -> DataFrame:
    """key, prediction: the label of the largest sum (the first on ties); rows without a known word by the priors."""
    long = df.select(F.col(key).alias("_k"), F.explode(words).alias("word")).groupBy("_k", "word").count()
    sums = long.join(weights, "word").groupBy("_k", "label").agg(F.sum(F.col("count") * F.col("weight")).alias("s"))
    every = df.select(F.col(key).alias("_k")).join(F.broadcast(priors)).join(sums, ["_k", "label"], "left")
    score = F.coalesce("s", F.lit(0.0)) + (F.col("prior") if use_prior else F.lit(0.0))
    return every.groupBy(F.col("_k").alias(key)).agg(F.min_by("label", F.struct(-F.round(score, 9), F.col("label"))).alias("prediction"))


def averaged_one_dependence(df: DataFrame, columns: list[str], label: str, least: int = 1) -> Model:
    """The mean over attributes i (with at least ``least`` rows of the value) of P(y, xi) times the product of P(xj | y, xi).

    All counts of pairs come from one aggregation.
    """
    classes, codings = classes_of(df, label), coded(df, columns, 8)
    k = len(codings)
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), a.code().alias("a"), b.code().alias("b")) for i, a in enumerate(codings) for j, b in enumerate(codings)]
    long = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("y"), F.explode(F.array(*cells)).alias("x")).where("x.a IS NOT NULL AND x.b IS NOT NULL")
    counts = {(i, j): np.zeros((codings[i].size, codings[j].size, len(classes))) for i in range(k) for j in range(k)}
    for r in long.groupBy("x.i", "x.j", "x.a", "x.b", "y").count().collect():
        counts[r["i"], r["j"]][r["a"], r["b"], classes.index(r["y"])] += r["count"]
    total = float(class_counts(df, label, classes).sum())
    scores: list[Column] = [F.lit(0.0)] * len(classes)
    lit = lambda v: F.array(*[lit(x) for x in v]) if isinstance(v, (list, np.ndarray)) else F.lit(float(v))
    for i in range(k):
        own = counts[i, i].sum(axis=1)
        joint = np.log((own + 1) / (total + len(classes) * codings[i].size))
        enough = lit((own.sum(axis=1) >= least).astype(float))
        code = codings[i].code()
        for y in range(len(classes)):
            s = lit(joint[:, y])[code]
            for j in range(k):
                if j != i:
                    p = np.log((counts[i, j][:, :, y] + 1) / (own[:, y : y + 1] + codings[j].size))
                    s = s + F.coalesce(lit(p)[code][codings[j].code()], F.lit(0.0))
            scores[y] = scores[y] + F.coalesce(F.when(enough[code] > 0, F.exp(s)), F.lit(0.0))
    return Model(classes, F.array(*scores))


def lazy_rules(df: DataFrame, test: DataFrame, columns: list[str], label: str, key: str, least: int = 30) -> DataFrame:
    """key, prediction: naive Bayes among the training rows that agree with the test row on one attribute, if that lowers
    its leave-in error on them most, else among all rows.  Candidates are the attributes' values, not the test rows."""
    classes = classes_of(df, label)
    base = naive_bayes(df, columns, label)
    codings = coded(df, columns, 8)
    best = F.lit(None).cast("string")
    wrong = base.apply(df, "_p", None).where(F.col(label).isNotNull())
    options = []
    for c in codings:
        rates = {r["v"]: (r["n"], r["e"]) for r in wrong.groupBy(c.code().alias("v")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_p") != F.col(label).cast("string")).cast("double")).alias("e")).collect() if r["v"] is not None}
        for v, (n, e) in sorted(rates.items()):
            if n >= least:
                here = c.code() == v
                own = naive_bayes(df.where(here), [x for x in columns if x != c.column], label)
                got = own.apply(df.where(here & F.col(label).isNotNull()), "_p", None).agg(F.avg((F.col("_p") != F.col(label).cast("string")).cast("double"))).first()[0]
                if got is not None and got < e - 1e-9:
                    options.append((e - got, here, own))
    options.sort(key=lambda o: -o[0])
    out = base.apply(test, "prediction", None)
    for _, here, own in reversed(options):
        out = own.apply(out, "_own", None).withColumn("prediction", F.when(here, F.col("_own")).otherwise(F.col("prediction"))).drop("_own")
    return out.select(key, "prediction")
