"""Evaluation of predictions, threshold curves and comparison of schemes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.where(F.col(actual).isNotNull()).groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """total, accuracy and kappa from the confusion counts."""
    c = confusion(df, actual, predicted)
    rows = c.groupBy(F.col("actual").alias("k")).agg(F.sum("n").alias("r"))
    cols = c.groupBy(F.col("predicted").alias("k")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "k").agg(F.sum(F.col("r").cast("double") * F.col("c")).alias("chance"))
    t = c.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    expected = F.coalesce(F.col("chance"), F.lit(0.0)) / F.col("total") / F.col("total")
    accuracy = F.col("right") / F.col("total")
    return t.join(F.broadcast(chance)).select("total", F.round(accuracy, 6).alias("accuracy"), F.round(F.when(expected < 1, (accuracy - expected) / (1 - expected)).otherwise(F.lit(1.0)), 6).alias("kappa"))


def per_class(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """class with precision, recall and F; 0 where there is nothing to divide by."""
    c = confusion(df, actual, predicted)
    rows = c.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("r"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    cols = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("c"))
    j = rows.join(cols, "class", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    p = F.when(F.col("c") > 0, F.col("tp") / F.col("c")).otherwise(F.lit(0.0))
    r = F.col("tp") / F.col("r")
    return j.select("class", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), 6).alias("f_measure"))


def regression_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean absolute and root mean squared error, relative ones against the mean, and correlation, in two passes."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    both = df.where(a.isNotNull() & p.isNotNull()).select(a.alias("a"), p.alias("p"))
    mean = both.agg(F.avg("a").alias("m"))
    e = F.col("p") - F.col("a")
    d = F.col("a") - F.col("m")
    return both.join(F.broadcast(mean)).agg(
        F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(100 * F.sum(F.abs(e)) / F.sum(F.abs(d)), 4).alias("rae"), F.round(100 * F.sqrt(F.sum(e * e) / F.sum(d * d)), 4).alias("rrse"),
        F.round(F.corr("a", "p"), 6).alias("correlation"),
    )


def threshold_counts(df: DataFrame, positive: str, score: str, weight: str | None = None) -> DataFrame:
    """threshold, tp, fp, fn, tn: a row for each distinct score, the rule being score >= threshold.

    ``weight``: a whole number of rows that a row stands for.

    Distinct scores are counted first; running sums go over blocks of them, with the blocks' totals as offsets.
    """
    from .relational import numbered

    both = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull())
    times = F.col(weight) if weight else F.lit(1).cast("long")
    counts = both.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum(F.col(positive).cast("long") * times).alias("p"), F.sum(times).alias("n"))
    laid = numbered(counts, F.col("threshold").desc()).withColumn("_b", F.floor(F.col("rid") / 4096))
    sums = {r["_b"]: (r["p"], r["n"]) for r in laid.groupBy("_b").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()}
    rows, p, n = [], 0, 0
    for b in sorted(sums):
        rows.append((b, p, n))
        p, n = p + sums[b][0], n + sums[b][1]
    offsets = df.sparkSession.createDataFrame(rows, "_b long, _p long, _n long")
    w = Window.partitionBy("_b").orderBy(F.col("threshold").desc())
    tp, taken = F.col("_p") + F.sum("p").over(w), F.col("_n") + F.sum("n").over(w)
    out = laid.join(F.broadcast(offsets), "_b").select("threshold", tp.alias("tp"), (taken - tp).alias("fp"))
    return out.select("threshold", "tp", "fp", (F.lit(p) - F.col("tp")).alias("fn"), (F.lit(n - p) - F.col("fp")).alias("tn"))


def roc_area(df: DataFrame, positive: str, score: str) -> DataFrame:
    """Area by ranks: pairs of a positive and a negative in the right order, ties one half."""
    c = threshold_counts(df, positive, score)
    per = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(score).cast("double").alias("_t")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    j = c.join(per, F.col("threshold") == F.col("_t"))
    good = F.sum((F.col("n") - F.col("p")).cast("double") * (F.col("tp") - F.col("p") / 2.0))
    return j.agg(F.round(good / F.max("tp") / F.max("fp"), 6).alias("auc"))


def paired_test(df: DataFrame, scheme: str, run: list[str], value: str, first: str, second: str, test_share: float = 0.0) -> DataFrame:
    """n, mean difference, t and p of two schemes over the same runs; ``test_share`` is test rows per training row and
    corrects for runs that share training data."""
    from ..functions.measures import t_two_sided

    a = df.where(F.col(scheme) == first).select(*run, F.col(value).alias("x"))
    b = df.where(F.col(scheme) == second).select(*run, F.col(value).alias("y"))
    s = a.join(b, run).select((F.col("x") - F.col("y")).alias("d")).agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.var_samp("d").alias("v")).first()
    n, mean, var = s["n"], s["m"] or 0.0, s["v"] or 0.0
    scale = (var * (1 / max(n, 1) + test_share)) ** 0.5
    t = mean / scale if scale else 0.0
    return df.sparkSession.createDataFrame([(n, round(mean, 6), round(t, 6), round(t_two_sided(t, n - 1), 9))], "n long, mean_difference double, t double, p double")


def averaged(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means and sample deviations of result rows by key."""
    aggs = [f(v).alias(f"{n}_{v}") for v in values for n, f in (("avg", F.avg), ("dev", F.stddev_samp))]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_results"), *aggs)
