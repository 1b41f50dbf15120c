"""Experiments: runs of schemes over splits, result tables that skip what they hold, curves, bias and variance."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluation import threshold_counts
from .models import Learn, Model
from .relational import cut, with_folds
from .rows import uniform


def cost_curve(df: DataFrame, positive: str, score: str) -> DataFrame:
    """threshold, at_0 and at_1: the two ends of each threshold's line of normalised cost over the odds of the positive
    class: its false positive rate and its false negative rate."""
    c = threshold_counts(df, positive, score)
    fpr, fnr = F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), F.try_divide(F.col("fn"), F.col("tp") + F.col("fn"))
    return c.select("threshold", F.round(F.coalesce(fpr, F.lit(0.0)), 6).alias("at_0"), F.round(F.coalesce(fnr, F.lit(0.0)), 6).alias("at_1"))


def margins(df: DataFrame, actual: str, probabilities: dict[str, str]) -> DataFrame:
    """margin, current and cumulative: how many rows have each margin (the probability of the actual class less the largest
    other one) and how many have it or less, by running sums over blocks of distinct margins."""
    own = F.lit(0.0)
    for label, c in probabilities.items():
        own = F.when(F.col(actual) == label, F.col(c)).otherwise(own)
    other = F.greatest(*[F.when(F.col(actual) == label, F.lit(-1.0)).otherwise(F.col(c)) for label, c in probabilities.items()]) if len(probabilities) > 1 else F.lit(0.0)
    rows = df.where(F.col(actual).isNotNull()).select(F.round(own - other, 9).alias("m"))
    # A threshold curve of the negated margin counts the rows up to each margin.
    c = threshold_counts(rows.select((-F.col("m")).alias("s"), F.lit(True).alias("y")), "y", "s")
    counts = rows.groupBy("m").agg(F.count(F.lit(1)).alias("current"))
    return counts.join(c.select((-F.col("threshold")).alias("m"), F.col("tp").alias("cumulative")), "m").select(F.col("m").alias("margin"), "current", "cumulative")


def nominal_predictions(m: Model, df: DataFrame, label: str, key: str) -> DataFrame:
    """key, actual, predicted, margin and the distribution."""
    out = m.apply(df, "predicted")
    names = F.array(*[F.lit(x) for x in m.labels])
    at = F.array_position(names, F.col(label).cast("string"))
    own = F.coalesce(F.try_element_at("distribution", at.cast("int")), F.lit(0.0))
    other = F.array_max(F.transform("distribution", lambda x, i: F.when(i + 1 == at, F.lit(-1.0)).otherwise(x)))
    return out.select(key, F.col(label).cast("string").alias("actual"), "predicted", F.round(own - other, 9).alias("margin"), "distribution")


def numeric_predictions(df: DataFrame, label: str, prediction: str, key: str) -> DataFrame:
    """key, actual, predicted and error."""
    return df.select(key, F.col(label).cast("double").alias("actual"), F.col(prediction).cast("double").alias("predicted"), (F.col(prediction) - F.col(label)).alias("error"))


def split_rows(learn: Learn, train: DataFrame, test: DataFrame, columns: list[str], label: str, costs: dict[tuple[str, str], float] | None = None) -> dict[str, float]:
    """Results of one split: rows, share right, kappa, root mean squared error of probabilities, and mean cost."""
    m = learn(train, columns, label)
    got = m.apply(test.where(F.col(label).isNotNull()), "_p")
    y = F.col(label).cast("string")
    brier = F.aggregate(F.transform("distribution", lambda x, i: F.pow(x - (F.array(*[F.lit(c) for c in m.labels])[i] == y).cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x) / max(1, len(m.labels))
    cells = got.groupBy(y.alias("a"), F.col("_p").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(brier).alias("b")).collect()
    n = sum(r["n"] for r in cells) or 1
    right = sum(r["n"] for r in cells if r["a"] == r["p"]) / n
    labels = {r["a"] for r in cells} | {r["p"] for r in cells}
    chance = sum(sum(r["n"] for r in cells if r["a"] == x) * sum(r["n"] for r in cells if r["p"] == x) for x in labels) / n / n
    out = {"rows": float(n), "correct": right, "kappa": (right - chance) / (1 - chance) if chance < 1 else 1.0, "rmse": math.sqrt(sum(r["b"] for r in cells) / n)}
    if costs:
        out["cost"] = sum(costs.get((r["a"], r["p"]), 0.0) * r["n"] for r in cells) / n
    return out


def regression_split(learn: Callable, train: DataFrame, test: DataFrame, columns: list[str], label: str) -> dict[str, float]:
    got = learn(train, columns, label).apply(test.where(F.col(label).isNotNull()))
    e = F.col("prediction") - F.col(label)
    r = got.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")).first()
    return {k: float(r[k] or 0.0) for k in ("rows", "mae", "rmse")}


Split = tuple[dict[str, object], DataFrame, DataFrame]


def cross_validation(df: DataFrame, key: str, folds: int, runs: int = 1, label: str | None = None) -> Iterator[Split]:
    """(run and fold, train, test): rows are laid in a hashed order that changes with the run; with ``label`` class by class."""
    from .rows import remove_folds

    for run in range(1, runs + 1):
        order = F.md5(F.concat(F.lit(f"{run}:"), F.col(key).cast("string")))
        for fold in range(1, folds + 1):
            yield {"run": run, "fold": fold}, remove_folds(df, folds, fold, order, key, invert=True, label=label), remove_folds(df, folds, fold, order, key, label=label)


def random_splits(df: DataFrame, key: str, percent: float, runs: int) -> Iterator[Split]:
    """(run, train, test): a share of the rows by a hash of the run and the key."""
    for run in range(1, runs + 1):
        inside = uniform(F.col(key), run) < percent / 100
        yield {"run": run, "fold": 1}, df.where(inside), df.where(~inside)


def learning_rates(splits: Iterator[Split], key: str, sizes: list[int]) -> Iterator[Split]:
    """Every split again with the first ``size`` training rows of a hashed order, for each size."""
    for at, train, test in splits:
        laid = cut(train.withColumn("_h", F.md5(F.concat(F.lit("rate:"), F.col(key).cast("string")))))
        for n in sizes:
            yield at | {"size": n}, laid.orderBy("_h", key).limit(n).drop("_h"), test


def run_experiment(spark: SparkSession, schemes: dict[str, Learn], splits: Iterator[Split], columns: list[str], label: str, known: DataFrame | None = None, costs: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """scheme, run, fold (and size) with the results of each; what ``known`` holds already is not run again."""
    done = {(r["scheme"], r["run"], r["fold"], r["size"] if "size" in known.columns else None) for r in known.collect()} if known is not None else set()
    rows = []
    for at, train, test in splits:
        for name, learn in schemes.items():
            if (name, at["run"], at["fold"], at.get("size")) not in done:
                rows.append({"scheme": name, **at} | split_rows(learn, train, test, columns, label, costs))
    names = list(rows[0]) if rows else ["scheme", "run", "fold", "rows", "correct", "kappa", "rmse"]
    kind = lambda n: "string" if n == "scheme" else "int" if n in ("run", "fold", "size") else "double"
    new = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kind(n)}" for n in names))
    return new if known is None else known.unionByName(new, allowMissingColumns=True)


def store(results: DataFrame, path: str, form: str = "parquet") -> None:
    """Result rows added to a table: Parquet, CSV or ARFF."""
    if form == "arff":
        from ..sources import arff

        arff.write(results, path)
    elif form == "csv":
        results.write.mode("append").option("header", True).csv(path)
    else:
        results.write.mode("append").parquet(path)


def missing_keys(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Result keys that the stored table lacks: an anti join."""
    return wanted.join(stored, keys, "left_anti")


def compared(results: DataFrame, scheme: str, value: str, keys: list[str], base: str, train_share: float = 0.0, significance: float = 0.05) -> DataFrame:
    """scheme, n, mean, base_mean, t and outcome (better, worse, same) of every scheme against a base over paired runs."""
    from ..functions.measures import t_two_sided

    a = results.where(F.col(scheme) != base).select(F.col(scheme).alias("scheme"), *keys, F.col(value).alias("x"))
    b = results.where(F.col(scheme) == base).select(*keys, F.col(value).alias("y"))
    d = a.join(b, keys).withColumn("d", F.col("x") - F.col("y")).groupBy("scheme").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.avg("y").alias("base"), F.avg("d").alias("m"), F.var_samp("d").alias("v")).collect()
    rows = []
    for r in sorted(d, key=lambda r: r["scheme"]):
        scale = math.sqrt((r["v"] or 0.0) * (1 / r["n"] + train_share))
        t = r["m"] / scale if scale > 0 else 0.0
        sure = scale > 0 and t_two_sided(t, r["n"] - 1) < significance
        rows.append((r["scheme"], r["n"], round(r["mean"], 6), round(r["base"], 6), round(t, 6), ("better" if t > 0 else "worse") if sure else "same"))
    return results.sparkSession.createDataFrame(rows, "scheme string, n long, mean double, base_mean double, t double, outcome string")


def zipped(outputs: dict[str, str]) -> bytes:
    """Named texts as one compressed archive."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(outputs):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), outputs[name])
    return out.getvalue()


def bias_variance(learn: Learn, train: DataFrame, test: DataFrame, columns: list[str], label: str, key: str, runs: int = 10, share: float = 0.5) -> DataFrame:
    """error, bias_squared and variance of zero-one loss over models of hashed training samples: for each test row the share
    of models that give each label, against the label it has."""
    rows: DataFrame | None = None
    for r in range(runs):
        m = learn(train.where(uniform(F.col(key), 1000 + r) < share), columns, label)
        got = m.apply(test.where(F.col(label).isNotNull()), "_p", None).select(F.col(key).alias("k"), F.col(label).cast("string").alias("y"), F.col("_p"))
        rows = got if rows is None else rows.unionByName(got)
    p = rows.groupBy("k", "y", "_p").agg((F.count(F.lit(1)) / runs).alias("p"))
    per = p.groupBy("k", "y").agg(F.sum(F.when(F.col("_p") == F.col("y"), F.col("p")).otherwise(0.0)).alias("own"), F.sum(F.col("p") * F.col("p")).alias("q"))
    # For a row with one observed label the bias is half of sum over labels of (1[y] - p)^2, less the variance of the estimate.
    spread = (F.col("q") - 2 * F.col("own") + 1) / 2 - (1 - F.col("q")) / (2 * max(1, runs - 1))
    return per.agg(F.round(F.avg(1 - F.col("own")), 6).alias("error"), F.round(F.avg(spread), 6).alias("bias_squared"), F.round(F.avg((1 - F.col("q")) / 2 * runs / max(1, runs - 1)), 6).alias("variance"))


def cross_bias_variance(learn: Learn, df: DataFrame, columns: list[str], label: str, key: str, folds: int = 3, repeats: int = 5) -> DataFrame:
    """The same by repeated cross-validation: every row is tested ``repeats`` times by models that did not see it."""
    rows: DataFrame | None = None
    for r in range(repeats):
        part = F.floor(uniform(F.col(key), 2000 + r) * folds)
        for f in range(folds):
            m = learn(df.where(part != f), columns, label)
            got = m.apply(df.where((part == f) & F.col(label).isNotNull()), "_p", None).select(F.col(key).alias("k"), F.col(label).cast("string").alias("y"), F.col("_p"))
            rows = got if rows is None else rows.unionByName(got)
    p = rows.groupBy("k", "y", "_p").agg((F.count(F.lit(1)) / repeats).alias("p"))
    per = p.groupBy("k", "y").agg(F.sum(F.when(F.col("_p") == F.col("y"), F.col("p")).otherwise(0.0)).alias("own"), F.sum(F.col("p") * F.col("p")).alias("q"))
    return per.agg(F.round(F.avg(1 - F.col("own")), 6).alias("error"), F.round(F.avg((F.col("q") - 2 * F.col("own") + 1) / 2), 6).alias("bias_squared"), F.round(F.avg((1 - F.col("q")) / 2), 6).alias("variance"))


def check_learner(learn: Learn, spark: SparkSession) -> dict[str, bool]:
    """What a learner can do: nominal and numeric attributes, missing values, missing classes, several classes, one class,
    the same model from reordered rows, and no change of its input."""
    rows = [(i, "pqr"[i % 3], float(i % 7), "xy"[(i % 3 == 0) * 1], "xyz"[i % 3], None if i % 5 == 0 else "pq"[i % 2], None if i % 4 == 0 else "xy"[i % 2], "x") for i in range(60)]
    df = cut(spark.createDataFrame(rows, "k int, a string, n double, two string, three string, gaps string, holes string, one string"))

    def works(f: Callable[[], bool]) -> bool:
        try:
            return bool(f())
        except Exception:  # what a learner cannot do may end in any error
            return False

    fits = lambda c, y, d=df: learn(d, c, y).apply(d, "_p", None).where("_p IS NULL").count() == 0
    same = lambda: [r["_p"] for r in learn(df, ["a", "n"], "two").apply(df, "_p", None).orderBy("k").collect()] == [r["_p"] for r in learn(df.orderBy(F.desc("k")), ["a", "n"], "two").apply(df, "_p", None).orderBy("k").collect()]
    return {"nominal": works(lambda: fits(["a"], "two")), "numeric": works(lambda: fits(["n"], "two")), "missing values": works(lambda: fits(["gaps"], "two")), "missing classes": works(lambda: fits(["a"], "holes")), "several classes": works(lambda: fits(["a"], "three")), "one class": works(lambda: fits(["a"], "one")), "order of rows": works(same)}


def as_sql(root, codings: list, classes: list[str], table: str, columns: list[str]) -> str:
    """A tree of ``trees.grow`` as an SQL statement over a table: a nested CASE that gives the label."""
    quote = lambda x: "'" + str(x).replace("'", "''") + "'"

    def case(node) -> str:
        if not node.children:
            return quote(classes[int(node.stats.argmax())])
        c, last = codings[node.attribute], case(node.children[node.heaviest()])
        if node.at is not None:
            left = f"coalesce(`{c.column}` <= {float(c.cuts[node.at])!r}, {str(node.heaviest() == 0).lower()})"
            return f"CASE WHEN {left} THEN {case(node.children[0])} ELSE {case(node.children[1])} END"
        arms = " ".join(f"WHEN {quote(x)} THEN {case(child)}" for x, child in zip(c.labels, node.children))
        return f"CASE CAST(`{c.column}` AS STRING) {arms} ELSE {last} END"

    return f"SELECT {', '.join(columns)}, {case(root)} AS prediction FROM {table}"


def dealt(df: DataFrame, folds: int, key: str) -> DataFrame:
    return with_folds(df, folds, key)
