"""Learners as aggregations (counts, sums) and as pyspark.ml estimators, with one interface for the latter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import contingency


def zero_rule(df: DataFrame, label: str) -> DataFrame:
    """The commonest class (first in order on ties) and its share."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count()
    return counts.agg(F.min_by(label, F.struct(-F.col("count"), F.col(label))).alias("prediction"), F.round(F.max("count") / F.sum("count"), 6).alias("share"))


def one_rule_model(df: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """attribute, value, prediction of the attribute whose one-level rule is right most often (first on ties)."""
    counts = contingency(df, attributes, label)
    rules = counts.groupBy("attribute", "value").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("prediction"), F.max("n").alias("right"))
    best = rules.groupBy("attribute").agg(F.sum("right").alias("right")).agg(F.min_by("attribute", F.struct(-F.col("right"), F.col("attribute"))).alias("attribute"))
    return rules.join(F.broadcast(best), "attribute").select("attribute", "value", "prediction")


def naive_bayes_counts(df: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """attribute, value, label, probability with one added to each count of a value that the attribute takes."""
    counts = contingency(df, attributes, label)
    values = counts.groupBy("attribute").agg(F.count_distinct("value").alias("k"))
    classes = counts.groupBy("attribute", "label").agg(F.sum("n").alias("total"))
    grid = counts.select("attribute", "value").distinct().join(classes, "attribute")
    cells = grid.join(counts, ["attribute", "value", "label"], "left").join(values, "attribute")
    return cells.select("attribute", "value", "label", F.round((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("k")), 8).alias("probability"))


def naive_bayes_predict(df: DataFrame, model: DataFrame, attributes: list[str], label: str, key: str, trained: DataFrame | None = None) -> DataFrame:
    """key, prediction, from log probabilities summed over attributes; priors of ``trained`` (else ``df``) with one added.

    Every row has a prediction: a value that the model does not know says nothing.
    """
    priors = (trained if trained is not None else df).where(F.col(label).isNotNull()).groupBy(label).count()
    k = priors.agg(F.count(F.lit(1)).alias("k"), F.sum("count").alias("n")).first()
    prior = priors.select(F.col(label).cast("string").alias("label"), F.log((F.col("count") + 1) / F.lit(float((k["n"] or 0) + k["k"]))).alias("prior"))
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    long = df.select(key, F.explode(pairs).alias("x")).select(key, "x.*")
    logs = long.join(model, ["attribute", "value"]).groupBy(key, "label").agg(F.sum(F.log("probability")).alias("score"))
    every = df.select(key).join(F.broadcast(prior))  # one row a label
    total = every.join(logs, [key, "label"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)) + F.col("prior"))
    return total.groupBy(key).agg(F.min_by("label", F.struct(-F.round("score", 9), F.col("label"))).alias("prediction"))


def gaussian_model(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """label, attribute, mean, deviation for numeric attributes."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(pairs).alias("p")).select("label", "p.*")
    return long.groupBy("label", "attribute").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("deviation"), F.count("x").alias("n"))


def decision_stump(df: DataFrame, column: str, label: str) -> DataFrame:
    """cut, gini: the split of a numeric column with the least weighted impurity.

    Counts by distinct value are cumulated with range-partitioned prefix sums, so the rows of a column are never in one
    task; the smallest cut wins ties.  Without a row the cut is null; more than 1000 labels are an error.
    """
    from .columns import labels_of

    labels = labels_of(df, label, 1000)
    if not labels:
        return df.sparkSession.createDataFrame([(None, None)], "cut double, gini double")
    counts = df.where(F.col(column).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(*[F.sum((F.col(label) == x).cast("long")).alias(f"c{i}") for i, x in enumerate(labels)])
    from pyspark.sql import Window

    from .relational import numbered

    n = numbered(counts, "v").withColumn("_p", F.floor(F.col("rid") / 4096))
    names = [f"c{i}" for i in range(len(labels))]
    sums = {r["_p"]: r for r in n.groupBy("_p").agg(*[F.sum(c).alias(c) for c in names]).collect()}
    rows, run = [], [0] * len(names)
    for p in sorted(sums):
        rows.append((p, *run))
        run = [a + sums[p][c] for a, c in zip(run, names)]
    offsets = df.sparkSession.createDataFrame(rows, "_p long, " + ", ".join(f"o{i} long" for i in range(len(names))))
    w = Window.partitionBy("_p").orderBy("v")
    cum = n.join(F.broadcast(offsets), "_p").withColumns({f"l{i}": F.col(f"o{i}") + F.sum(f"c{i}").over(w) for i in range(len(names))})
    left = sum(F.col(f"l{i}") for i in range(len(names)))
    total = sum(run)
    right = F.lit(total) - left
    square = lambda parts: sum(p * p for p in parts)
    impurity = left - F.try_divide(square([F.col(f"l{i}") for i in range(len(names))]), left) + F.when(right > 0, right - square([F.lit(t) - F.col(f"l{i}") for i, t in enumerate(run)]) / right).otherwise(F.lit(0.0))
    scored = cum.select(F.col("v").alias("cut"), F.round(impurity / F.lit(float(max(total, 1))), 9).alias("gini"))
    return scored.agg(F.min(F.struct("gini", "cut")).alias("x")).select("x.cut", "x.gini")


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept, r_squared of one predictor, in one aggregation."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return both.agg(F.round(F.regr_slope(b, a), 6).alias("slope"), F.round(F.regr_intercept(b, a), 4).alias("intercept"), F.round(F.regr_r2(b, a), 6).alias("r_squared"))


def linear_regression(df: DataFrame, columns: list[str], y: str, ridge: float = 1e-8) -> dict[str, float]:
    """Ridge least squares by the normal equations: one pass of sums, a small solve on the driver."""
    import numpy as np

    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    target = F.col(y).cast("double")
    k = len(terms)
    row = df.dropna(subset=[*columns, y]).agg(*[F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(t * target).alias(f"b{i}") for i, t in enumerate(terms)]).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    b = np.array([row[f"b{i}"] or 0.0 for i in range(k)])
    a[range(1, k), range(1, k)] += ridge
    solved = np.linalg.lstsq(a, b, rcond=None)[0]
    return dict(zip(["(intercept)", *columns], map(float, solved)))


def hyper_pipes(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """label, attribute, least, largest."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(pairs).alias("p")).select("label", "p.*")
    return long.groupBy("label", "attribute").agg(F.min("x").alias("least"), F.max("x").alias("largest"))


def estimator(name: str, **options):
    """A pyspark.ml estimator by the name of the method."""
    from pyspark.ml import classification as c
    from pyspark.ml import clustering as k
    from pyspark.ml import regression as r

    kinds = {
        "logistic": c.LogisticRegression, "naive_bayes": c.NaiveBayes, "decision_tree": c.DecisionTreeClassifier, "random_forest": c.RandomForestClassifier,
        "linear_svm": c.LinearSVC, "multilayer_perceptron": c.MultilayerPerceptronClassifier, "boosted_trees": c.GBTClassifier, "regression_tree": r.DecisionTreeRegressor,
        "linear_regression": r.LinearRegression, "boosted_regression": r.GBTRegressor, "k_means": k.KMeans, "gaussian_mixture": k.GaussianMixture,
    }
    return kinds[name](**options)


def fit_predict(df: DataFrame, method: str, columns: list[str], label: str | None = None, test: DataFrame | None = None, **options) -> DataFrame:
    """``test`` (else ``df``) with ``prediction`` of a model of ``df``: columns are assembled and labels coded; rows with a null
    among the columns are skipped."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    made = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")
    data = made.transform(df)
    asked = data if test is None else made.transform(test)
    if label is None:
        return estimator(method, featuresCol="features", **options).fit(data).transform(asked).drop("features")
    if dict(df.dtypes)[label] == "string":
        coder = StringIndexer(inputCol=label, outputCol="_label", handleInvalid="skip", stringOrderType="alphabetAsc").fit(data)
        out = estimator(method, featuresCol="features", labelCol="_label", **options).fit(coder.transform(data)).transform(asked)
        names = F.array(*[F.lit(x) for x in coder.labels])
        return out.withColumn("prediction", names[F.col("prediction").cast("int")]).drop("features", "rawPrediction", "probability")
    return estimator(method, featuresCol="features", labelCol=label, **options).fit(data).transform(asked).drop("features", "rawPrediction", "probability")
