"""Queries of attribute selection, Bayes networks, experiments, densities, more rules, scalars, matrices, sources, streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry
from ..functions import scalars
from ..functions import tables as contingency
from ..operators import bayes, densities, experiments, features, learners, linkage, matrices, models, networks, rows, rulesets, selection, trees
from ..operators.relational import cut
from ..sources import arff, generators, tables
from ..streaming import flows, incremental
from .catalog import _CLASS, _COUNTS, _TOKENS, _items, query, table
from .catalog_learners import _CASE, _CONCEPT, COLUMNS, _c45, _confusion, _rows
from .catalog_rows import _u

# Attribute selection


@query(f"""WITH c AS ({_COUNTS}), t AS (SELECT attribute, sum(n) AS t, sum(n * log2(n)) AS j FROM c GROUP BY 1), k AS (SELECT attribute, sum(n * log2(n)) AS k FROM (SELECT attribute, label, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT attribute, sum(n * log2(n)) AS v FROM (SELECT attribute, value, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1), m AS (SELECT attribute, round(log2(t) - k / t + log2(t) - v / t - (log2(t) - j / t), 6) AS merit FROM t JOIN k USING (attribute) JOIN v USING (attribute))
SELECT attribute, merit, row_number() OVER (ORDER BY merit DESC, attribute)::INTEGER AS rank FROM m QUALIFY rank <= 2""")
def ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.ranked(features.entropy_merits(_items(spark, sf_dir), _CLASS["attributes"], _CLASS["label"]), "info_gain", keep=2)


@query()
def relief_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("y"))
    return selection.relief(p, ["p_size", "p_retailprice"], "y", "p_partkey", 5, p.where("p_partkey % 20 = 0"))


@query("SELECT 0 AS place, 'q' AS attribute")
def svm_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _rows(spark, sf_dir, "CASE WHEN p_partkey % 8 <= 3 THEN 'x' ELSE 'z' END")
    noisy = train.withColumns({"u": rows.uniform(F.col("k"), 3), "v": rows.uniform(F.col("k"), 4)})
    return spark.createDataFrame([(0, selection.svm_elimination(noisy, ["u", "q", "v"], "y")[0])], "place int, attribute string")


def _subset(spark: SparkSession, found: list[str]) -> DataFrame:
    return spark.createDataFrame([(",".join(sorted(found)),)], "subset string")


def _nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(_rows(spark, sf_dir, _CASE)[0].withColumn("q", F.col("q").cast("string")))


_ID3 = lambda d, c, y, weight=None: trees.id3(d, c, y, weight)


@query("SELECT 'a,q' AS subset")
def wrapper_best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _nominal(spark, sf_dir)
    return _subset(spark, selection.best_first(COLUMNS, selection.wrapper(_ID3, d, "y", "k", 2)))


@query("SELECT 'a,q' AS subset")
def classifier_subset_random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _nominal(spark, sf_dir)
    return _subset(spark, selection.random_search(COLUMNS, selection.by_classifier(_ID3, d.where("k % 5 < 3"), d.where("k % 5 >= 3"), "y"), 2.0))


@query("SELECT 'a,q' AS subset")
def genetic_attribute_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _nominal(spark, sf_dir)
    return _subset(spark, selection.genetic_search(COLUMNS, selection.by_classifier(_ID3, d.where("k % 5 < 3"), d.where("k % 5 >= 3"), "y"), 6, 6, mutation=0.3))


@query("SELECT 'a,q' AS subset")
def race_attribute_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _nominal(spark, sf_dir)

    def errors(subset: list[str], fold: int) -> list[float]:
        train, test = d.where(F.col("k") % 3 != fold), d.where(F.col("k") % 3 == fold)
        m = _ID3(train, subset, "y") if subset else models.constant(models.classes_of(train, "y"), models.class_counts(train, "y", models.classes_of(train, "y")))
        r = m.apply(test, "_p", None).groupBy((F.col("k") % 20).alias("g")).agg(F.avg((F.col("_p") != F.col("y")).cast("double")).alias("e")).orderBy("g").collect()
        return [x["e"] for x in r]

    d = cut(d.withColumn("k", F.monotonically_increasing_id() % 1000))
    return _subset(spark, selection.race_search(COLUMNS, errors, 3))


@query("SELECT 'a,q' AS subset")
def rank_attribute_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _nominal(spark, sf_dir)
    order = [r["attribute"] for r in selection.ranked(features.entropy_merits(d, COLUMNS, "y"), "info_gain").orderBy("rank").collect()]
    return _subset(spark, selection.rank_search(order, selection.by_classifier(_ID3, d.where("k % 5 < 3"), d.where("k % 5 >= 3"), "y")))


@query(f"SELECT p_type AS a, (p_partkey % 8)::VARCHAR AS q, {_CASE} AS y FROM part WHERE p_partkey % 3 <> 0")
def attribute_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _nominal(spark, sf_dir)
    merit = selection.by_classifier(_ID3, d.where("k % 5 < 3"), d.where("k % 5 >= 3"), "y")
    return selection.select(d.select("a", "b", "q", "y"), COLUMNS, selection.greedy_stepwise, merit, ["y"])


# Bayes networks

_NODES = ["a", "z", "w"]
_CODED = "SELECT p_type AS a, CASE WHEN p_type IN ('LARGE', 'SMALL') THEN 'size' ELSE 'other' END AS z, (p_partkey % 2)::VARCHAR AS w FROM part"
_LINK = "SELECT 'a' AS node, 'z' AS other"


def _network_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_type AS a", "CASE WHEN p_type IN ('LARGE', 'SMALL') THEN 'size' ELSE 'other' END AS z", "CAST(p_partkey % 2 AS string) AS w")


def _links(spark: SparkSession, structure: networks.Structure) -> DataFrame:
    found = sorted({tuple(sorted((n, p))) for n, parents in structure.items() for p in parents})
    return spark.createDataFrame(found, "node string, other string")


def _search(name: str, run) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _links(spark, run(_network_rows(spark, sf_dir)))

    f.__name__ = name
    query(_LINK)(f)


def _local(d: DataFrame, kind: str = "mdl") -> networks.Scores:
    return networks.Scores(d, _NODES, kind)


_search("network_k2_local", lambda d: networks.k2_search(_local(d), _NODES))
_search("network_hill_climber", lambda d: networks.hill_climb(_local(d), networks.empty(_NODES)))
_search("network_repeated_hill_climber", lambda d: networks.repeated_hill_climb(_local(d), _NODES, 2))
_search("network_tabu_search", lambda d: networks.tabu_search(_local(d), networks.empty(_NODES), steps=6))
_search("network_annealing", lambda d: networks.anneal(_local(d), networks.empty(_NODES), steps=80, temperature=20.0))
_search("network_genetic", lambda d: networks.genetic_structures(_local(d), _NODES, 8, 8))
_search("network_independence", lambda d: networks.independence_search(_local(d)))


def _global(d: DataFrame) -> networks.CrossScores:
    return networks.CrossScores(d, _NODES, "z", "k", 2)


_search("network_k2_global", lambda d: networks.k2_search(_global(d), _NODES, 1))
_search("network_hill_climber_global", lambda d: networks.hill_climb(_global(d), networks.empty(_NODES), 1, 3))
_search("network_repeated_climber_global", lambda d: networks.repeated_hill_climb(_global(d), ["a", "z"], 2, 1))
_search("network_tabu_global", lambda d: networks.tabu_search(_global(d), {"a": [], "z": []}, 1, 2))
_search("network_annealing_global", lambda d: networks.anneal(_global(d), {"a": [], "z": []}, 1, 12))
_search("network_genetic_global", lambda d: networks.genetic_structures(_global(d), ["a", "z"], 4, 2, 1))


@query("SELECT 'a' AS node, 'w' AS other UNION ALL SELECT 'a', 'z' UNION ALL SELECT 'w', 'z'")
def network_tree_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, networks.tree_augmented(_local(_network_rows(spark, sf_dir)), "z"))


@query("SELECT 'a' AS node, 'w' AS other UNION ALL SELECT 'a', 'z' UNION ALL SELECT 'w', 'z'")
def network_tree_augmented_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, networks.global_tree_augmented(_global(_network_rows(spark, sf_dir)), "z"))


@query(f"WITH d AS ({_CODED}), c AS (SELECT a, z, count(*) AS n FROM d GROUP BY 1, 2), g AS (SELECT DISTINCT c.a, d.z FROM c, d) SELECT a, z, round((coalesce(n, 0) + 0.5) / ((SELECT sum(n) FROM c x WHERE x.a = g.a) + 0.5 * 2), 8) AS p FROM g LEFT JOIN c USING (a, z)")
def network_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = networks.tables(_network_rows(spark, sf_dir), {"a": [], "z": ["a"]})
    return spark.createDataFrame([(k[0], x, round(p, 8)) for k, t in made["z"].items() if k for x, p in t.items()], "a string, z string, p double")


@query(f"WITH d AS ({_CODED}), c AS (SELECT a, z, count(*) AS n FROM d GROUP BY 1, 2), g AS (SELECT DISTINCT c.a, d.z FROM c, d) SELECT a, z, round((coalesce(n, 0) + 0.5) / ((SELECT sum(n) FROM c x WHERE x.a = g.a) + 0.5 * 2), 6) AS p FROM g LEFT JOIN c USING (a, z)")
def network_averaged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = networks.averaged_tables(_network_rows(spark, sf_dir), {"a": [], "z": ["a"]})
    return spark.createDataFrame([(k[0], x, round(p, 6)) for k, t in made["z"].items() if k for x, p in t.items()], "a string, z string, p double")


@query(f"SELECT z AS y, z AS prediction, count(*) AS n FROM ({_CODED}) GROUP BY 1")
def network_classifier_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _network_rows(spark, sf_dir)
    structure = networks.naive(_NODES, "z")
    made, again = networks.from_bif(networks.to_bif(networks.tables(d, structure), structure))
    return networks.classifier(made, again, "z").apply(d, "prediction", None).groupBy(F.col("z").alias("y"), "prediction").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CASE WHEN {_u("i || '/a'")} < 0.25 THEN 'x' ELSE 'y' END AS a, count(*) AS n FROM range(1000) t(i) GROUP BY 1")
def network_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {"a": {(): {"x": 0.25, "y": 0.75}}, "b": {(): {"u": 0.5, "v": 0.5}, ("x",): {"u": 0.9, "v": 0.1}, ("y",): {"u": 0.1, "v": 0.9}}}
    return networks.sampled(spark, made, {"a": [], "b": ["a"]}, 1000).groupBy("a").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2")
def network_count_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.cached_counts(_items(spark, sf_dir), ["l_returnflag", "l_linestatus", "l_linenumber"])(["l_returnflag", "l_linenumber"])


# Experiments

_RUN = "c AS (SELECT l_discount AS t, count(*) FILTER (l_linestatus = 'F') AS p, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT t, sum(p) OVER (ORDER BY t DESC) AS tp, sum(n - p) OVER (ORDER BY t DESC) AS fp, sum(p) OVER () AS a, sum(n - p) OVER () AS b FROM c)"


@query(f"WITH {_RUN} SELECT t AS threshold, round(fp / b, 6) AS at_0, round((a - tp) / a, 6) AS at_1 FROM s")
def cost_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.cost_curve(table(spark, sf_dir, "lineitem").select("l_discount", (F.col("l_linestatus") == "F").alias("y")), "y", "l_discount")


@query("""WITH m AS (SELECT round(CASE WHEN l_linestatus = 'F' THEN p - (1 - p) ELSE (1 - p) - p END, 9) AS m FROM (SELECT l_linestatus, l_quantity / 50 AS p FROM lineitem))
SELECT m AS margin, count(*) AS current, sum(count(*)) OVER (ORDER BY m)::BIGINT AS cumulative FROM m GROUP BY 1""")
def margin_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_quantity") / 50).alias("pf"), (1 - F.col("l_quantity") / 50).alias("po"))
    return experiments.margins(d, "l_linestatus", {"F": "pf", "O": "po"})


@query(_CONCEPT.format(y=_CASE).replace("y, y AS prediction", "y AS actual, y AS predicted"))
def nominal_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, _CASE)
    got = experiments.nominal_predictions(_c45(train, COLUMNS, "y"), test, "y", "k").where("margin > 0")
    return got.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(avg(l_quantity * 1000 - l_extendedprice), 4) AS bias, count(*) AS n FROM lineitem")
def numeric_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_quantity") * 1000)
    return experiments.numeric_predictions(d, "l_extendedprice", "p", "l_orderkey").agg(F.round(F.avg("error"), 4).alias("bias"), F.count(F.lit(1)).alias("n"))


_TRAIN = "SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 0"


@query(f"WITH n AS (SELECT count(*) AS n FROM ({_TRAIN})) SELECT 'tree' AS scheme, 1 AS run, f::INTEGER AS fold, (n // 2 + (f - 1 < n % 2)::INT)::DOUBLE AS rows, 1.0::DOUBLE AS correct, 1.0::DOUBLE AS kappa FROM n, (SELECT unnest([1, 2]) AS f)")
def cross_validation_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cut(_rows(spark, sf_dir, _CASE)[0])
    return experiments.run_experiment(spark, {"tree": _c45}, experiments.cross_validation(d, "k", 2), COLUMNS, "y").select("scheme", "run", "fold", "rows", "correct", "kappa")


@query(f"SELECT 'tree' AS scheme, run, (SELECT count(*) FROM ({_TRAIN}) WHERE (('0x' || substr(md5(run || ':' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE) >= 0.66)::DOUBLE AS rows, 1.0::DOUBLE AS correct FROM (SELECT unnest([1, 2]) AS run)")
def random_split_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cut(_rows(spark, sf_dir, _CASE)[0])
    return experiments.run_experiment(spark, {"tree": _c45}, experiments.random_splits(d, "k", 66, 2), COLUMNS, "y").select("scheme", "run", "rows", "correct")


@query(f"SELECT 'tree' AS scheme, size, (SELECT count(*) FROM ({_TRAIN}) WHERE {_u('k')} >= 0.66)::DOUBLE AS rows FROM (SELECT unnest([50, 100]) AS size)")
def learning_rate_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cut(_rows(spark, sf_dir, _CASE)[0])
    splits = experiments.learning_rates(experiments.random_splits(d, "k", 66, 1), "k", [50, 100])
    return experiments.run_experiment(spark, {"tree": _c45}, splits, COLUMNS, "y").select("scheme", "size", "rows")


@query("SELECT s_nationkey AS run, s_suppkey AS fold FROM supplier WHERE s_acctbal < 0")
def results_still_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("run"), F.col("s_suppkey").alias("fold"), "s_acctbal")
    path = _path(spark, "results")
    experiments.store(s.where("s_acctbal >= 0"), path)
    return experiments.missing_keys(s.select("run", "fold"), spark.read.parquet(path), ["run", "fold"])


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def results_as_csv_and_arff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    csv, text = _path(spark, "csv"), _path(spark, "arff")
    experiments.store(n.where("k < 10"), csv, "csv")
    experiments.store(n.where("k >= 10"), text, "arff")
    one = spark.read.option("header", True).schema("k int, name string").csv(csv)
    return one.unionByName(arff.read(spark, text).select(F.col("k").cast("int").alias("k"), "name"))


_MONTHS = "SELECT o_orderstatus AS s, month(o_orderdate) AS m, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2"


@query(f"""WITH r AS ({_MONTHS}), d AS (SELECT a.s AS scheme, a.v AS x, b.v AS y FROM r a JOIN r b ON a.m = b.m AND b.s = 'F' WHERE a.s <> 'F')
SELECT scheme, count(*) AS n, round(avg(x), 4) AS mean, round(avg(y), 4) AS base_mean, round(avg(x - y) / sqrt(var_samp(x - y) * (1 / count(*) + 0.1)), 4) AS t FROM d GROUP BY 1""")
def schemes_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("s"), F.month("o_orderdate").alias("m")).agg(F.avg("o_totalprice").alias("v"))
    return experiments.compared(runs, "s", "v", ["m"], "F", 0.1).select("scheme", "n", F.round("mean", 4).alias("mean"), F.round("base_mean", 4).alias("base_mean"), F.round("t", 4).alias("t"))


@query("SELECT 0.0::DOUBLE AS error, 0.0::DOUBLE AS variance")
def bias_and_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, _CASE)
    return experiments.bias_variance(_ID3, cut(train.withColumn("q", F.col("q").cast("string"))), cut(test.withColumn("q", F.col("q").cast("string"))), ["a", "q"], "y", "k", 3, 0.9).select("error", "variance")


@query("SELECT 0.0::DOUBLE AS error, 0.0::DOUBLE AS bias_squared, 0.0::DOUBLE AS variance")
def cross_bias_and_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.cross_bias_variance(_ID3, _nominal(spark, sf_dir), ["a", "q"], "y", "k", 2, 2)


@query("SELECT unnest(['nominal', 'numeric', 'missing values', 'missing classes', 'several classes', 'one class', 'order of rows']) AS can, true AS holds")
def learner_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(experiments.check_learner(bayes.naive_bayes, spark).items()), "can string, holds boolean")


@query(_CONCEPT.format(y=_CASE))
def model_as_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, _CASE)
    name = f"rows_{uuid.uuid4().hex}"
    test.createOrReplaceTempView(name)
    classes = models.classes_of(train, "y")
    root, codings = trees.grow(train, COLUMNS, "y", classes=classes, ratio=True)
    return _confusion(spark.sql(experiments.as_sql(root, codings, classes, name, ["y"])))


# Densities and clusters

_D = "exp(0 - (({p} - {x}) / {w}) ^ 2 / 2) / ({w} * sqrt(2 * pi()))"


@query("SELECT l_returnflag AS given, round(avg(round(l_quantity / 5) * 5), 6) AS mean, round(greatest(stddev_pop(round(l_quantity / 5) * 5), 5 / 6), 6) AS deviation FROM lineitem GROUP BY 1")
def normal_given_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densities.normal_given_label(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", 5.0)


@query(f"SELECT l_returnflag AS given, p::DOUBLE AS point, round(avg({_D.format(p='p', x='l_quantity', w='4.0::DOUBLE')}), 8) AS density FROM lineitem, (VALUES (10.0::DOUBLE), (40.0)) t(p) GROUP BY 1, 2")
def kernel_given_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densities.kernel_given_label(table(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag", [10, 40], 4.0)


@query(f"WITH d AS (SELECT l_returnflag AS value, p::DOUBLE AS point, sum({_D.format(p='p', x='l_quantity', w='4.0::DOUBLE')}) AS d FROM lineitem, (VALUES (10.0::DOUBLE), (40.0)) t(p) GROUP BY 1, 2) SELECT point, value, round(d / sum(d) OVER (PARTITION BY point), 8) AS probability FROM d")
def label_given_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densities.label_given_kernel(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", [10, 40], 4.0)


@query(f"WITH m AS (SELECT l_returnflag AS value, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT value, p::DOUBLE AS point, n * {_D.format(p='p', x='m', w='s')} AS d FROM m, (VALUES (10.0::DOUBLE), (40.0)) t(p)) SELECT point, value, round(d / sum(d) OVER (PARTITION BY point), 8) AS probability FROM d")
def label_given_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densities.label_given_normal(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", [10, 40])


_POINTS = [(0.04, 10.0), (0.06, 40.0)]


@query(f"WITH z AS (SELECT p::DOUBLE AS p, g::DOUBLE AS g FROM (VALUES (0.04, 10.0), (0.06, 40.0)) t(p, g)) SELECT p AS point, g AS given, round(sum({_D.format(p='g', x='l_quantity', w='4.0::DOUBLE')} * {_D.format(p='p', x='l_tax', w='0.02::DOUBLE')}) / sum({_D.format(p='g', x='l_quantity', w='4.0::DOUBLE')}), 6) AS density FROM lineitem, z GROUP BY 1, 2")
def kernel_given_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densities.kernel_given_kernel(table(spark, sf_dir, "lineitem"), "l_tax", "l_quantity", _POINTS, 0.02, 4.0).withColumn("density", F.round("density", 6))


@query(f"WITH s AS (SELECT avg(l_tax) AS mx, avg(l_quantity) AS my, var_pop(l_tax) AS vx, var_pop(l_quantity) AS vy, covar_pop(l_tax, l_quantity) AS c FROM lineitem), z AS (SELECT p::DOUBLE AS p, g::DOUBLE AS g FROM (VALUES (0.04, 10.0), (0.06, 40.0)) t(p, g)), e AS (SELECT p, g, mx + c / vy * (g - my) AS m, sqrt(vx - c * c / vy) AS d FROM s, z) SELECT p AS point, g AS given, round({_D.format(p='p', x='m', w='d')}, 6) AS density FROM e")
def normal_given_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densities.normal_given_normal(table(spark, sf_dir, "lineitem"), "l_tax", "l_quantity", _POINTS).withColumn("density", F.round("density", 6))


@query("""WITH s AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, var_pop(p_size) AS a, covar_pop(p_size, p_retailprice) AS b, var_pop(p_retailprice) AS d FROM part)
SELECT p_partkey, round((d * (p_size - mx) ^ 2 - 2 * b * (p_size - mx) * (p_retailprice - my) + a * (p_retailprice - my) ^ 2) / (a * d - b * b), 3) AS distance FROM part, s""")
def mahalanobis_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densities.mahalanobis(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], "p_partkey").select("p_partkey", F.round("distance", 3).alias("distance"))


@query("""WITH c AS (SELECT p_size > 25 AS c, avg(p_size) AS m, stddev_pop(p_size) AS s, (count(*) + 1) / ((SELECT count(*) FROM part) + 2) AS p FROM part GROUP BY 1)
SELECT count(*) AS rows, round(avg(l), 5) AS log_likelihood FROM (SELECT p_partkey, ln(sum(p * exp(0 - ((p_size - m) / s) ^ 2 / 2) / (s * sqrt(2 * pi())))) AS l FROM part, c GROUP BY 1)""")
def density_based_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("c", (F.col("p_size") > 25).cast("int"))
    return densities.log_likelihood(p, ["p_size"], densities.density_of_clusters(p, ["p_size"], "c")).select("rows", F.round("log_likelihood", 5).alias("log_likelihood"))


@query("SELECT CASE WHEN p_partkey % 10 = 0 THEN 'other' ELSE p_type END AS cluster, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS label, count(*) AS rows, count(*) FILTER (p_partkey % 10 = 0) AS wrong FROM part GROUP BY 1, 2")
def classes_to_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("c", F.when(F.col("p_partkey") % 10 == 0, "other").otherwise(F.col("p_type")))
    return densities.classes_to_clusters(p, "c", "p_type")


@query()
def cobweb_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("s"), (F.col("p_size") > 25).cast("string").alias("t"))
    return densities.cobweb(p, ["s", "t"], "p_partkey").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


# Rules

_ITEMS = "SELECT 'o_orderpriority=' || o_orderpriority AS p, 'o_orderstatus=' || o_orderstatus AS s FROM orders"


@query(f"SELECT p AS items, count(*) AS support FROM ({_ITEMS}) GROUP BY 1 UNION ALL SELECT s, count(*) FROM ({_ITEMS}) GROUP BY 1 UNION ALL SELECT p || '|' || s, count(*) FROM ({_ITEMS}) GROUP BY 1")
def item_set_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus")
    return rulesets.supports(o, ["o_orderpriority", "o_orderstatus"], 2).withColumn("support", F.col("support").cast("long"))


@query("""WITH l AS (SELECT 'l_linestatus=' || l_linestatus AS p, l_returnflag AS y FROM lineitem UNION ALL SELECT 'l_linenumber=' || l_linenumber, l_returnflag FROM lineitem UNION ALL SELECT 'l_linenumber=' || l_linenumber || '|l_linestatus=' || l_linestatus, l_returnflag FROM lineitem)
SELECT p AS premise, y AS label, count(*) AS support, round(count(*) / any_value(t), 6) AS confidence FROM l JOIN (SELECT p, count(*) AS t FROM l GROUP BY 1) USING (p) GROUP BY 1, 2 HAVING count(*) >= 0.02 * (SELECT count(*) FROM lineitem) AND count(*) / any_value(t) >= 0.3""")
def class_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulesets.class_rules(_items(spark, sf_dir), ["l_linestatus", "l_linenumber"], "l_returnflag", 2, 0.02, 0.3).withColumn("support", F.col("support").cast("long"))


@query()
def predictive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").selectExpr("p_type AS a", "CASE WHEN p_type IN ('LARGE', 'SMALL') THEN 'size' ELSE 'other' END AS z", "CAST(p_partkey % 2 AS string) AS w")
    return rulesets.predictive_rules(d, ["a", "z", "w"], 5)


@query(f"""WITH d AS ({_CODED}), t AS (SELECT count(*) AS t FROM d), l AS (SELECT 'a=' || a AS b, 'z=' || z AS h, 'a' AS x FROM d), m AS (SELECT DISTINCT b, z AS h FROM l, (SELECT DISTINCT 'z=' || z AS z FROM d)),
c AS (SELECT m.b AS body, m.h AS head, (SELECT count(*) FROM l WHERE l.b = m.b) AS nb, (SELECT count(*) FROM l WHERE l.h = m.h) AS nh, (SELECT count(*) FROM l WHERE l.b = m.b AND l.h <> m.h) AS counter FROM m)
SELECT body, head, round((nb * (t - nh) / (t * t) - counter / t) / (sqrt(nb * (t - nh) / (t * t)) - nb * (t - nh) / (t * t)), 6) AS confirmation, counter FROM c, t WHERE counter = 0""")
def confirmed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _network_rows(spark, sf_dir)
    return rulesets.confirmed_rules(d, ["a", "z"], 1000, 1, 0.0).where("body LIKE 'a=%'")


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1")
def individuals_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulesets.of_individuals(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus"])


@query("SELECT o_custkey, max((o_orderstatus = 'F')::INT) AS \"o_orderstatus=F\", max((o_orderstatus = 'P')::INT) AS \"o_orderstatus=P\" FROM orders GROUP BY 1")
def individual_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rulesets.exists_literals(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "P"])


# Scalars and matrices

_ARR = "[p_size::DOUBLE, (p_partkey % 7)::DOUBLE, (p_partkey % 11)::DOUBLE]"


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double"), (F.col("p_partkey") % 11).cast("double")).alias("a"))


@query(f"SELECT p_partkey, list_position(a, list_max(a)) - 1 AS hi, list_position(a, list_min(a)) - 1 AS lo FROM (SELECT p_partkey, {_ARR} AS a FROM part)")
def max_and_min_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrays(spark, sf_dir).select("p_partkey", scalars.max_index(F.col("a")).alias("hi"), scalars.min_index(F.col("a")).alias("lo"))


@query(f"SELECT p_partkey, list_transform(a, lambda x: round(x / list_sum(a), 6)) AS shares, list_transform(a, lambda x: round(exp(x - list_max(a)) / list_sum(list_transform(a, lambda y: exp(y - list_max(a)))), 6)) AS soft FROM (SELECT p_partkey, {_ARR} AS a FROM part)")
def normalize_and_soften(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.transform(c, lambda x: F.round(x, 6))
    return _arrays(spark, sf_dir).select("p_partkey", r(scalars.normalized(F.col("a"))).alias("shares"), r(scalars.logs_to_probabilities(F.col("a"))).alias("soft"))


@query(f"SELECT p_partkey, list_sort(a)[2] AS second, list_grade_up(a)[1] - 1 AS least_at FROM (SELECT p_partkey, {_ARR} AS a FROM part)")
def sorted_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrays(spark, sf_dir).select("p_partkey", scalars.kth_of_array(F.col("a"), 2).alias("second"), scalars.sorted_index(F.col("a"))[0].alias("least_at"))


@query("SELECT s_suppkey, (sign(s_acctbal) * floor(abs(s_acctbal) + 0.5))::BIGINT AS whole, sign(s_acctbal) * floor(abs(s_acctbal) * 10 + 0.5) / 10 AS one, (floor(s_acctbal) + (" + _u("s_suppkey") + " < s_acctbal - floor(s_acctbal))::INT)::BIGINT AS chance FROM supplier")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select("s_suppkey", scalars.round_away(x).alias("whole"), scalars.round_to(x, 1).alias("one"), scalars.round_by_chance(x, F.col("s_suppkey")).alias("chance"))


@query("SELECT p_partkey, replace(p_name, 'e', '') AS less, replace(p_name, 'ring', 'band') AS other, rpad(p_name, greatest(12, length(p_name))::INTEGER, ' ') AS r, lpad(p_name, greatest(12, length(p_name))::INTEGER, ' ') AS l, CASE WHEN p_name LIKE '% %' THEN '''' || p_name || '''' ELSE p_name END AS q FROM part")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.without(t, "e").alias("less"), scalars.replaced(t, "ring", "band").alias("other"), scalars.padded(t, 12).alias("r"), scalars.padded(t, 12, left=True).alias("l"), scalars.quoted(t).alias("q"))


@query(f"SELECT s_suppkey, round(0 - ln(greatest(1 - {_u('s_suppkey')}, 1e-12)), 8) AS e, round(0 - ln(greatest(1 - {_u("s_suppkey || '/0'")}, 1e-12)) - ln(greatest(1 - {_u("s_suppkey || '/1'")}, 1e-12)), 8) AS g FROM supplier")
def random_variates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(scalars.exponential(k), 8).alias("e"), F.round(scalars.erlang(k, 2), 8).alias("g"))


@query("SELECT p_partkey, round(lgamma(p_size + 1.0::DOUBLE), 6) AS f, round((lgamma(p_size + 6.0::DOUBLE) - lgamma(6.0::DOUBLE) - lgamma(p_size + 1.0::DOUBLE)) / ln(2), 6) AS b, round((lgamma(p_size + 8.0::DOUBLE) - lgamma(p_size + 1.0::DOUBLE) - lgamma(5.0::DOUBLE) - lgamma(4.0::DOUBLE)) / ln(2), 6) AS m FROM part")
def factorials(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scalars.ln_factorial_upto(n), 6).alias("f"), F.round(scalars.log2_binomial(n + 5, n), 6).alias("b"), F.round(scalars.log2_multinomial(F.array(n, F.lit(4).cast("long"), F.lit(3).cast("long"))), 6).alias("m"))


@query("WITH c AS (SELECT l_returnflag AS y, l_linestatus AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT v, sum(n) AS r FROM c GROUP BY 1), k AS (SELECT y, sum(n) AS k FROM c GROUP BY 1), t AS (SELECT sum(n) AS t FROM c), e AS (SELECT n, r * k / t AS e FROM c JOIN r USING (v) JOIN k USING (y), t) SELECT round(sum((n - e) ^ 2 / e), 4) AS chi_squared, min(e) > 1 AND avg((e < 5)::INT) <= 0.2 AS cochran FROM e")
def contingency_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = features.contingency(_items(spark, sf_dir), ["l_linestatus"], "l_returnflag").collect()
    labels, values = sorted({r["label"] for r in c}), sorted({r["value"] for r in c})
    t = np.zeros((len(values), len(labels)))
    for r in c:
        t[values.index(r["value"]), labels.index(r["label"])] = r["n"]
    return spark.createDataFrame([(round(contingency.chi_squared(t), 4), contingency.cochran(t))], "chi_squared double, cochran boolean")


_XY = ["p_size", "p_retailprice"]


@query("SELECT sum(p_size::DOUBLE * p_size) AS a, round(sum(p_size * p_retailprice), 2) AS b, round(sum(p_retailprice * p_retailprice), 0) AS c FROM part")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = matrices.gram(table(spark, sf_dir, "part"), _XY)
    return spark.createDataFrame([(float(g[0, 0]), round(float(g[0, 1]), 2), float(round(g[1, 1], 0)))], "a double, b double, c double")


@query("WITH s AS (SELECT sum(p_size::DOUBLE * p_size) AS a, sum(p_size * p_retailprice) AS b, sum(p_retailprice * p_retailprice) AS c FROM part) SELECT round(sqrt(a), 4) AS r11, round(b / sqrt(a), 3) AS r12, round(sqrt(c - b * b / a), 2) AS r22 FROM s")
def triangular_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = matrices.triangle(table(spark, sf_dir, "part"), _XY)
    return spark.createDataFrame([(round(float(r[0, 0]), 4), round(float(r[0, 1]), 3), round(float(r[1, 1]), 2))], "r11 double, r12 double, r22 double")


@query("SELECT 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c")
def orthogonal_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = matrices.gram(matrices.orthogonal(table(spark, sf_dir, "part"), _XY, ["q1", "q2"]), ["q1", "q2"])
    return spark.createDataFrame([(round(float(g[0, 0]), 6), abs(round(float(g[0, 1]), 6)), round(float(g[1, 1]), 6))], "a double, b double, c double")


@query("WITH s AS (SELECT sum(p_size::DOUBLE * p_size) AS a, sum(p_size * p_retailprice) AS b, sum(p_retailprice * p_retailprice) AS c FROM part) SELECT round(sqrt((a + c + sqrt((a - c) ^ 2 + 4 * b * b)) / 2), 1) AS first, round(sqrt((a + c - sqrt((a - c) ^ 2 + 4 * b * b)) / 2), 1) AS second, 2 AS rank FROM s")
def singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    s, _ = matrices.singular_values(p, _XY)
    return spark.createDataFrame([(round(float(s[0]), 1), round(float(s[1]), 1), matrices.rank(p, _XY))], "first double, second double, rank int")


@query("WITH s AS (SELECT sum(p_size::DOUBLE * p_size) AS a, sum(p_size * p_retailprice) AS b, sum(p_retailprice * p_retailprice) AS c, sum(p_size * y) AS d, sum(p_retailprice * y) AS e FROM (SELECT *, 2.0::DOUBLE * p_size + 0.5 * p_retailprice + p_partkey % 3 AS y FROM part)) SELECT round((c * d - b * e) / (a * c - b * b), 4) AS x, round((a * e - b * d) / (a * c - b * b), 6) AS y FROM s")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("y", 2.0 * F.col("p_size") + 0.5 * F.col("p_retailprice") + F.col("p_partkey") % 3)
    x = matrices.least_squares(p, _XY, "y")
    return spark.createDataFrame([(round(float(x[0]), 4), round(float(x[1]), 6))], "x double, y double")


@query("SELECT round((a * d - b * b) / 1e6, 1) AS determinant FROM (SELECT var_pop(p_size) AS a, covar_pop(p_size, p_retailprice) AS b, var_pop(p_retailprice) AS d FROM part)")
def lu_determinant(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "part").agg(F.var_pop("p_size").alias("a"), F.covar_pop("p_size", "p_retailprice").alias("b"), F.var_pop("p_retailprice").alias("d")).first()
    return spark.createDataFrame([(round(matrices.determinant(np.array([[r["a"], r["b"]], [r["b"], r["d"]]])) / 1e6, 1),)], "determinant double")


@query("SELECT round(avg(p_size), 4) AS x, 20.0::DOUBLE AS y FROM part")
def bounded_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    loss = lambda v: (F.pow(size - F.lit(v[0]), F.lit(2.0)) + F.pow(size - F.lit(v[1]), F.lit(2.0)), [-2 * (size - F.lit(v[0])), -2 * (size - F.lit(v[1]))])
    x, _ = matrices.minimise(table(spark, sf_dir, "part"), loss, [0.0, 0.0], [-1e9, 0.0], [1e9, 20.0], tolerance=1e-12)
    return spark.createDataFrame([(round(x[0], 4), round(x[1], 4))], "x double, y double")


# Sources, registered names and streams


def _path(spark: SparkSession, name: str) -> str:
    cut(spark.range(1))  # names the shared folder where it is unset
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_name, p_size::DOUBLE AS p_size, p_type AS class FROM part")
def c45_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, data = _path(spark, "names"), _path(spark, "data")
    tables.write_c45(table(spark, sf_dir, "part").select("p_name", "p_size", "p_type"), names, data, "p_type")
    return tables.read_c45(spark, names, data)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def serialized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "serialized")
    registry.save(table(spark, sf_dir, "nation"), path, "serialized", relation="nation", label="n_regionkey")
    return registry.load(spark, path, "serialized")


@query("SELECT p_partkey::DOUBLE AS p_partkey, p_name, p_size::DOUBLE AS p_size FROM part")
def arff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "arff")
    registry.save(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), path, "arff")
    return registry.load(spark, path, "arff")


@query("SELECT s_suppkey::DOUBLE AS s_suppkey, s_acctbal, s_name FROM supplier")
def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "csv")
    registry.save(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_name"), path, "csv")
    return registry.load(spark, path, "csv")


@query("SELECT n_regionkey::DOUBLE AS n_regionkey, count(*)::DOUBLE AS n FROM nation GROUP BY 1")
def sql_query_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.query(spark, "SELECT n_regionkey, count(*) AS n, sum(0) AS nothing FROM nations GROUP BY 1", {"nations": table(spark, sf_dir, "nation")}, sparse=True)


@query("SELECT count(*) AS n, count(*) FILTER (x) AS hits FROM (SELECT p_size > 10 AND p_type = 'LARGE' AS x FROM part)")
def generated_rule_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = generators.rule([generators.Test("p_size", ">", 10), generators.Test("p_type", "=", "LARGE")])
    return table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(both).alias("hits"))


@query(f"WITH t AS (SELECT p_partkey AS k, {_TOKENS.format(c='p_name')} AS t FROM part) SELECT a.k AS id, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity FROM t a JOIN t b ON b.k = a.k + 1")
def registered_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    pairs = p.toDF("id", "a").join(p.select((F.col("p_partkey") - 1).alias("id"), F.col("p_name").alias("b")), "id")
    metric = registry.find("metric", "jaccard").fit(p)
    return pairs.select("id", F.round(metric.column(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def registered_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.apply_named(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "filter", "standardise", ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query(f"SELECT block, count(*) AS n FROM (SELECT unnest(list_distinct({_TOKENS.format(c='p_name')})) AS block FROM part) GROUP BY 1")
def registered_key_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(registry.find("blocker", "words")("p_name")).alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS.format(c='p_name')}) AS token FROM part) GROUP BY 1")
def registered_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(registry.find("tokenizer", "words")("p_name")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(avg(l_linenumber), 8) AS rate FROM lineitem")
def registered_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.find("estimator", "poisson")(table(spark, sf_dir, "lineitem"), "l_linenumber")


@query(_CONCEPT.format(y=_CASE))
def registered_learner(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, _CASE)
    return _confusion(registry.find("learner", "c45")(train, COLUMNS, "y").apply(test, "prediction", None))


@query("SELECT s_suppkey, CASE WHEN s_acctbal >= 0 THEN round(sqrt(s_acctbal), 6) END AS s_acctbal FROM supplier")
def registered_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = registry.find("scalar", "sqrt")
    x = f(F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.when(~F.isnan(x), x), 6).alias("s_acctbal"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _drained(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    return incremental.drained(stream, _path(spark, "drained"), _path(spark, "stream"), mode)


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, incremental.windowed_counts(_events(spark, sf_dir), "ts", "event_type")).select(F.col("window.start").alias("start"), "event_type", F.col("count").alias("n"))


@query("SELECT (date_trunc('hour', ts) - i * INTERVAL 1 HOUR)::TIMESTAMP AS start, event_type, count(*) AS n FROM events, range(2) t(i) GROUP BY 1, 2")
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, flows.sliding(_events(spark, sf_dir), "ts", "event_type", "2 hours", "1 hour")).select(F.col("window.start").alias("start"), "event_type", F.col("count").alias("n"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, flows.sessions(_events(spark, sf_dir), "ts", "user_id")).select("user_id", F.col("session.start").alias("start"), F.col("count").alias("n"))


@query("SELECT 2 * count(*) AS n FROM events")
def stream_union_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, flows.running_count(flows.joined(_events(spark, sf_dir), _events(spark, sf_dir))))


@query("SELECT event_id, event_type FROM events WHERE value > 50")
def stream_filter_to_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _path(spark, "stream-files")
    flows.into_folder(_events(spark, sf_dir).where("value > 50").select("event_id", "event_type"), out, _path(spark, "stream"))
    return spark.read.schema("event_id long, event_type string").parquet(out)


@query("SELECT 'user_id' AS attribute, user_id::VARCHAR AS value, event_type AS label, count(*) AS n FROM events GROUP BY 2, 3")
def stream_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, incremental.class_counts(_events(spark, sf_dir), ["user_id"], "event_type"))


@query("SELECT count(*) AS rows FROM events")
def stream_test_then_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumn("big", (F.col("value") > 50).cast("string"))
    learner = flows.NaiveBayesUpdater(spark, ["event_type"], "big", _path(spark, "counts"))
    seen = flows.test_then_train(events, learner, "big", _path(spark, "stream"))
    return spark.createDataFrame([(sum(n for _, n, _ in seen),)], "rows long")


@query(_CONCEPT.format(y=_CASE))
def flow_of_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = flows.Flow().then("split", lambda _: _rows(spark, sf_dir, _CASE)).then("train", lambda parts: (_c45(parts[0], COLUMNS, "y"), parts[1])).then("predict", lambda made: made[0].apply(made[1], "prediction", None)).then("evaluate", _confusion)
    return flow.run(None)["evaluate"]


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, count(*) AS n FROM lineitem")
def regression_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    fitted = learners.simple_regression(items, "l_quantity", "l_extendedprice").select(F.round("slope", 4).alias("slope"))
    return fitted.join(F.broadcast(items.agg(F.count(F.lit(1)).alias("n"))))


@query(f"SELECT sum(len({_TOKENS.format(c='p_name')}))::BIGINT AS tokens FROM part")
def token_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").agg(F.sum(F.size(linkage.tokens("p_name"))).alias("tokens"))
