"""Queries of learners.

Most learn a concept that is stated here (parts whose class follows from their type and a number), and return the
confusion of labels and predictions on rows that the learner did not see; the SQL states what a learner that has found
the concept returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bayes, functions, lazy, learners, meta, models, rules, trees
from ..operators.models import Model
from .catalog import QUERIES, ORACLE, query, table

_CASE = "CASE WHEN p_type IN ('LARGE', 'SMALL') AND p_partkey % 8 <= 3 THEN 'x' WHEN p_type = 'ECONOMY' THEN 'y' ELSE 'z' END"
_TWO = "CASE WHEN p_type IN ('LARGE', 'SMALL') AND p_partkey % 8 <= 3 THEN 'x' ELSE 'z' END"
_CONCEPT = "SELECT y, y AS prediction, count(*) AS n FROM (SELECT {y} AS y FROM part WHERE p_partkey % 3 = 0) GROUP BY 1"
COLUMNS = ["a", "b", "q"]


def _rows(spark: SparkSession, sf_dir: str, case: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of the concept: k, a, b, q, y."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_type AS a", "concat('m', p_size % 3) AS b", "CAST(p_partkey % 8 AS int) AS q", "concat('r', p_partkey % 8) AS r", f"{case} AS y")
    return p.where("k % 3 <> 0"), p.where("k % 3 = 0")


def _confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))


def concept(name: str, learn: Callable[[DataFrame], Model | Callable[[DataFrame], DataFrame]], case: str = _CASE) -> None:
    """Registers a query that learns the concept, and its SQL."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, test = _rows(spark, sf_dir, case)
        made = learn(train)
        return _confusion(made.apply(test, "prediction", None) if isinstance(made, Model) else made(test))

    QUERIES[name] = run
    ORACLE[name] = _CONCEPT.format(y=case)


def _c45(df: DataFrame, columns: list[str], label: str, weight=None) -> Model:
    return trees.c45(df, columns, label, weight)


def _regression(df: DataFrame, columns: list[str], label: str, weight=None):
    return trees.regression_tree(df, columns, label, weight)


_NOMINAL = lambda d: d.withColumn("q", F.col("q").cast("string"))

concept("id3_tree", lambda d: trees.id3(d, COLUMNS, "y"))
concept("c45_tree", lambda d: trees.c45(d, COLUMNS, "y"))
concept("reduced_error_pruning_tree", lambda d: trees.reduced_error_tree(d, COLUMNS, "y", "k"))
concept("random_tree", lambda d: trees.random_tree(d, COLUMNS, "y"))
concept("bayes_tree", lambda d: trees.bayes_tree(d, COLUMNS, "y", max_depth=3, least=5.0))
concept("logistic_model_tree", lambda d: trees.logistic_tree(d, COLUMNS, "y", max_depth=3, least=5.0))
concept("alternating_tree", lambda d: trees.alternating_tree(d, COLUMNS, "y", rounds=8), _TWO)
concept("prism_rules", lambda d: rules.prism(d, COLUMNS, "y").model())
concept("ripper_rules", lambda d: rules.ripper(d, COLUMNS, "y", "k").model())
concept("ripple_down_rules", lambda d: rules.ripple_down(d, COLUMNS, "y", "k"))
concept("partial_tree_rules", lambda d: rules.partial_tree_rules(d, COLUMNS, "y").model())
concept("averaged_one_dependence", lambda d: bayes.averaged_one_dependence(d, ["a", "r"], "y"))
concept("bagged_trees", lambda d: meta.bagging(_c45, d, COLUMNS, "y", "k", 3))
concept("ada_boosted_trees", lambda d: meta.ada_boost(lambda *x, weight=None: trees.tree_model(*trees.grow(x[0], x[1], x[2], classes=models.classes_of(x[0], x[2]), weight=weight, max_depth=2), models.classes_of(x[0], x[2])), d, COLUMNS, "y", 4)[0])
concept("multi_boosted_trees", lambda d: meta.multi_boost(_c45, d, COLUMNS, "y", "k", 2, 2))
concept("logit_boosted_trees", lambda d: meta.logit_boost(d, COLUMNS, "y", _regression, 3), _TWO)
concept("raced_logit_boost", lambda d: meta.raced_logit_boost(d, COLUMNS, "y", "k", _regression, (1, 2), 2), _TWO)
concept("random_committee", lambda d: meta.random_committee(trees.random_tree, d, COLUMNS, "y", 3))
concept("decorated_trees", lambda d: meta.decorated(_c45, d, COLUMNS, "y", "k", 2, 2, 0.2))
concept("stacked_learners", lambda d: meta.stacking({"t": _c45, "n": bayes.naive_bayes}, _c45, d, COLUMNS, "y", "k", 2))
concept("stacked_by_class", lambda d: meta.stacking({"t": _c45, "n": bayes.naive_bayes}, None, d, COLUMNS, "y", "k", 2, per_class=True))
concept("graded_learners", lambda d: meta.grading({"t": _c45, "s": trees.stump}, _c45, d, COLUMNS, "y", "k", 2))
concept("best_of_schemes", lambda d: meta.multi_scheme({"s": trees.stump, "t": _c45}, d, COLUMNS, "y", "k", 2)[1])
concept("selected_parameter", lambda d: meta.parameter_selection(lambda v: lambda x, c, y, weight=None: trees.c45(x, c, y, weight, max_depth=int(v)), [1.0, 6.0], d, COLUMNS, "y", "k", 2)[1])
concept("attribute_selected_tree", lambda d: meta.attribute_selected(_c45, lambda df, c, y: [x for x in c if x != "b"], d, COLUMNS, "y"))
concept("filtered_tree", lambda d: meta.filtered(trees.id3, lambda fitted: _NOMINAL, d, COLUMNS, "y"))
concept("cost_weighted_tree", lambda d: meta.cost_sensitive(_c45, d, COLUMNS, "y", {("x", "y"): 2.0, ("x", "z"): 5.0, ("y", "x"): 1.0, ("y", "z"): 1.0, ("z", "x"): 1.0, ("z", "y"): 1.0}))
concept("meta_cost_tree", lambda d: meta.meta_cost(_c45, d, COLUMNS, "y", "k", {("x", "z"): 2.0, ("z", "x"): 1.0, ("x", "y"): 1.0, ("y", "x"): 1.0, ("y", "z"): 1.0, ("z", "y"): 1.0}, 2))
concept("one_against_rest", lambda d: meta.one_against_rest(_c45, d, COLUMNS, "y"))
concept("ordinal_classes", lambda d: meta.ordinal(_c45, d, COLUMNS, "y", ["x", "y", "z"]))
concept("class_by_regression", lambda d: meta.by_regression(_regression, d, COLUMNS, "y"))
concept("threshold_selector", lambda d: meta.thresholded(_c45(d, COLUMNS, "y"), d, "y", "x")[1], _TWO)


@query(_CONCEPT.format(y=_CASE))
def decision_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, _CASE)
    found, default = rules.decision_table(train, ["a", "q"], "y")
    return _confusion(rules.look_up(test, found, default, ["a", "q"]))


@query(_CONCEPT.format(y=_CASE))
def entropic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, _CASE)
    got = lazy.entropic_neighbours(train, test, ["a", "q"], "k", "y", blend=5.0)
    return _confusion(test.join(got, F.col("k") == F.col("query")))


@query(_CONCEPT.format(y="CASE WHEN p_partkey % 8 <= 3 THEN 'x' ELSE 'z' END"))
def conjunctive_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, "CASE WHEN p_partkey % 8 <= 3 THEN 'x' ELSE 'z' END")
    return _confusion(rules.conjunctive_rule(train, COLUMNS, "y", "k").apply(test, "prediction", None))


@query("SELECT 0 AS rule, count(*) AS covered, count(*) FILTER (p_type = 'ECONOMY') AS right, 0::BIGINT AS wrong FROM part WHERE p_type = 'ECONOMY' UNION ALL SELECT 1, count(*), count(*) FILTER (p_partkey % 8 <= 3), count(*) FILTER (p_partkey % 8 > 3) FROM part WHERE p_type <> 'ECONOMY'")
def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_type AS a", "CASE WHEN p_type = 'ECONOMY' THEN 'y' WHEN p_partkey % 8 <= 3 THEN 'x' ELSE 'z' END AS y")
    codings = models.coded(p, ["a"])
    found = rules.RuleList([rules.Rule("y", [(0, "=", codings[0].labels.index("ECONOMY"))])], codings, ["x", "y", "z"], "x")
    return rules.rule_stats(p, found, "y")


@query("SELECT y, CASE WHEN q <= 3 THEN 'x' ELSE 'z' END AS prediction, count(*) AS n FROM (SELECT p_partkey % 8 AS q, CASE WHEN p_partkey % 8 <= 3 THEN 'x' ELSE 'z' END AS y FROM part WHERE p_partkey % 3 = 0) GROUP BY 1, 2")
def nested_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, "CASE WHEN p_partkey % 8 <= 3 THEN 'x' ELSE 'z' END")
    return _confusion(rules.nested_exemplars(train, ["q"], "y").apply(test, "prediction", None))


@query(_CONCEPT.format(y="CASE WHEN p_type = 'LARGE' OR p_size % 3 = 0 THEN 'yes' ELSE 'no' END"))
def winnow_disjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, "CASE WHEN p_type = 'LARGE' OR p_size % 3 = 0 THEN 'yes' ELSE 'no' END")
    bits = {"one": F.lit(1), "large": (F.col("a") == "LARGE").cast("int"), "m0": (F.col("b") == "m0").cast("int"), "m1": (F.col("b") == "m1").cast("int")}
    return _confusion(functions.winnow(train.withColumns(bits), list(bits), "y", "k", rounds=10).apply(test.withColumns(bits), "prediction", None))


@query(_CONCEPT.format(y="CASE WHEN p_partkey % 8 <= 3 THEN 'x' ELSE 'z' END"))
def voted_perceptron(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, "CASE WHEN p_partkey % 8 <= 3 THEN 'x' ELSE 'z' END")
    centred = lambda d: d.withColumn("c", F.col("q") - 3.5)
    return _confusion(functions.voted_perceptron(centred(train), ["c"], "y", "k", rounds=10).apply(centred(test), "prediction", None))


@query(_CONCEPT.format(y="CASE WHEN p_partkey % 8 <= 3 THEN 'x' ELSE 'z' END"))
def simple_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, "CASE WHEN p_partkey % 8 <= 3 THEN 'x' ELSE 'z' END")
    return _confusion(functions.simple_logistic(train, ["q"], "y", 10).apply(test, "prediction", None))


@query(_CONCEPT.format(y="CASE WHEN p_partkey % 8 <= 3 THEN 'x' ELSE 'z' END"))
def radial_basis_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, "CASE WHEN p_partkey % 8 <= 3 THEN 'x' ELSE 'z' END")
    return _confusion(functions.radial_basis(train.withColumn("q", F.col("q").cast("double")), ["q"], "y", "k", 4).apply(test, "prediction", None))


_LINE = "SELECT count(*) AS n, round(avg(t), 4) AS mean, round(min(t), 3) AS least, round(max(t), 3) AS largest FROM (SELECT 3.0 * (p_partkey % 8) - 2.0 * p_size + 10 AS t FROM part)"


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "CAST(p_partkey % 8 AS double) AS q", "CAST(p_size AS double) AS s", "p_type AS a", "3.0D * (p_partkey % 8) - 2.0D * p_size + 10 AS t")


def _values(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 4).alias("mean"), F.round(F.min("prediction"), 3).alias("least"), F.round(F.max("prediction"), 3).alias("largest"))


@query(_LINE)
def model_tree_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _line(spark, sf_dir)
    return _values(trees.model_tree(d, ["q", "s", "a"], "t", max_depth=1, ridge=1e-12, smooth=0.0).apply(d))


@query(_LINE)
def model_rules_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _line(spark, sf_dir)
    parts = [trees.model_tree(d.where(F.col("q") <= 3), ["q", "s"], "t", 0, ridge=1e-12, smooth=0.0).value, trees.model_tree(d.where(F.col("q") > 3), ["q", "s"], "t", 0, ridge=1e-12, smooth=0.0).value]
    return _values(d.withColumn("prediction", F.when(F.col("q") <= 3, parts[0]).otherwise(parts[1])))


@query(_LINE)
def least_median_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _line(spark, sf_dir)
    spoiled = d.withColumn("t", F.when(F.col("k") % 5 == 0, F.col("t") + 500).otherwise(F.col("t")))
    return _values(functions.least_median_squares(spoiled, ["q", "s"], "t", "k").apply(d))


@query("SELECT '(intercept)' AS term, 10.0::DOUBLE AS coefficient UNION ALL SELECT 'q', 3.0 UNION ALL SELECT 's', -2.0")
def regression_by_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = functions.selected_regression(_line(spark, sf_dir).withColumn("w", F.col("k") % 11), ["q", "s", "w"], "t")
    return spark.createDataFrame([(k, round(v, 4) + 0.0) for k, v in found.items() if abs(v) > 1e-6], "term string, coefficient double")


@query("SELECT '(intercept)' AS term, 10.0::DOUBLE AS coefficient UNION ALL SELECT 'q', 3.0 UNION ALL SELECT 's', -2.0")
def linear_regression_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learners.linear_regression(_line(spark, sf_dir), ["q", "s"], "t")
    return spark.createDataFrame([(k, round(v, 4)) for k, v in found.items()], "term string, coefficient double")


@query("SELECT '(intercept)' AS term, 10.0::DOUBLE AS coefficient UNION ALL SELECT 'q', 3.0 UNION ALL SELECT 's', -2.0")
def pace_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = functions.pace_regression(_line(spark, sf_dir), ["q", "s"], "t")
    return spark.createDataFrame([(k, round(v, 3)) for k, v in found.items()], "term string, coefficient double")


@query("SELECT count(*) AS n, round(avg(p_partkey % 8), 4) AS mean, 0.0::DOUBLE AS least, 7.0::DOUBLE AS largest FROM part")
def additive_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _line(spark, sf_dir)
    return _values(meta.additive_regression(lambda x, c, y: trees.regression_tree(x, c, y, max_depth=2), d, ["q"], "q", 4).apply(d))


@query("SELECT count(*) AS n, round(avg(p_partkey % 8), 4) AS mean, 0.0::DOUBLE AS least, 7.0::DOUBLE AS largest FROM part")
def regression_by_discretization(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _line(spark, sf_dir)
    return _values(meta.by_discretization(_c45, d, ["q"], "q", 8).apply(d))


@query("SELECT count(*) AS n, round(avg(3.0 * (p_partkey % 8) - 2.0 * p_size + 10), 3) AS mean FROM part WHERE p_partkey % 20 = 0")
def locally_weighted_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _line(spark, sf_dir)
    got = lazy.locally_weighted(d, d.where("k % 20 = 0"), ["q", "s"], "k", "t", 30, ridge=1e-9)
    return got.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 3).alias("mean"))


@query("""WITH b AS (SELECT min(p_size) AS a, max(p_size) - min(p_size) AS w, min(p_retailprice) AS c, max(p_retailprice) - min(p_retailprice) AS v FROM part),
d AS (SELECT q.p_partkey AS query, t.p_partkey AS neighbour, t.p_brand AS label, round(sqrt(((q.p_size - t.p_size) / w) ^ 2 + ((q.p_retailprice - t.p_retailprice) / v) ^ 2), 9) AS d FROM part q, part t, b WHERE q.p_partkey % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS rank FROM d), s AS (SELECT query, label, round(sum(1 / (round(d, 6) + 0.001)), 9) AS w FROM r WHERE rank <= 7 GROUP BY 1, 2)
SELECT query, label AS prediction FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY w DESC, label) = 1""")
def weighted_neighbour_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    return lazy.weighted_neighbours(p, p.where("p_partkey % 20 = 0"), ["p_size", "p_retailprice"], "p_partkey", "p_brand", 7, "inverse")


_GAUSS = "-((l_quantity - mq) / sq) ^ 2 / 2 - ln(sq) - ((l_tax - mt) / st) ^ 2 / 2 - ln(st)".replace("-((l_quantity", "0 - ((l_quantity")


@query(f"""WITH m AS (SELECT l_returnflag AS y, count(*) AS n, avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_tax) AS mt, stddev_samp(l_tax) AS st FROM lineitem GROUP BY 1),
i AS (SELECT row_number() OVER () AS id, l_quantity, l_tax FROM lineitem), s AS (SELECT id, y, round(ln((n + 1) / ((SELECT count(*) FROM lineitem) + 3)) + {_GAUSS}, 9) AS s FROM i, m)
SELECT y AS prediction, count(*) AS n FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, y) = 1) GROUP BY 1""")
def naive_bayes_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_returnflag")
    return bayes.naive_bayes(items, ["l_quantity", "l_tax"], "l_returnflag").apply(items, "prediction", None).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


_WORDS = "w AS (SELECT p_type AS label, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: t <> '')) AS word FROM part), c AS (SELECT label, word, count(*) AS n FROM w GROUP BY 1, 2), l AS (SELECT label, sum(n) AS total FROM c GROUP BY 1), v AS (SELECT word, sum(n) AS every FROM c GROUP BY 1), z AS (SELECT count(*) AS v, sum(every) AS whole FROM v)"


@query(f"WITH {_WORDS} SELECT word, label, round(ln((coalesce(n, 0) + 1) / (total + z.v)), 6) AS weight FROM v CROSS JOIN l CROSS JOIN z LEFT JOIN c USING (word, label)")
def multinomial_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.linkage import tokens

    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", tokens("p_name").alias("words"))
    return bayes.multinomial_model(p, "p_partkey", "words", "p_type")[0].withColumn("weight", F.round("weight", 6))


@query(f"""WITH {_WORDS}, r AS (SELECT word, label, -ln((every - coalesce(n, 0) + 1) / (whole - total + z.v)) AS weight FROM v CROSS JOIN l CROSS JOIN z LEFT JOIN c USING (word, label)), a AS (SELECT label, sum(abs(weight)) AS a FROM r GROUP BY 1)
SELECT word, label, round(weight / a, 8) AS weight FROM r JOIN a USING (label)""")
def complement_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.linkage import tokens

    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", tokens("p_name").alias("words"))
    return bayes.multinomial_model(p, "p_partkey", "words", "p_type", complement=True, normalize=True)[0].withColumn("weight", F.round("weight", 8))


@query()
def lazy_bayes_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, _CASE)
    return _confusion(test.join(bayes.lazy_rules(train, test, ["a", "b"], "y", "k"), "k"))


@query()
def feature_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _rows(spark, sf_dir, _CASE)
    return _confusion(lazy.feature_intervals(train, COLUMNS, "y").apply(test, "prediction", None))


@query("""WITH r AS (SELECT p_type AS y, min(p_size) AS a, max(p_size) AS z, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part WHERE p_retailprice < 1000 OR p_type = 'LARGE' GROUP BY 1),
s AS (SELECT p_partkey, y, (p_size BETWEEN a AND z)::INT + (p_retailprice BETWEEN c AND d)::INT AS s FROM part, r) SELECT y AS prediction, count(*) AS n FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, y) = 1) GROUP BY 1""")
def hyper_pipes_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    m = lazy.pipes_model(p.where("p_retailprice < 1000 OR p_type = 'LARGE'"), ["p_size", "p_retailprice"], "p_type")
    return m.apply(p, "prediction", None).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


_DOT = "list_dot_product(a.v, b.v)"
_PAIRS = "(SELECT n_nationkey AS k, [n_nationkey::DOUBLE, n_regionkey::DOUBLE, 1.0] AS v FROM nation) a, (SELECT n_nationkey AS k, [n_nationkey::DOUBLE, n_regionkey::DOUBLE, 1.0] AS v FROM nation) b WHERE a.k < b.k"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double"), F.lit(1.0)).alias("v"))
    return n.toDF("i", "a").join(n.toDF("j", "b"), F.col("i") < F.col("j"))


@query(f"SELECT a.k AS i, b.k AS j, round({_DOT} ^ 2, 6) AS kernel FROM {_PAIRS}")
def poly_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("i", "j", F.round(functions.poly_kernel(F.col("a"), F.col("b"), 2.0), 6).alias("kernel"))


@query(f"SELECT a.k AS i, b.k AS j, round(({_DOT} + 1) ^ 2 / sqrt((list_dot_product(a.v, a.v) + 1) ^ 2 * (list_dot_product(b.v, b.v) + 1) ^ 2), 8) AS kernel FROM {_PAIRS}")
def normalized_poly_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("i", "j", F.round(functions.normalized_poly_kernel(F.col("a"), F.col("b"), 2.0, True), 8).alias("kernel"))


@query(f"SELECT a.k AS i, b.k AS j, round(exp(-0.01 * (list_dot_product(a.v, a.v) - 2 * {_DOT} + list_dot_product(b.v, b.v))), 8) AS kernel FROM {_PAIRS}")
def rbf_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("i", "j", F.round(functions.rbf_kernel(F.col("a"), F.col("b"), 0.01), 8).alias("kernel"))
