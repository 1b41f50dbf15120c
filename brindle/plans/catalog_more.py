"""More queries of the catalog: estimators, scores, neighbours, linkage quality, small column operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranges
from ..operators import estimators, evaluation, learners, linkage, neighbours, relational, supervised, transforms
from ..sources import generators
from .catalog import _CLASS, _items, _predictions, query, table


@query("SELECT o_orderpriority AS value, round((count(*) + 1) / ((SELECT count(*) FROM orders) + (SELECT count(DISTINCT o_orderpriority) FROM orders)), 8) AS probability FROM orders GROUP BY 1")
def discrete_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimators.discrete(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("""WITH b AS (SELECT o_orderstatus AS given, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT given, value, round((n + 1) / (sum(n) OVER (PARTITION BY given) + (SELECT count(DISTINCT value) FROM b)), 8) AS probability FROM b""")
def conditional_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimators.conditional_discrete(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("SELECT round(avg(round(l_quantity / 5) * 5), 6) AS mean, round(greatest(stddev_pop(round(l_quantity / 5) * 5), 5 / 6), 6) AS deviation FROM lineitem")
def normal_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimators.normal(table(spark, sf_dir, "lineitem"), "l_quantity", 5.0)


@query("SELECT round(avg(l_linenumber), 8) AS rate FROM lineitem")
def poisson_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimators.poisson(table(spark, sf_dir, "lineitem"), "l_linenumber")


@query("SELECT p::DOUBLE AS point, round(avg(exp(-(((l_quantity - p) / 4.0) ^ 2) / 2)) / (4 * sqrt(2 * pi())), 8) AS density FROM lineitem, (VALUES (5.0::DOUBLE), (25.0), (45.0)) t(p) GROUP BY p")
def kernel_estimator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimators.kernel(table(spark, sf_dir, "lineitem"), "l_quantity", [5, 25, 45], 4.0)


@query("""WITH c AS (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), q AS (SELECT sum(n) AS t, sum(n * ln(n)) AS s FROM c GROUP BY l_linestatus),
x AS (SELECT sum(s - t * ln(t)) AS ll, sum(t) AS n, count(*) AS q FROM q), k AS (SELECT count(DISTINCT l_returnflag) AS k FROM c)
SELECT round(ll, 4) AS entropy, round(ll - q * (k - 1), 4) AS aic, round(ll - q * (k - 1) * ln(n) / 2, 4) AS mdl FROM x, k""")
def bayes_network_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimators.local_score(_items(spark, sf_dir), "l_returnflag", ["l_linestatus"])


@query()
def bayes_network_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = estimators.k2(_items(spark, sf_dir), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return spark.createDataFrame([(n, ",".join(p)) for n, p in found], "node string, parents string")


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(l_extendedprice, l_tax), 6) FROM lineitem")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return estimators.correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, _ = estimators.principal_components(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax", "l_discount"])
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(values)], "component int, eigenvalue double")


@query("""WITH b AS (SELECT min(p_size) AS a, max(p_size) - min(p_size) AS w, min(p_retailprice) AS c, max(p_retailprice) - min(p_retailprice) AS v FROM part),
d AS (SELECT q.p_partkey AS query, t.p_partkey AS neighbour, round(sqrt(((q.p_size - t.p_size) / w) ^ 2 + ((q.p_retailprice - t.p_retailprice) / v) ^ 2), 9) AS d FROM part q, part t, b WHERE q.p_partkey % 20 = 0),
r AS (SELECT query, neighbour, row_number() OVER (PARTITION BY query ORDER BY d, neighbour)::INTEGER AS rank, round(d, 6) AS distance FROM d) SELECT * FROM r WHERE rank <= 5""")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return neighbours.nearest(p, p.where("p_partkey % 20 = 0"), ["p_size", "p_retailprice"], "p_partkey", 5)


@query("""WITH b AS (SELECT min(p_size) AS a, max(p_size) - min(p_size) AS w, min(p_retailprice) AS c, max(p_retailprice) - min(p_retailprice) AS v FROM part),
d AS (SELECT q.p_partkey AS query, t.p_partkey AS neighbour, t.p_brand AS label, round(sqrt(((q.p_size - t.p_size) / w) ^ 2 + ((q.p_retailprice - t.p_retailprice) / v) ^ 2), 9) AS d FROM part q, part t, b WHERE q.p_partkey % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS rank FROM d), s AS (SELECT query, label, count(*) AS n FROM r WHERE rank <= 7 GROUP BY 1, 2)
SELECT query, label AS prediction FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1""")
def neighbour_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    return neighbours.classify(p, p.where("p_partkey % 20 = 0"), ["p_size", "p_retailprice"], "p_partkey", "p_brand", 7)


_NB = " UNION ALL ".join(f"SELECT '{a}' AS attribute, {a}::VARCHAR AS value, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 2, 3" for a in _CLASS["attributes"])


@query(f"""WITH c AS ({_NB}), v AS (SELECT attribute, count(DISTINCT value) AS k FROM c GROUP BY 1), t AS (SELECT attribute, label, sum(n) AS t FROM c GROUP BY 1, 2), g AS (SELECT DISTINCT attribute, value FROM c),
m AS (SELECT attribute, value, label, round((coalesce(n, 0) + 1) / (t + k), 8) AS p FROM g JOIN t USING (attribute) JOIN v USING (attribute) LEFT JOIN c USING (attribute, value, label)),
o AS (SELECT l_returnflag AS label, ln((count(*) + 1) / ((SELECT count(*) FROM lineitem) + (SELECT count(DISTINCT l_returnflag) FROM lineitem))) AS p FROM lineitem GROUP BY 1),
r AS (SELECT l_linestatus AS a, l_linenumber AS b, l_discount AS d, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT a, b, d, n, o.label, round(o.p + ln(x.p) + ln(y.p) + ln(z.p), 9) AS s FROM r, o JOIN m x ON x.label = o.label AND x.attribute = 'l_linestatus' JOIN m y ON y.label = o.label AND y.attribute = 'l_linenumber' JOIN m z ON z.label = o.label AND z.attribute = 'l_discount' WHERE x.value = a AND y.value = b::VARCHAR AND z.value = d::VARCHAR)
SELECT label AS prediction, sum(n)::BIGINT AS n FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a, b, d ORDER BY s DESC, label) = 1) GROUP BY 1""")
def naive_bayes_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumn("k", F.monotonically_increasing_id())
    model = learners.naive_bayes_counts(items, _CLASS["attributes"], _CLASS["label"])
    out = learners.naive_bayes_predict(items, model, _CLASS["attributes"], _CLASS["label"], "k")
    return out.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(sum(CASE WHEN l_linestatus = 'F' AND p = 'O' THEN 5 WHEN l_linestatus = 'O' AND p = 'F' THEN 1 ELSE 0 END) / count(*), 6) AS cost FROM (SELECT l_linestatus, CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END AS p FROM lineitem)")
def expected_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = evaluation.confusion(_predictions(spark, sf_dir), "l_linestatus", "p")
    cost = F.when((F.col("actual") == "F") & (F.col("predicted") == "O"), 5).when((F.col("actual") == "O") & (F.col("predicted") == "F"), 1).otherwise(0)
    return c.agg(F.round(F.sum(F.col("n") * cost) / F.sum("n"), 6).alias("cost"))


@query("SELECT o_orderstatus, count(*) AS num_results, avg(o_totalprice) AS avg_o_totalprice, stddev_samp(o_totalprice) AS dev_o_totalprice FROM orders GROUP BY 1".replace("avg(o_totalprice)", "round(avg(o_totalprice), 4)").replace("stddev_samp(o_totalprice)", "round(stddev_samp(o_totalprice), 4)"))
def averaged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.averaged(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_totalprice"])
    return out.withColumns({c: F.round(c, 4) for c in ("avg_o_totalprice", "dev_o_totalprice")})


@query("""WITH n AS (SELECT c_custkey AS id, c_nationkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS r FROM customer), c AS (SELECT a.id AS i, b.id AS j, a.c_nationkey = b.c_nationkey AS y FROM n a JOIN n b ON b.r - a.r IN (1, 2, 3))
SELECT count(*) AS candidates, count(*) FILTER (y) AS found, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey))::BIGINT AS true_pairs,
round(count(*) FILTER (y) / (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)), 6) AS recall, round(count(*) FILTER (y) / count(*), 6) AS precision,
round(1 - count(*) / ((SELECT count(*) FROM customer) * ((SELECT count(*) FROM customer) - 1) / 2), 6) AS reduction FROM c""")
def blocking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    pairs = linkage.sorted_neighbourhood(c, "c_custkey", "c_mktsegment", 4).select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))
    labels = c.select("c_custkey", "c_nationkey")
    hit = pairs.join(labels.select(F.col("c_custkey").alias("id1"), F.col("c_nationkey").alias("n1")), "id1").join(labels.select(F.col("c_custkey").alias("id2"), F.col("c_nationkey").alias("n2")), "id2").where("n1 = n2")
    true_pairs = c.groupBy("c_nationkey").count().agg(F.sum(F.expr("count * (count - 1) div 2")).alias("true_pairs"))
    rows = c.agg(F.count(F.lit(1)).alias("rows"))
    out = pairs.agg(F.count(F.lit(1)).alias("candidates")).join(F.broadcast(hit.agg(F.count(F.lit(1)).alias("found")))).join(F.broadcast(true_pairs)).join(F.broadcast(rows))
    all_pairs = F.col("rows") * (F.col("rows") - 1) / 2
    return out.select("candidates", "found", "true_pairs", F.round(F.col("found") / F.col("true_pairs"), 6).alias("recall"), F.round(F.col("found") / F.col("candidates"), 6).alias("precision"), F.round(1 - F.col("candidates") / all_pairs, 6).alias("reduction"))


@query("""WITH p AS (SELECT l_discount AS t, l_linestatus = 'F' AS y FROM lineitem), c AS (SELECT t, count(*) FILTER (y) AS p, count(*) AS n FROM p GROUP BY 1), s AS (SELECT t, sum(p) OVER (ORDER BY t DESC) AS tp, sum(n) OVER (ORDER BY t DESC) AS n, sum(p) OVER () AS a FROM c)
SELECT t AS threshold, round(tp / n, 6) AS precision, round(tp / a, 6) AS recall, round(2 * (tp / n) * (tp / a) / (tp / n + tp / a), 6) AS f_measure FROM s""")
def precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select("l_discount", (F.col("l_linestatus") == "F").alias("y"))
    return linkage.precision_recall(pairs, "l_discount", "y", pairs.where("y").count())


@query('SELECT s_suppkey, s_nationkey, s_acctbal, s_acctbal AS "Copy of s_acctbal", NULL::DOUBLE AS extra FROM supplier')
def remove_copy_and_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    kept = s.select(*ranges.columns_in("2", s.columns, invert=True))
    return kept.withColumn("Copy of s_acctbal", F.col("s_acctbal")).withColumn("extra", F.lit(None).cast("double"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS o_orderdate FROM orders")
def change_date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_orderdate"))


@query("SELECT 'A' || row_number() OVER (ORDER BY c_mktsegment) AS code, n FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def obfuscate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return relational.numbered(counts, "c_mktsegment").select(F.concat(F.lit("A"), (F.col("rid") + 1).cast("string")).alias("code"), "n")


@query("""WITH q AS (SELECT quantile_cont(s_acctbal, 0.5) AS m FROM supplier) SELECT s_suppkey, CASE WHEN s_acctbal > (SELECT (max(s_acctbal) FILTER (s_acctbal <= m) + min(s_acctbal) FILTER (s_acctbal > m)) / 2 FROM supplier, q) THEN 1 ELSE 0 END::INTEGER AS bin FROM supplier""")
def discretize_equal_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.equal_frequency(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 2).select("s_suppkey", "bin")


def _projection() -> str:
    """SQL of two sums whose signs are drawn as the operator draws them."""
    import random

    rng, out = random.Random(42), []
    for k in (1, 2):
        signs = [(c, rng.choice((1, 0, 0, 0, 0, -1))) for c in ("l_quantity", "l_tax", "l_discount")]
        out.append(" + ".join(["0.0::DOUBLE", *[f"{c} * ({x}) * sqrt(3)" for c, x in signs if x]]) + f" AS k{k}")
    return ", ".join(out)


@query(f"SELECT l_orderkey, l_quantity, l_tax, l_discount, {_projection()} FROM lineitem")
def random_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.random_projection(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_discount"), ["l_quantity", "l_tax", "l_discount"], 2)


@query()
def generated_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.decision_list(spark, 10_000).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query()
def generated_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.grid_clusters(spark, 4, 500).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x1"), 1).alias("x1"))


@query("""WITH c AS (SELECT l_discount AS t, count(*) FILTER (l_linestatus = 'F') AS p, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT t, sum(p) OVER (ORDER BY t DESC) AS tp, sum(n) OVER (ORDER BY t DESC) AS n, sum(p) OVER () AS a FROM c)
SELECT t AS threshold, round(2 * tp / (n + a), 6) AS f_measure FROM s ORDER BY 2 DESC, 1 DESC LIMIT 1""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervised.best_threshold(table(spark, sf_dir, "lineitem").select("l_discount", (F.col("l_linestatus") == "F").alias("y")), "y", "l_discount")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END AS a, CASE WHEN l_tax > 0.04 THEN 'F' ELSE 'O' END AS b, CASE WHEN l_discount > 0.05 THEN 'F' ELSE 'O' END AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN (a = 'F')::INT + (b = 'F')::INT + (c = 'F')::INT >= 2 THEN 'F' ELSE 'O' END AS vote FROM v""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = lambda c, x: F.when(F.col(c) > x, "F").otherwise("O")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rule("l_quantity", 25).alias("a"), rule("l_tax", 0.04).alias("b"), rule("l_discount", 0.05).alias("c"))
    return supervised.vote(items, ["a", "b", "c"]).select("l_orderkey", "l_linenumber", "vote")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN 5 * (l_quantity / 50) < 1 * (1 - l_quantity / 50) THEN 'O' ELSE 'F' END AS prediction FROM lineitem")
def least_expected_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("pf"), (1 - F.col("l_quantity") / 50).alias("po"))
    return supervised.least_cost(items, {"F": "pf", "O": "po"}, {("F", "O"): 5.0, ("O", "F"): 1.0}).select("l_orderkey", "l_linenumber", "prediction")


@query("SELECT 0 AS i, (max(l_quantity) FILTER (l_quantity <= 20) + min(l_quantity) FILTER (l_quantity > 20)) / 2 AS cut FROM lineitem")
def entropy_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_quantity") > 20).cast("string").alias("y"))
    return spark.createDataFrame([(i, round(c, 4)) for i, c in enumerate(supervised.mdl_cuts(items, "l_quantity", "y"))], "i int, cut double")


@query()
def cross_validated_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_linestatus", "l_linenumber", "l_returnflag")
    names = ["l_linestatus", "l_linenumber"]

    def learn(train: DataFrame, test: DataFrame) -> DataFrame:
        model = learners.naive_bayes_counts(train, names, "l_returnflag")
        # The priors are those of the training rows.
        return learners.naive_bayes_predict(test, model, names, "l_returnflag", "k", trained=train)

    return supervised.cross_validated(items, "l_returnflag", 3, "k", learn)
