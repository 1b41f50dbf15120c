"""Named queries of the engine's own operators, each with the SQL that states the same result.

Every query reads whole tables with the columns it needs.  Values that come from division are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import associations, clusters, evaluation, features, learners, linkage, relational, transforms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n FROM lineitem GROUP BY 1, 2")
def flagship_pricing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count(F.lit(1)).alias("n"))


# Dataset primitives


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rid FROM orders")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.slice_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 100, 50, "c_custkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS n FROM customer) WHERE r > n * 0.3")
def remove_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.remove_percentage(table(spark, sf_dir, "customer").select("c_custkey"), 30, "c_custkey")


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rid, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN rid < (n % 7) * (n // 7 + 1) THEN rid // (n // 7 + 1) ELSE n % 7 + (rid - (n % 7) * (n // 7 + 1)) // (n // 7) END::INTEGER AS fold FROM r""")
def cross_validation_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.with_folds(table(spark, sf_dir, "customer").select("c_custkey"), 7, "c_custkey")


@query("SELECT c_custkey, c_mktsegment, ((row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1) % 5)::INTEGER AS fold FROM customer")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.stratified_folds(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", 5, "c_custkey")


@query("SELECT p_partkey, s_suppkey FROM (SELECT n_nationkey AS p_partkey, row_number() OVER (ORDER BY n_nationkey) r FROM nation) JOIN (SELECT n_regionkey * 100 + n_nationkey AS s_suppkey, row_number() OVER (ORDER BY n_regionkey * 100 + n_nationkey) r FROM nation) USING (r)")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return relational.zip_columns(n.select(F.col("n_nationkey").alias("p_partkey")), n.select((F.col("n_regionkey") * 100 + F.col("n_nationkey")).alias("s_suppkey")), "p_partkey", "s_suppkey")


@query("SELECT max(o_totalprice) AS value FROM (SELECT o_totalprice FROM orders WHERE o_totalprice IS NOT NULL ORDER BY 1 LIMIT 100)")
def kth_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.kth_smallest(table(spark, sf_dir, "orders"), "o_totalprice", 100)


@query("""SELECT 'c_acctbal' AS attribute, round(avg(c_acctbal), 6) AS mean, NULL::VARCHAR AS mode FROM customer
UNION ALL SELECT 'c_mktsegment', NULL, (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def mean_or_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.mean_or_mode(table(spark, sf_dir, "customer"), ["c_acctbal"], ["c_mktsegment"])


_STATS = " UNION ALL ".join(f"SELECT '{c}' AS attribute, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (v IS NULL), 0)::BIGINT AS missing, count(v) AS n_distinct, count(v) FILTER (n = 1) AS n_unique FROM (SELECT {c} AS v, count(*) AS n FROM part GROUP BY 1)" for c in ("p_brand", "p_type", "p_size"))


@query(_STATS)
def attribute_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.attribute_stats(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"])


_NUMERIC = " UNION ALL ".join(f"SELECT '{c}' AS attribute, count({c}) AS n, round(sum({c}::DOUBLE), 4) AS total, round(sum({c}::DOUBLE * {c}), 2) AS squares, min({c})::DOUBLE AS least, max({c})::DOUBLE AS largest, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS deviation FROM lineitem" for c in ("l_quantity", "l_discount"))


@query(_NUMERIC)
def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.numeric_stats(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])


@query("SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean, round((sum(l_extendedprice * l_extendedprice * l_quantity) - sum(l_extendedprice * l_quantity) ^ 2 / sum(l_quantity)) / (sum(l_quantity) - 1), 0) AS variance FROM lineitem")
def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.measures import weighted_mean, weighted_variance

    return table(spark, sf_dir, "lineitem").agg(F.round(weighted_mean("l_extendedprice", "l_quantity"), 6).alias("mean"), F.round(weighted_variance("l_extendedprice", "l_quantity"), 0).alias("variance"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) AS r FROM orders WHERE o_orderstatus IS NOT NULL),
m AS (SELECT floor(min(n) * 1.5) AS cap FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus))
SELECT o_orderkey, o_orderstatus FROM c, m WHERE r <= cap""")
def spread_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.spread_subsample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 1.5, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("""WITH w AS (SELECT p_partkey, p_size::BIGINT AS s, sum(p_size::BIGINT) OVER (ORDER BY p_partkey) AS e, sum(p_size::BIGINT) OVER () AS t FROM part WHERE p_size > 0)
SELECT p_partkey, (floor(e * (1000.0::DOUBLE / t) + 1e-9) - floor((e - s) * (1000.0::DOUBLE / t) + 1e-9))::BIGINT AS times FROM w""")
def resample_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("w"))
    return relational.resample_weighted(parts, "w", "p_partkey", 1000).select("p_partkey", "times")


@query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_brand NOT IN ('Brand#11', 'Brand#12')")
def remove_with_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where((F.col("p_size") >= 10) & ~F.col("p_brand").isin("Brand#11", "Brand#12")).select("p_partkey")


# Column transforms


@query("SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def normalize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.normalize(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def standardize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.standardize(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("SELECT p_partkey, round(p_size / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS p_size, round(p_retailprice / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) AS p_retailprice FROM part")
def normalize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transforms.normalize_rows(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return out.withColumns({c: F.round(c, 6) for c in ("p_size", "p_retailprice")})


@query("""WITH h AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value, CASE WHEN event_id % 4 <> 0 THEN event_type END AS event_type FROM events)
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM h)), 4) AS value, coalesce(event_type, (SELECT event_type FROM h WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type FROM h""")
def replace_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("event_type"))
    return transforms.replace_missing(e, ["value"], ["event_type"]).withColumn("value", F.round("value", 4))


@query("""WITH b AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS z FROM part)
SELECT p_partkey, (SELECT count(*) FROM range(1, 10) t(i) WHERE p_retailprice > a + (z - a) / 10 * i)::INTEGER AS bin FROM part, b""")
def discretize_equal_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.equal_width(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 10).select("p_partkey", "bin")


@query("SELECT p_partkey, round(log(2.718281828459045, p_retailprice * 2) + sqrt(p_size), 6) AS e, CASE WHEN p_size <> 10 THEN round(p_retailprice / (p_size - 10), 6) END AS d FROM part")
def add_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return p.select("p_partkey", F.round(transforms.expression("log(a3 * 2) + sqrt(a2)", p.columns), 6).alias("e"), F.round(transforms.expression("a3 / (a2 - 10)", p.columns), 6).alias("d"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN 1 ELSE 0 END AS l_discount FROM lineitem")
def numeric_to_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.numeric_to_binary(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), ["l_discount"])


@query("SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS \"o_orderstatus=F\", (o_orderstatus = 'O')::INTEGER AS \"o_orderstatus=O\", (o_orderstatus = 'P')::INTEGER AS \"o_orderstatus=P\" FROM orders")
def nominal_to_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.nominal_to_binary(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1.0 ELSE 0.0 END::DOUBLE AS c_mktsegment FROM customer")
def make_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.make_indicator(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'R') THEN 'A_R' ELSE l_returnflag END AS l_returnflag FROM lineitem")
def merge_two_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.merge_two_values(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", "A", "R")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def swap_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.swap_values(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F", "O")


@query('SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity, 4) AS "l_extendedprice-l_quantity", round(l_discount - l_extendedprice, 4) AS "l_discount-l_extendedprice" FROM lineitem')
def first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    out = transforms.first_order(items, ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumns({c: F.round(f"`{c}`", 4) for c in out.columns[2:]})


@query("SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS value FROM events")
def time_series_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return transforms.shifted(e, ["value"], -1, ["user_id"], ["ts", "event_id"], delta=True).select("event_id", "user_id", F.round("value", 6).alias("value"))


@query("SELECT event_id, user_id, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value FROM events")
def time_series_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return transforms.shifted(e, ["value"], -2, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", "value")


@query("SELECT c_custkey, code FROM customer JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY count(*), c_mktsegment) - 1 AS code FROM customer GROUP BY 1) USING (c_mktsegment)")
def class_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.class_order(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "code")


@query("""WITH w AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS word FROM part), c AS (SELECT p_partkey, word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1, 2),
d AS (SELECT word, count(*) AS df FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
SELECT p_partkey, word, round(ln(1 + n) * ln((SELECT count(*) FROM part)::DOUBLE / df), 6) AS weight FROM c JOIN d USING (word)""")
def string_to_word_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.word_vector(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", 50, tf=True, idf=True)


# Merit of attributes

_CLASS = {"df": "lineitem", "attributes": ["l_linestatus", "l_linenumber", "l_discount"], "label": "l_returnflag"}
_COUNTS = " UNION ALL ".join(f"SELECT '{a}' AS attribute, {a}::VARCHAR AS value, l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 2, 3" for a in ["l_linestatus", "l_linenumber", "l_discount"])


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_linestatus", "l_linenumber", "l_discount", "l_returnflag")


@query(f"""WITH c AS ({_COUNTS}), t AS (SELECT attribute, sum(n) AS t, sum(n * log2(n)) AS j FROM c GROUP BY 1),
k AS (SELECT attribute, sum(n * log2(n)) AS k FROM (SELECT attribute, label, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT attribute, sum(n * log2(n)) AS v FROM (SELECT attribute, value, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT attribute, log2(t) - k / t AS hc, log2(t) - v / t AS hv, log2(t) - j / t AS hj FROM t JOIN k USING (attribute) JOIN v USING (attribute))
SELECT attribute, round(hc + hv - hj, 6) AS info_gain, round((hc + hv - hj) / hv, 6) AS gain_ratio, round(2 * (hc + hv - hj) / (hc + hv), 6) AS symmetrical_uncertainty FROM h""")
def entropy_merits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.entropy_merits(_items(spark, sf_dir), _CLASS["attributes"], _CLASS["label"])


@query(f"""WITH c AS ({_COUNTS}), r AS (SELECT attribute, value, sum(n) AS r FROM c GROUP BY 1, 2), k AS (SELECT attribute, label, sum(n) AS k FROM c GROUP BY 1, 2),
t AS (SELECT attribute, sum(n) AS t, count(DISTINCT value) AS nr, count(DISTINCT label) AS nc FROM c GROUP BY 1),
s AS (SELECT attribute, t, nr, nc, t * (sum(n::DOUBLE * n / (r * k)) - 1) AS x FROM c JOIN r USING (attribute, value) JOIN k USING (attribute, label) JOIN t USING (attribute) GROUP BY 1, 2, 3, 4)
SELECT attribute, round(x, 4) AS chi_squared, round(sqrt(greatest(x, 0) / (t * (least(nr, nc) - 1))), 6) AS cramers_v FROM s""")
def chi_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.chi_squared(_items(spark, sf_dir), _CLASS["attributes"], _CLASS["label"])


@query(f"WITH c AS ({_COUNTS}) SELECT attribute, sum(b)::BIGINT AS correct, sum(n)::BIGINT AS total FROM (SELECT attribute, value, max(n) AS b, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1")
def one_rule_merits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.one_rule(_items(spark, sf_dir), _CLASS["attributes"], _CLASS["label"])


@query("SELECT round(sum(b) / sum(n), 6) AS consistency FROM (SELECT max(n) AS b, sum(n) AS n FROM (SELECT l_linestatus, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) GROUP BY l_linestatus, l_linenumber)")
def subset_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.consistency(_items(spark, sf_dir), ["l_linestatus", "l_linenumber"], "l_returnflag")


@query()
def correlation_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = features.pair_uncertainties(_items(spark, sf_dir), _CLASS["attributes"], _CLASS["label"])
    chosen = features.forward_selection(_CLASS["attributes"], lambda s: features.cfs_merit(s, _CLASS["label"], pairs))
    return spark.createDataFrame([(",".join(chosen), round(features.cfs_merit(chosen, _CLASS["label"], pairs), 6))], "subset string, merit double")


# Learners


@query("SELECT (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS prediction, round((SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)) / count(*), 6) AS share FROM lineitem")
def zero_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.zero_rule(_items(spark, sf_dir), "l_returnflag")


@query(f"""WITH c AS ({_COUNTS}), r AS (SELECT attribute, value, arg_min(label, (-n, label)) AS prediction, max(n) AS b FROM c GROUP BY 1, 2), a AS (SELECT attribute FROM r GROUP BY 1 ORDER BY sum(b) DESC, 1 LIMIT 1)
SELECT attribute, value, prediction FROM r JOIN a USING (attribute)""")
def one_rule_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.one_rule_model(_items(spark, sf_dir), _CLASS["attributes"], _CLASS["label"])


@query(f"""WITH c AS ({_COUNTS}), v AS (SELECT attribute, count(DISTINCT value) AS k FROM c GROUP BY 1), t AS (SELECT attribute, label, sum(n) AS t FROM c GROUP BY 1, 2), g AS (SELECT DISTINCT attribute, value FROM c)
SELECT attribute, value, label, round((coalesce(n, 0) + 1) / (t + k), 8) AS probability FROM g JOIN t USING (attribute) JOIN v USING (attribute) LEFT JOIN c USING (attribute, value, label)""")
def naive_bayes_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.naive_bayes_counts(_items(spark, sf_dir), _CLASS["attributes"], _CLASS["label"])


@query("SELECT l_returnflag AS label, attribute, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS deviation, count(x) AS n FROM (SELECT l_returnflag, 'l_quantity' AS attribute, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem) GROUP BY 1, 2")
def gaussian_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.gaussian_model(table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_returnflag"), ["l_quantity", "l_tax"], "l_returnflag")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared FROM lineitem")
def simple_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.simple_regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@query("SELECT l_returnflag AS label, attribute, min(x) AS least, max(x) AS largest FROM (SELECT l_returnflag, 'l_quantity' AS attribute, l_quantity AS x FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem) GROUP BY 1, 2")
def hyper_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.hyper_pipes(table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax", "l_returnflag"), ["l_quantity", "l_tax"], "l_returnflag")


@query("""WITH c AS (SELECT l_quantity AS v, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1),
s AS (SELECT v, sum(f) OVER (ORDER BY v) AS lf, sum(o) OVER (ORDER BY v) AS lo, sum(f) OVER () AS tf, sum(o) OVER () AS t_o FROM c),
g AS (SELECT v, round(((lf + lo) - (lf * lf + lo * lo) / (lf + lo) + CASE WHEN tf + t_o - lf - lo > 0 THEN (tf + t_o - lf - lo) - ((tf - lf) * (tf - lf) + (t_o - lo) * (t_o - lo)) / (tf + t_o - lf - lo) ELSE 0 END) / (tf + t_o), 9) AS gini FROM s)
SELECT v AS cut, gini FROM g ORDER BY gini, v LIMIT 1""")
def decision_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.decision_stump(table(spark, sf_dir, "lineitem").select("l_quantity", "l_linestatus"), "l_quantity", "l_linestatus")


@query()
def linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = learners.linear_regression(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return spark.createDataFrame([(k, round(v, 4)) for k, v in fitted.items()], "term string, coefficient double")


def _classifier(method: str, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "CAST(p_partkey % 8 AS double) AS q", "CAST(p_size AS double) AS s", "IF(p_partkey % 8 <= 3, 'x', 'z') AS y")
        out = learners.fit_predict(p.where("k % 3 <> 0"), method, ["q"], "y", test=p.where("k % 3 = 0"), **options)
        return evaluation.summary(out, "y", "prediction")

    return run


for _name, _options in {"logistic": {"maxIter": 10}, "decision_tree": {"seed": 1}, "random_forest": {"numTrees": 10, "seed": 1}, "linear_svm": {"maxIter": 5}, "naive_bayes": {}, "boosted_trees": {"maxIter": 3, "seed": 1}}.items():
    QUERIES[f"learner_{_name}"] = _classifier(_name, **_options)
    if _name != "naive_bayes":  # a multinomial model of one attribute cannot tell the classes apart
        ORACLE[f"learner_{_name}"] = "SELECT count(*) AS total, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS kappa FROM part WHERE p_partkey % 3 = 0"


# Evaluation


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select("l_linestatus", F.when(F.col("l_quantity") > 25, "F").otherwise("O").alias("p"), (F.col("l_linestatus") == "F").alias("y"), F.col("l_quantity").alias("score"))


_PRED = "SELECT l_linestatus, CASE WHEN l_quantity > 25 THEN 'F' ELSE 'O' END AS p FROM lineitem"


@query(f"SELECT l_linestatus AS actual, p AS predicted, count(*) AS n FROM ({_PRED}) GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_predictions(spark, sf_dir), "l_linestatus", "p")


@query(f"""WITH x AS ({_PRED}), t AS (SELECT count(*) AS n, count(*) FILTER (l_linestatus = p) / count(*) AS a FROM x),
e AS (SELECT sum(r::DOUBLE * c) AS e FROM (SELECT l_linestatus AS k, count(*) AS r FROM x GROUP BY 1) JOIN (SELECT p AS k, count(*) AS c FROM x GROUP BY 1) USING (k))
SELECT n AS total, round(a, 6) AS accuracy, round((a - e / n / n) / (1 - e / n / n), 6) AS kappa FROM t, e""")
def accuracy_and_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(_predictions(spark, sf_dir), "l_linestatus", "p")


@query(f"""WITH x AS ({_PRED}), r AS (SELECT l_linestatus AS class, count(*) AS r, count(*) FILTER (l_linestatus = p) AS tp FROM x GROUP BY 1), c AS (SELECT p AS class, count(*) AS c FROM x GROUP BY 1)
SELECT class, round(tp / c, 6) AS precision, round(tp / r, 6) AS recall, round(2 * (tp / c) * (tp / r) / (tp / c + tp / r), 6) AS f_measure FROM r JOIN c USING (class)""")
def class_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.per_class(_predictions(spark, sf_dir), "l_linestatus", "p")


@query("""WITH c AS (SELECT l_quantity AS threshold, count(*) FILTER (l_linestatus = 'F') AS p, count(*) AS n FROM lineitem GROUP BY 1),
s AS (SELECT threshold, sum(p) OVER (ORDER BY threshold DESC) AS tp, sum(n - p) OVER (ORDER BY threshold DESC) AS fp, sum(p) OVER () AS tpa, sum(n - p) OVER () AS fpa FROM c)
SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, (tpa - tp)::BIGINT AS fn, (fpa - fp)::BIGINT AS tn FROM s""")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.threshold_counts(_predictions(spark, sf_dir), "y", "score")


@query("""WITH c AS (SELECT l_quantity AS t, count(*) FILTER (l_linestatus = 'F') AS p, count(*) FILTER (l_linestatus <> 'F') AS q FROM lineitem GROUP BY 1),
s AS (SELECT p, q, sum(p) OVER (ORDER BY t DESC) AS tp FROM c) SELECT round(sum(q * (tp - p / 2)) / (sum(p) * sum(q)), 6) AS auc FROM s""")
def roc_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.roc_area(_predictions(spark, sf_dir), "y", "score")


@query("""WITH x AS (SELECT l_extendedprice AS a, l_quantity * 1000 AS p, avg(l_extendedprice) OVER () AS m FROM lineitem)
SELECT round(avg(abs(p - a)), 6) AS mae, round(sqrt(avg((p - a) ^ 2)), 6) AS rmse, round(100 * sum(abs(p - a)) / sum(abs(a - m)), 4) AS rae, round(100 * sqrt(sum((p - a) ^ 2) / sum((a - m) ^ 2)), 4) AS rrse, round(corr(a, p), 6) AS correlation FROM x""")
def regression_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.regression_errors(table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1000).alias("p")), "l_extendedprice", "p")


@query()
def paired_t_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.month("o_orderdate").alias("run")).agg(F.avg("o_totalprice").alias("value"))
    return evaluation.paired_test(runs, "o_orderstatus", ["run"], "value", "F", "O", 0.1)


# Associations and clusters

_BASKETS = "SELECT DISTINCT o_custkey AS basket, o_orderpriority || o_orderstatus AS item FROM orders"


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("basket"), F.concat("o_orderpriority", "o_orderstatus").alias("item"))


@query(f"WITH b AS ({_BASKETS}) SELECT x.item AS a, y.item AS b, count(*) AS n FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 20")
def frequent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return associations.frequent_pairs(_baskets(spark, sf_dir), "basket", "item", 20)


@query(f"""WITH b AS ({_BASKETS}), c AS (SELECT item, count(*) AS n FROM b GROUP BY 1), t AS (SELECT count(DISTINCT basket) AS t FROM b),
p AS (SELECT x.item AS antecedent, y.item AS consequent, count(*) AS n FROM b x JOIN b y ON x.basket = y.basket AND x.item <> y.item GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT antecedent, consequent, p.n, round(p.n / l.n, 6) AS confidence, round((p.n / l.n) / (r.n / t), 6) AS lift, round(p.n / t - l.n * r.n / (t * t), 6) AS leverage, round(l.n * (t - r.n) / (t * (l.n - p.n + 1)), 6) AS conviction
FROM p JOIN c l ON l.item = antecedent JOIN c r ON r.item = consequent, t WHERE p.n / l.n >= 0.3""")
def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return associations.pair_rules(_baskets(spark, sf_dir), "basket", "item", 20, 0.3)


@query(f"""WITH b AS ({_BASKETS}), t AS (SELECT count(DISTINCT basket) AS t FROM b)
SELECT item AS items, count(*) AS freq FROM b, t GROUP BY item, t HAVING count(*) >= ceil(0.2 * t)
UNION ALL SELECT x.item || '|' || y.item, count(*) FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item, t GROUP BY x.item, y.item, t HAVING count(*) >= ceil(0.2 * t)
UNION ALL SELECT x.item || '|' || y.item || '|' || z.item, count(*) FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item JOIN b z ON z.basket = y.basket AND y.item < z.item, t GROUP BY x.item, y.item, z.item, t HAVING count(*) >= ceil(0.2 * t)
UNION ALL SELECT x.item || '|' || y.item || '|' || z.item || '|' || w.item, count(*) FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item JOIN b z ON z.basket = y.basket AND y.item < z.item JOIN b w ON w.basket = z.basket AND z.item < w.item, t GROUP BY x.item, y.item, z.item, w.item, t HAVING count(*) >= ceil(0.2 * t)""")
def frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return associations.itemsets(_baskets(spark, sf_dir), "basket", "item", 0.2)


@query()
def k_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    out, _ = clusters.k_means(parts, ["p_size", "p_retailprice"], 4, "p_partkey")
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("squared"), 4).alias("within"))


@query()
def farthest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    centres = clusters.farthest_first(parts, ["p_size", "p_retailprice"], 4, "p_partkey")
    return spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], "centre int, p_size double, p_retailprice double")


@query()
def gaussian_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    out = learners.fit_predict(parts, "gaussian_mixture", ["p_size", "p_retailprice"], k=3, seed=1)
    return out.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


# Record linkage

_TOKENS = "list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda t: t <> '')"


@query(f"""WITH p AS (SELECT p_partkey, p_brand, {_TOKENS.format(c='p_name')} AS t FROM part)
SELECT a.p_partkey AS id1, b.p_partkey AS id2, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.5""")
def jaccard_within_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linkage.jaccard_pairs(table(spark, sf_dir, "part"), "p_partkey", "p_brand", linkage.tokens("p_name"), 0.5)
    return found.select("id1", "id2", F.round("similarity", 6).alias("similarity"))


@query("""SELECT a.s_suppkey AS id1, b.s_suppkey AS id2, round(1 - levenshtein(a.s_name, b.s_name) / greatest(length(a.s_name), length(b.s_name)), 6) AS similarity
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    pairs = s.select(F.col("s_suppkey").alias("id1"), F.col("s_name").alias("n1"), "s_nationkey").join(s.select(F.col("s_suppkey").alias("id2"), F.col("s_name").alias("n2"), "s_nationkey"), "s_nationkey").where("id1 < id2")
    return pairs.select("id1", "id2", F.round(linkage.edit_similarity("n1", "n2"), 6).alias("similarity"))


_WEIGHTS = f"""w AS (SELECT p_partkey AS id, unnest({_TOKENS.format(c='p_name')}) AS token FROM part), c AS (SELECT id, token, count(*) AS tf FROM w GROUP BY 1, 2), d AS (SELECT token, count(*) AS df FROM c GROUP BY 1),
r AS (SELECT id, token, df, tf * ln((SELECT count(*) FROM part)::DOUBLE / df) AS w FROM c JOIN d USING (token)), l AS (SELECT id, sqrt(sum(w * w)) AS l FROM r GROUP BY 1), u AS (SELECT id, token, df, w / l AS w FROM r JOIN l USING (id) WHERE l > 0)"""


@query(f"WITH {_WEIGHTS} SELECT id AS p_partkey, token, round(w, 6) AS weight FROM u")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.token_weights(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name").select("p_partkey", "token", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_WEIGHTS}, v AS (SELECT id, list(token || ':' || round(w, 9) ORDER BY token) AS v FROM u GROUP BY 1), k AS (SELECT v, min(id) AS class_id, count(*) AS n FROM v GROUP BY 1),
p AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS s FROM u a JOIN u b USING (token) WHERE a.id IN (SELECT class_id FROM k) AND b.id IN (SELECT class_id FROM k) AND a.id <> b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.6),
o AS (SELECT a AS class_id, sum(n) AS n FROM p JOIN k ON b = class_id GROUP BY 1)
SELECT v.id AS p_partkey, k.class_id, (k.n - 1 + coalesce(o.n, 0))::BIGINT AS links FROM v JOIN k USING (v) LEFT JOIN o USING (class_id)""")
def tfidf_cosine_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.cosine_classes(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", 0.6)


@query("WITH n AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_name, c_custkey) AS r FROM customer) SELECT a.id AS id1, b.id AS id2 FROM n a JOIN n b ON b.r - a.r IN (1, 2, 3)")
def sorted_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.sorted_neighbourhood(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", "c_name", 4)


@query()
def affine_gap_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of distinct names that share a first token: the names of parts, each compared once."""
    names = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("k", linkage.tokens("p_name")[0])
    pairs = names.select(F.col("p_name").alias("a"), "k").join(names.select(F.col("p_name").alias("b"), "k"), "k").where("a < b")
    return linkage.affine_similarity(pairs, "a", "b").select("a", "b", F.round("affine", 6).alias("affine"))


def _all() -> None:
    """Import the modules that register more queries."""
    from . import catalog_analysis, catalog_learners, catalog_linkage, catalog_more, catalog_rows  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(ORACLE)
