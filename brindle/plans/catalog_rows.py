"""Queries of row filters, samples, joins and column transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns, relational, rows, transforms
from .catalog import query, table


def _u(text: str, seed: int = 1) -> str:
    """SQL of ``rows.uniform``."""
    return f"(('0x' || substr(md5('{seed}:' || {text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) - 1 AS rid FROM customer")
def randomize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.randomized(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


@query(f"""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS rid, count(*) OVER () AS n FROM part), d AS (SELECT i AS draw, floor({_u('i')} * (SELECT count(*) FROM part))::BIGINT AS rid FROM range((SELECT count(*) FROM part)) t(i))
SELECT draw, p_partkey FROM d JOIN r USING (rid)""")
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.resampled(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select("draw", "p_partkey")


@query(f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS rid FROM orders), s AS (SELECT o_orderstatus, min(rid) AS f, count(*) AS n, row_number() OVER (ORDER BY o_orderstatus) - 1 AS c FROM r GROUP BY 1),
d AS (SELECT i AS draw, {_u("i || '/b'")} AS b, {_u("i || '/c'")} AS c, {_u("i || '/r'")} AS u FROM range((SELECT count(*) // 2 FROM orders)) t(i)),
e AS (SELECT draw, f + floor(u * n)::BIGINT AS rid FROM d JOIN s ON s.c = floor(d.c * (SELECT count(*) FROM s))::BIGINT WHERE b < 0.5 UNION ALL SELECT draw, floor(u * (SELECT count(*) FROM r))::BIGINT FROM d WHERE b >= 0.5)
SELECT draw, o_orderkey, o_orderstatus FROM e JOIN r USING (rid)""")
def class_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return rows.class_resampled(orders, "o_orderstatus", "o_orderkey", bias=0.5, percent=50).select("draw", "o_orderkey", "o_orderstatus")


@query("""SELECT 'split' AS option, count(*) AS n FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'split inverted', count(*) FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'labels', count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING') UNION ALL SELECT 'missing', count(*) FROM events WHERE event_id % 3 <> 0 AND value >= 50""")
def remove_with_values_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    made = {"split": rows.remove_with_values(s, "s_acctbal", 0.0), "split inverted": rows.remove_with_values(s, "s_acctbal", 0.0, invert=True), "labels": rows.remove_with_values(c, "c_mktsegment", labels=["BUILDING"]), "missing": rows.remove_with_values(e, "value", 50.0, match_missing=True)}
    parts = [d.agg(F.lit(n).alias("option"), F.count(F.lit(1)).alias("n")) for n, d in made.items()]
    return rows.concatenated(*parts)


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS n FROM customer) WHERE NOT (r BETWEEN 1 AND 10 OR r = 20 OR r = n)")
def remove_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.remove_range(table(spark, sf_dir, "customer").select("c_custkey"), "first-10,20,last", "c_custkey")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY md5('7:' || c_custkey), c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer) WHERE (CASE WHEN r < (n % 4) * (n // 4 + 1) THEN r // (n // 4 + 1) ELSE n % 4 + (r - (n % 4) * (n // 4 + 1)) // (n // 4) END) <> 1")
def remove_folds_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.md5(F.concat(F.lit("7:"), F.col("c_custkey").cast("string")))
    return rows.remove_folds(table(spark, sf_dir, "customer").select("c_custkey"), 4, 2, order, "c_custkey", invert=True)


@query("SELECT c_custkey FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1) % 4 AS f FROM customer) WHERE f = 2")
def stratified_remove_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.remove_folds(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), 4, 3, "c_custkey", label="c_mktsegment").select("c_custkey")


@query(f"SELECT o_orderkey, CASE WHEN {_u('o_orderkey')} < 0.66 THEN 'train' ELSE 'test' END AS part FROM orders")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.train_test(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 66)


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT -1, 'appended'")
def union_and_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return rows.concatenated(n, r, spark.createDataFrame([(-1, "appended")], n.schema))


@query("SELECT s_nationkey, s_acctbal, row_number() OVER (ORDER BY s_nationkey NULLS FIRST, s_acctbal NULLS FIRST) - 1 AS rid FROM supplier")
def sort_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sorted_by_all(table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal"))


@query("SELECT 'first' AS place, * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1) UNION ALL SELECT 'last', * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1)")
def first_and_last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.ends_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT event_id, value FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL")
def delete_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return rows.without_missing(e, "value")


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def delete_string_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.remove_type(table(spark, sf_dir, "customer"), "string")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS segment FROM customer")
def rename_attribute_and_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return rows.renamed_label(c, "segment", "BUILDING", "HOUSING")


@query("SELECT list(s_acctbal ORDER BY s_suppkey) AS values FROM supplier")
def attribute_to_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.as_array(table(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey")


_SUMMARY = " UNION ALL ".join(f"SELECT '{c}' AS column, '{k}' AS kind, count({c}) AS present, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", min({c})::VARCHAR AS least, max({c})::VARCHAR AS largest FROM part" for c, k in (("p_partkey", "bigint"), ("p_brand", "string"), ("p_size", "int")))


@query(_SUMMARY)
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.summary(table(spark, sf_dir, "part"), ["p_partkey", "p_brand", "p_size"])


@query("SELECT 'same' AS tables, 0 AS differences UNION ALL SELECT 'customer, supplier', 5")
def header_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return spark.createDataFrame([("same", len(rows.header_difference(c, c))), ("customer, supplier", len(rows.header_difference(c, s)))], "tables string, differences int")


@query("SELECT l_orderkey * 10 + l_linenumber AS k, l_discount, l_tax FROM lineitem")
def sparse_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_discount", "l_tax")
    return rows.to_dense(rows.to_sparse(items, ["l_discount", "l_tax"], "k"), ["l_discount", "l_tax"], "k")


@query("SELECT sum((l_discount <> 0)::INT + (l_tax <> 0)::INT)::BIGINT AS cells FROM lineitem")
def non_sparse_to_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_discount", "l_tax")
    return rows.to_sparse(items, ["l_discount", "l_tax"], "k").agg(F.sum(F.size("cells")).alias("cells"))


@query("SELECT (SELECT count(*) FROM region) AS everything, 0::BIGINT AS nothing")
def all_and_null_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return rows.identity(r).agg(F.count(F.lit(1)).alias("everything")).join(F.broadcast(rows.nothing(r).agg(F.count(F.lit(1)).alias("nothing"))))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.kept_by(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.missing_from(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT p_partkey, s_suppkey FROM part JOIN (SELECT s_suppkey, s_acctbal AS low, s_acctbal + 50 AS high FROM supplier) ON p_retailprice >= low AND p_retailprice < high")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    return rows.range_join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", s, "low", "high", 50.0).select("p_partkey", "s_suppkey")


@query("""WITH v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2), b AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'view')
SELECT event_id, v.value AS last FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts >= v.ts""")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seen = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return rows.as_of_join(e.where("event_type <> 'view'").select("event_id", "user_id", "ts"), seen, ["user_id"], "ts", "value").select("event_id", "last")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS grouping FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.cubed(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.pivoted(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT count(*) AS n_distinct, count(*) FILTER (n = 1) AS n_unique FROM (SELECT o_totalprice, count(*) AS n FROM orders GROUP BY 1)")
def sort_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sort_aggregate(table(spark, sf_dir, "orders"), "o_totalprice")


@query("SELECT 'both' AS kind, n_nationkey AS k FROM nation INTERSECT SELECT 'both', s_nationkey FROM supplier WHERE s_nationkey < 10 UNION ALL (SELECT 'rest', n_nationkey FROM nation EXCEPT SELECT 'rest', s_nationkey FROM supplier WHERE s_nationkey < 10)")
def intersect_and_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").where("s_nationkey < 10").select(F.col("s_nationkey").alias("k"))
    return n.intersect(s).select(F.lit("both").alias("kind"), "k").union(n.exceptAll(s.distinct()).select(F.lit("rest"), "k"))


@query("SELECT o_orderstatus, o_orderpriority FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_totalprice > 100000 THEN 'O' ELSE 'F' END AS p FROM orders) WHERE p = o_orderstatus")
def remove_misclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    learn = lambda _, test: test.select("o_orderkey", F.when(F.col("o_totalprice") > 100000, "O").otherwise("F").alias("prediction"))
    return rows.remove_misclassified(o, "o_orderstatus", "o_orderkey", learn).select("o_orderstatus", "o_orderpriority")


# Columns


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def remove_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.remove_type(table(spark, sf_dir, "part"), "string")


@query("SELECT s_suppkey, abs(s_acctbal) AS s_acctbal FROM supplier")
def numeric_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.numeric_transform(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"])


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN round(ln(s_acctbal), 6) END AS s_acctbal FROM supplier")
def numeric_transform_undefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = columns.numeric_transform(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"], "log")
    return out.withColumn("s_acctbal", F.round("s_acctbal", 6))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderkey < 20) THEN o_orderpriority END AS o_orderpriority FROM orders")
def string_to_nominal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return columns.string_to_nominal(o, "o_orderpriority", o.where("o_orderkey < 20"))


@query(f"""WITH l AS (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS l FROM customer)
SELECT c_custkey, CASE WHEN {_u('c_custkey')} < 0.1 THEN l[((list_position(l, c_mktsegment) - 1 + 1 + floor({_u("c_custkey || '/label'")} * (len(l) - 1))::BIGINT) % len(l)) + 1] ELSE c_mktsegment END AS c_mktsegment FROM customer, l""")
def add_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.add_noise(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


@query("""WITH m AS (SELECT o_orderstatus, row_number() OVER (ORDER BY avg(o_totalprice), o_orderstatus) AS r FROM orders GROUP BY 1)
SELECT o_orderkey, (r > 1)::INT::DOUBLE AS after_1, (r > 2)::INT::DOUBLE AS after_2 FROM orders JOIN m USING (o_orderstatus)""")
def ordered_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = columns.ordered_indicators(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", "o_totalprice").drop("o_totalprice")
    return out.toDF("o_orderkey", "after_1", "after_2")


@query("""WITH d AS (SELECT p_partkey, 0.5 * exp(0 - ((p_size - 10) / 5.0::DOUBLE) ^ 2 / 2) / 5 AS a, 0.5 * exp(0 - ((p_size - 40) / 10.0::DOUBLE) ^ 2 / 2) / 10 AS b FROM part)
SELECT p_partkey, round(a / (a + b), 6) AS p0, round(b / (a + b), 6) AS p1 FROM d""")
def cluster_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = columns.cluster_membership(table(spark, sf_dir, "part").select("p_partkey", "p_size"), ["p_size"], [((10.0,), (5.0,), 0.5), ((40.0,), (10.0,), 0.5)])
    return out.withColumns({c: F.round(c, 6) for c in ("p0", "p1")})


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate FROM orders")
def date_through_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.date_through_format(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "yyyy-MM")


@query("SELECT 'V' || dense_rank() OVER (ORDER BY o_orderstatus) AS \"A1\", 'V' || dense_rank() OVER (ORDER BY o_orderpriority) AS \"A2\" FROM orders")
def obfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.obfuscated(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"])[0]


@query("""WITH b AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS z FROM part), c AS (SELECT k, least(greatest(ceil((p_retailprice - a) / ((z - a) / k)) - 1, 0), k - 1) AS bin, z - a AS w, count(*) AS n FROM part, b, range(1, 11) t(k) GROUP BY ALL)
SELECT arg_min(k, e)::INTEGER AS bins FROM (SELECT k, round(-sum(n * CASE WHEN n > 1 THEN ln((n - 1) * k / w) ELSE -1e300 END), 9) AS e FROM c GROUP BY k)""")
def best_width_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(columns.best_width_bins(table(spark, sf_dir, "part"), "p_retailprice"),)], "bins int")


@query("""WITH w AS (SELECT p_partkey, p_type, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS word FROM part), c AS (SELECT p_partkey, p_type, word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN ('ring') GROUP BY ALL),
k AS (SELECT DISTINCT word FROM (SELECT word, row_number() OVER (PARTITION BY p_type ORDER BY sum(n) DESC, word) AS r FROM c GROUP BY p_type, word) WHERE r <= 5), x AS (SELECT p_partkey, word, ln(1 + n) AS v FROM c JOIN k USING (word)), l AS (SELECT p_partkey, sqrt(sum(v * v)) AS l FROM x GROUP BY 1)
SELECT p_partkey, word, round(v * (SELECT avg(l) FROM l) / l, 6) AS weight FROM x JOIN l USING (p_partkey)""")
def word_vector_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = columns.word_weights(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name"), "p_partkey", "p_name", 5, label="p_type", tf=True, stop=["ring"], average_length=True)
    return out.withColumn("weight", F.round("weight", 6))


@query("SELECT event_id, round(value - lead(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS value FROM events QUALIFY lead(value, 3) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL")
def time_series_without_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return transforms.shifted(e, ["value"], 3, ["user_id"], ["ts", "event_id"], delta=True).where("value IS NOT NULL").select("event_id", F.round("value", 6).alias("value"))


@query("SELECT c_custkey, code FROM customer JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS code FROM customer GROUP BY 1) USING (c_mktsegment)")
def class_order_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.class_order(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ascending=False).select("c_custkey", "code")


@query("SELECT sum(o_totalprice * w) / sum(w) AS mean, arg_max(o_orderstatus, s) AS mode FROM (SELECT *, 1 + o_orderkey % 3 AS w FROM orders), (SELECT o_orderstatus AS st, sum(1 + o_orderkey % 3) AS s FROM orders GROUP BY 1 ORDER BY 2 DESC LIMIT 1) WHERE o_orderstatus = st OR true".replace("arg_max(o_orderstatus, s)", "max(st)").replace("sum(o_totalprice * w) / sum(w)", "round(sum(o_totalprice * w) / sum(w), 4)"))
def weighted_mean_and_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("w", 1 + F.col("o_orderkey") % 3)
    return relational.weighted_mean_or_mode(o, "o_totalprice", "o_orderstatus", "w").select(F.round("mean", 4).alias("mean"), "mode")
