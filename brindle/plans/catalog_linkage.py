"""Queries of blocking, record distances, duplicate rankings and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stemming
from ..operators import blocking, deduping, linkage
from ..operators.relational import cut
from .catalog import _TOKENS, _WEIGHTS, query, table
from .catalog_rows import _u

_T = _TOKENS.format(c="p_name")
_SIZES = "count(*) AS n, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query(f"SELECT 'exact' AS blocker, p_name AS block, {_SIZES} FROM part GROUP BY 2 UNION ALL SELECT 'first3', substr(p_name, 1, 3), {_SIZES} FROM part GROUP BY 2")
def block_by_value_and_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_sizes(_parts(spark, sf_dir), "p_partkey", {"exact": blocking.exact("p_name"), "first3": blocking.first_chars("p_name")})


@query(f"SELECT 'size' AS blocker, p_size::DOUBLE::VARCHAR AS block, {_SIZES} FROM part GROUP BY 2")
def block_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_sizes(_parts(spark, sf_dir), "p_partkey", {"size": blocking.exact_number("p_size")})


@query(f"SELECT 'words' AS blocker, block, {_SIZES} FROM (SELECT p_partkey, unnest(list_distinct({_T})) AS block FROM part) GROUP BY 2")
def block_by_common_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_sizes(_parts(spark, sf_dir), "p_partkey", {"words": blocking.common_words("p_name")})


@query(f"SELECT 'integers' AS blocker, block, {_SIZES} FROM (SELECT p_partkey, unnest(list_distinct(list_filter(list_transform({_TOKENS.format(c='p_brand')}, lambda t: regexp_replace(t, '[^0-9]', '', 'g')), lambda t: t <> ''))) AS block FROM part) GROUP BY 2")
def block_by_common_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_sizes(_parts(spark, sf_dir), "p_partkey", {"integers": blocking.common_integers("p_brand")})


@query(f"SELECT 'bigrams' AS blocker, block, {_SIZES} FROM (SELECT p_partkey, unnest(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || t[i + 1]))) AS block FROM (SELECT p_partkey, {_T} AS t FROM part)) GROUP BY 2")
def block_by_token_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.block_sizes(_parts(spark, sf_dir), "p_partkey", {"bigrams": blocking.token_ngrams("p_name")})


@query(f"SELECT 'combo' AS blocker, replace(block, chr(31), '&') AS block, n, pairs FROM (SELECT p_brand || chr(31) || substr(p_name, 1, 3) AS block, {_SIZES} FROM part GROUP BY 1)")
def block_by_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = blocking.conjunction(blocking.exact("p_brand"), blocking.first_chars("p_name"))
    return blocking.block_sizes(_parts(spark, sf_dir), "p_partkey", {"combo": both}).withColumn("block", F.translate("block", "\x1f", "&"))


@query("SELECT a.s_suppkey AS id1, b.s_suppkey AS id2 FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND (a.s_nationkey = b.s_nationkey OR round(a.s_acctbal / 100) = round(b.s_acctbal / 100))")
def manual_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("balance", F.round(F.col("s_acctbal") / 100))
    return blocking.candidates(s, "s_suppkey", {"nation": blocking.exact("s_nationkey"), "balance": blocking.exact_number("balance")})


_COVER = """SELECT '{n}' AS blocker, sum(same)::BIGINT AS positives, sum(n * (n - 1) // 2 - same)::BIGINT AS negatives FROM (SELECT block, sum(n) AS n, sum(n * (n - 1) // 2) AS same FROM (SELECT {b} AS block, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1)"""


@query(_COVER.format(n="brand", b="p_brand") + " UNION ALL " + _COVER.format(n="first3", b="substr(p_name, 1, 3)"))
def blocking_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.coverage(_parts(spark, sf_dir), "p_partkey", "p_type", {"brand": blocking.exact("p_brand"), "first3": blocking.first_chars("p_name")})


_KEYS = {"brand": ("p_brand",), "size": ("p_size",), "brand&size": ("p_brand", "p_size")}


def _nation_blockers() -> dict:
    return {"brand": blocking.exact("p_brand"), "size": blocking.exact_number("p_size"), "first3": blocking.first_chars("p_name")}


@query("""WITH p AS (SELECT * FROM part), o AS (SELECT count(*) FILTER (a.p_brand = b.p_brand) AS brand, count(*) FILTER (a.p_size = b.p_size) AS size, count(*) FILTER (substr(a.p_name, 1, 3) = substr(b.p_name, 1, 3)) AS first3, count(*) AS t FROM p a JOIN p b ON a.p_type = b.p_type AND a.p_partkey < b.p_partkey),
c AS (SELECT count(*) FILTER (a.p_brand = b.p_brand) AS brand, count(*) FILTER (a.p_size = b.p_size) AS size, count(*) FILTER (substr(a.p_name, 1, 3) = substr(b.p_name, 1, 3)) AS first3 FROM p a JOIN p b ON a.p_type <> b.p_type AND a.p_partkey < b.p_partkey)
SELECT 0 AS place, arg_max(n, g) AS blocker FROM (SELECT 'brand' AS n, o.brand / (c.brand + 50) AS g FROM o, c UNION ALL SELECT 'size', o.size / (c.size + 50) FROM o, c UNION ALL SELECT 'first3', o.first3 / (c.first3 + 50) FROM o, c)""")
def set_cover_first_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    blockers = _nation_blockers() | {"first3": F.when(F.col("p_name").isNotNull(), F.array(F.substring("p_name", 1, 3)))}
    return spark.createDataFrame([(0, blocking.first_choice(_parts(spark, sf_dir), "p_partkey", "p_type", blockers))], "place int, blocker string")


@query()
def set_cover_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(blocking.learn_cover(p, "p_partkey", "p_type", _nation_blockers()))), "place int, blocker string")


@query()
def set_cover_dnf_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    return spark.createDataFrame(list(enumerate(blocking.learn_cover(p, "p_partkey", "p_type", blocking.conjunctions(_nation_blockers())))), "place int, blocker string")


@query()
def random_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = blocking.random_choice(_nation_blockers(), 2)
    return blocking.coverage(_parts(spark, sf_dir), "p_partkey", "p_type", {n: _nation_blockers()[n] for n in chosen})


@query(f"SELECT p_partkey, p_brand FROM part WHERE {_u('p_brand')} < 0.4")
def sample_by_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocking.sample_objects(_parts(spark, sf_dir).select("p_partkey", "p_brand"), "p_brand", 0.4)


@query()
def tfidf_canopies(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _parts(spark, sf_dir).select("p_name").distinct()
    words = names.select("p_name", linkage.tokens("p_name").alias("t"))
    a, b = words.toDF("id1", "t1"), words.toDF("id2", "t2")
    met = a.select("id1", "t1", F.explode("t1").alias("w")).join(b.select("id2", "t2", F.explode("t2").alias("w")), "w").where("id1 < id2").drop("w").distinct()
    return blocking.canopies(met.withColumn("similarity", linkage.jaccard(F.col("t1"), F.col("t2"))), names, "p_name", 0.3)


# Pairs and distances


@query("SELECT a.n_nationkey AS id1, b.n_nationkey AS id2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def positive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduping.positives(table(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey")


@query(f"""WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS rid FROM supplier), d AS (SELECT floor({_u("i || '/a'")} * (SELECT count(*) FROM r))::BIGINT AS p, floor({_u("i || '/b'")} * (SELECT count(*) FROM r))::BIGINT AS q FROM range(200) t(i))
SELECT DISTINCT least(x.s_suppkey, y.s_suppkey) AS id1, greatest(x.s_suppkey, y.s_suppkey) AS id2 FROM d JOIN r x ON x.rid = p JOIN r y ON y.rid = q WHERE x.s_nationkey <> y.s_nationkey""")
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduping.negatives(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", 200)


@query("SELECT a.s_suppkey AS id1, b.s_suppkey AS id2, abs(a.s_acctbal - b.s_acctbal) AS d FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey ORDER BY round(3, 6), 3 DESC, 1, 2 LIMIT 10")
def hardest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    pairs = deduping.with_fields(deduping.positives(s, "s_suppkey", "s_nationkey"), s, "s_suppkey", ["s_acctbal"])
    return deduping.hardest(pairs.withColumn("d", F.abs(F.col("s_acctbal_1") - F.col("s_acctbal_2"))), "d", 10).select("id1", "id2", "d")


@query("SELECT a.s_suppkey AS id1, b.s_suppkey AS id2, round(levenshtein(a.s_name, b.s_name) / greatest(length(a.s_name), length(b.s_name)) + abs(a.s_acctbal - b.s_acctbal) / 1000, 6) AS distance FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def sum_of_field_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    pairs = deduping.with_fields(deduping.positives(s, "s_suppkey", "s_nationkey"), s, "s_suppkey", ["s_name", "s_acctbal"])
    metrics = {"name": 1 - linkage.edit_similarity("s_name_1", "s_name_2"), "balance": F.abs(F.col("s_acctbal_1") - F.col("s_acctbal_2")) / 1000}
    return deduping.sum_distance(pairs, metrics, common=("s_name_1", "s_name_2"), least_common=1).select("id1", "id2", F.round("distance", 6).alias("distance"))


@query()
def classifier_record_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("cell", F.floor(F.col("s_acctbal") / 2000))
    pairs = deduping.paired_classes(s, "s_suppkey", "s_nationkey", ["s_acctbal", "cell"])
    measured = pairs.select((F.abs(F.col("s_acctbal_1") - F.col("s_acctbal_2")) / 1000).alias("balance"), (F.col("cell_1") == F.col("cell_2")).alias("y"), "n")
    cells = cut(measured.groupBy("balance", "y").agg(F.sum("n").alias("n")))
    out = deduping.classifier_distance(cells, cells, {"balance": F.col("balance")}, "y", weight="n")
    total = cells.where("y").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return deduping.average_precision(out.withColumn("score", -F.col("distance")), "y", "score", total, "n")


@query(f"WITH {_WEIGHTS}, k AS (SELECT a.id AS id1, b.id AS id2, sum(a.w * b.w) AS s FROM u a JOIN u b ON a.token = b.token AND b.id = a.id + 1 GROUP BY 1, 2) SELECT p.p_partkey AS id1, p.p_partkey + 1 AS id2, round(coalesce(s, 0), 6) AS similarity FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1 LEFT JOIN k ON k.id1 = p.p_partkey")
def cosine_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).select("p_partkey", "p_name")
    pairs = p.select(F.col("p_partkey").alias("id1")).join(p.select(F.col("p_partkey").alias("id2")), F.col("id2") == F.col("id1") + 1)
    return deduping.cosine(pairs, p, "p_partkey", "p_name").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH t AS (SELECT p_partkey AS k, list_distinct({_T}) AS t FROM part) SELECT a.k AS id1, b.k AS id2, round(len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)), 6) AS similarity FROM t a JOIN t b ON b.k = a.k + 1")
def shared_of_larger(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).select("p_partkey", linkage.tokens("p_name").alias("t"))
    pairs = p.toDF("id1", "t1").join(p.toDF("id2", "t2"), F.col("id2") == F.col("id1") + 1)
    return pairs.select("id1", "id2", F.round(linkage.shared_of_larger(F.col("t1"), F.col("t2")), 6).alias("similarity"))


@query("SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(p_name) - 2), lambda i: substr(lower(p_name), i, 3))) AS gram FROM part) GROUP BY 1")
def character_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select(F.explode(linkage.ngrams_but_last("p_name")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query()
def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.explode(linkage.tokens("text")).alias("word")).distinct()
    return words.where("word rlike '^[a-z]+$'").select("word", stemming.stemmed("word").alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("words"))


# Duplicates and evaluation

_ADJACENT = "SELECT s_suppkey, s_acctbal, lead(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) - s_acctbal AS gap, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r FROM supplier"


def _gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    near = linkage.sorted_neighbourhood(s, "s_suppkey", "s_acctbal", 2)
    pairs = deduping.with_fields(near, s, "s_suppkey", ["s_acctbal"])
    return s, pairs.select("id1", "id2", F.abs(F.col("s_acctbal_1") - F.col("s_acctbal_2")).alias("distance"))


@query(f"""WITH a AS ({_ADJACENT}), c AS (SELECT s_suppkey, coalesce(sum((gap > 20)::INT) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM a)
SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY g) AS cluster FROM c""")
def single_link_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, pairs = _gaps(spark, sf_dir)
    return deduping.single_link(pairs, s, "s_suppkey", "distance", 20.0)


@query(f"""WITH a AS ({_ADJACENT}), w AS (SELECT *, row_number() OVER (ORDER BY gap DESC NULLS LAST) AS big FROM a), c AS (SELECT s_suppkey, coalesce(sum((big <= 4)::INT) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM w)
SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY g) AS cluster FROM c""")
def clustering_deduper(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, pairs = _gaps(spark, sf_dir)
    return deduping.agglomerated(pairs, s, "s_suppkey", "distance", 5)


_SCORED = "SELECT l_discount AS t, count(*) FILTER (l_linestatus = 'F') AS p, count(*) AS n FROM lineitem GROUP BY 1"
_RUNS = f"c AS ({_SCORED}), s AS (SELECT t, p, sum(p) OVER (ORDER BY t DESC) AS tp, sum(n) OVER (ORDER BY t DESC) AS n, sum(p) OVER () AS a FROM c)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_discount", (F.col("l_linestatus") == "F").alias("y"))


@query(f"WITH {_RUNS} SELECT round(sum(tp / n * p) / max(a), 6) AS map, round(max(2 * tp / (n + a)), 6) AS max_f1 FROM s")
def deduper_map_and_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _scored(spark, sf_dir)
    return deduping.average_precision(pairs, "y", "l_discount", pairs.where("y").count())


@query(f"WITH {_RUNS} SELECT round(g / 100, 4) AS recall, round(coalesce((SELECT max(tp / n) FROM s WHERE floor(tp * 100 / a + 1e-9) >= g), 0), 6) AS precision FROM range(101) x(g)")
def deduper_precision_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _scored(spark, sf_dir)
    return deduping.interpolated_precision(pairs, "y", "l_discount", pairs.where("y").count())


@query(f"""WITH {_RUNS}, k AS (SELECT count(*) AS r FROM supplier) SELECT (r * (r - 1) // 2)::BIGINT AS total_pairs, max(a)::BIGINT AS true_pairs, max(s.n)::BIGINT AS candidates, max(tp)::BIGINT AS found, round(max(tp) / max(a), 6) AS recall, round(1 - max(s.n) / (r * (r - 1) // 2), 6) AS reduction,
round(sum(tp / s.n * p) / max(a), 6) AS map, round(max(2 * tp / (s.n + a)), 6) AS max_f1 FROM s, k GROUP BY r""")
def linkage_split_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _scored(spark, sf_dir)
    return deduping.split_row(pairs, "y", "l_discount", table(spark, sf_dir, "supplier").count(), pairs.where("y").count())


_FOLD = "(('0x' || substr(md5(p_brand), 1, 8))::BIGINT % 2)::INTEGER"


@query(f"SELECT p_partkey, p_brand, {_FOLD} AS fold FROM part")
def folds_by_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduping.object_folds(_parts(spark, sf_dir).select("p_partkey", "p_brand"), "p_brand", 2)


@query(f"""WITH f AS (SELECT p_brand, {_FOLD} AS fold, {_u('p_brand')} AS u FROM part), s AS (SELECT unnest([0, 1]) AS fold), h AS (SELECT unnest([0.5::DOUBLE, 1.0]) AS share)
SELECT s.fold, share, (SELECT count(*) FROM f WHERE f.fold <> s.fold AND u < share) AS train, (SELECT count(*) FROM f WHERE f.fold = s.fold) AS test FROM s, h""")
def linkage_learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(train: DataFrame, test: DataFrame) -> DataFrame:
        return train.agg(F.count(F.lit(1)).alias("train")).join(F.broadcast(test.agg(F.count(F.lit(1)).alias("test"))))

    return deduping.learning_curve(_parts(spark, sf_dir).select("p_partkey", "p_brand"), "p_brand", [0.5, 1.0], run)
