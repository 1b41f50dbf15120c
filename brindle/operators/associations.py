"""Association rules over baskets: level-wise itemsets by FP-growth, measures from supports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent_pairs(baskets: DataFrame, basket: str, item: str, least: int) -> DataFrame:
    """a, b, n for pairs of frequent items (a < b) in at least ``least`` baskets.

    Items below the support go before any pair is formed, as no pair with them can be frequent; pairs are made inside a
    basket's sorted set.
    """
    single = baskets.where(F.col(item).isNotNull()).select(basket, item).distinct()
    frequent = single.groupBy(item).count().where(F.col("count") >= least).select(item)
    sets = single.join(frequent, item).groupBy(basket).agg(F.array_sort(F.collect_set(item)).alias("s"))
    pairs = F.expr("flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> named_struct('a', a, 'b', b))))")
    return sets.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").count().where(F.col("count") >= least).select("a", "b", F.col("count").alias("n"))


def pair_rules(baskets: DataFrame, basket: str, item: str, least: int, confidence: float) -> DataFrame:
    """antecedent, consequent, support count, confidence, lift, leverage and conviction of two-item rules."""
    single = baskets.where(F.col(item).isNotNull()).select(basket, item).distinct()
    total = single.agg(F.count_distinct(basket).alias("total"))
    counts = single.groupBy(item).count()
    pairs = frequent_pairs(baskets, basket, item, least)
    both = pairs.select(F.col("a").alias("antecedent"), F.col("b").alias("consequent"), "n").union(pairs.select("b", "a", "n"))
    left = counts.select(F.col(item).alias("antecedent"), F.col("count").alias("na"))
    right = counts.select(F.col(item).alias("consequent"), F.col("count").alias("nb"))
    j = both.join(left, "antecedent").join(right, "consequent").join(F.broadcast(total))
    conf = F.col("n") / F.col("na")
    share = F.col("nb") / F.col("total")
    return j.where(conf >= confidence).select(
        "antecedent", "consequent", "n", F.round(conf, 6).alias("confidence"), F.round(conf / share, 6).alias("lift"),
        F.round(F.col("n") / F.col("total") - F.col("na") / F.col("total") * F.col("nb") / F.col("total"), 6).alias("leverage"),
        F.round(F.col("na").cast("double") * (F.col("total") - F.col("nb")) / F.col("total") / (F.col("na") - F.col("n") + 1), 6).alias("conviction"),
    )


def itemsets(baskets: DataFrame, basket: str, item: str, support: float) -> DataFrame:
    """items, freq of all sizes by FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    sets = baskets.where(F.col(item).isNotNull()).groupBy(basket).agg(F.collect_set(item).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(sets).freqItemsets
    return found.select(F.array_join(F.array_sort("items"), "|").alias("items"), "freq")
