"""Dataset primitives: positions, order, folds, samples and column statistics.

Positions come from a global row number that is built from counts of range partitions, so that no window ever pulls the
whole table into one task.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the folder that the cluster names; a temporary one only in local mode where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="brindle-"))
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, *order: str | Column, name: str = "rid") -> DataFrame:
    """A global row number from 0 in the given order: range partitions are sorted, counted and offset."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    laid = cut(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    starts, total = [], 0
    for r in sorted(laid.groupBy(part.alias("p")).count().collect()):
        starts.append((r["p"], total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return laid.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + row).drop("_part", "_start", "_at")


def slice_rows(df: DataFrame, first: int, count: int, *order: str) -> DataFrame:
    n = numbered(df, *order)
    return n.where(F.col("rid").between(first, first + count - 1)).drop("rid")


def remove_percentage(df: DataFrame, percent: float, *order: str, invert: bool = False) -> DataFrame:
    """Drops the first share of rows in the given order; with ``invert`` keeps only them."""
    n = numbered(df, *order)
    edge = round(df.count() * percent / 100)
    return n.where((F.col("rid") < edge) if invert else (F.col("rid") >= edge)).drop("rid")


def fold_column(rid: Column, rows: int, folds: int) -> Column:
    """Consecutive folds; the first ones have one row more where the rows do not divide."""
    small, rest = divmod(rows, folds)
    edge = rest * (small + 1)
    return F.when(rid < edge, F.floor(rid / (small + 1))).otherwise(rest + F.floor((rid - edge) / max(small, 1))).cast("int")


def with_folds(df: DataFrame, folds: int, *order: str) -> DataFrame:
    n = numbered(df, *order)
    return n.withColumn("fold", fold_column(F.col("rid"), df.count(), folds)).drop("rid")


def stratified_folds(df: DataFrame, label: str, folds: int, *order: str) -> DataFrame:
    """Rows are laid class by class, then dealt out one by one."""
    return numbered(df, label, *order).withColumn("fold", (F.col("rid") % folds).cast("int")).drop("rid")


def zip_columns(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Columns side by side by position; both sides must have as many rows."""
    if left.count() != right.count():
        raise ValueError("the tables differ in length")
    return numbered(left, left_order).join(numbered(right, right_order), "rid").drop("rid")


def kth_smallest(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k-th smallest value from 1, nulls left out (null if there are fewer): by position, so that no task holds k rows."""
    rows = numbered(df.where(F.col(column).isNotNull()).select(column), column)
    return rows.where(F.col("rid") == k - 1).agg(F.max(column).alias("value"))


def mean_or_mode(df: DataFrame, numeric: list[str], nominal: list[str]) -> DataFrame:
    """attribute, value as text: means of numeric columns and the commonest label of others (smallest on ties)."""
    means = df.agg(*[measures.weighted_mean(c).alias(c) for c in numeric])
    parts = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.round(c, 6).alias("mean"), F.lit(None).cast("string").alias("mode")) for c in numeric])).alias("x")).select("x.*")
    for c in nominal:
        best = df.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.min_by(c, F.struct(-F.col("count"), F.col(c))).alias("mode"))
        parts = parts.unionByName(best.select(F.lit(c).alias("attribute"), F.lit(None).cast("double").alias("mean"), F.col("mode").cast("string").alias("mode")))
    return parts


def weighted_mean_or_mode(df: DataFrame, numeric: str, nominal: str, weight: str) -> DataFrame:
    """mean and mode of two columns with row weights (the smallest label on ties)."""
    mode = df.where(F.col(nominal).isNotNull()).groupBy(nominal).agg(F.sum(weight).alias("_w")).agg(F.min_by(nominal, F.struct(-F.col("_w"), F.col(nominal))).alias("mode"))
    return df.agg(measures.weighted_mean(numeric, weight).alias("mean")).join(F.broadcast(mode))


def attribute_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """attribute, total, missing, distinct and unique values: one two-level aggregation for all columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("attribute", "value").count()
    some = F.col("value").isNotNull()
    return counts.groupBy("attribute").agg(
        F.sum("count").alias("total"),
        F.coalesce(F.sum(F.when(~some, F.col("count"))), F.lit(0)).alias("missing"),
        F.count("value").alias("n_distinct"),
        F.coalesce(F.sum((some & (F.col("count") == 1)).cast("long")), F.lit(0)).alias("n_unique"),
    )


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """attribute with count, sum, sum of squares, least, largest, mean and sample deviation, in one pass."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs.append(F.struct(F.lit(c).alias("attribute"), F.count(c).alias("n"), F.round(F.sum(x), 4).alias("total"), F.round(F.sum(x * x), 2).alias("squares"), F.min(x).alias("least"), F.max(x).alias("largest"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("deviation")))
    return df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def spread_subsample(df: DataFrame, label: str, spread: float, order: str) -> DataFrame:
    """Caps each class at ``spread`` times the rarest class, by a hash of ``order``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).count()
    cap = counts.agg(F.floor(F.min("count") * spread).alias("cap"))
    ranked = numbered(df.where(F.col(label).isNotNull()), label, F.md5(F.col(order).cast("string")), order)
    first = ranked.groupBy(label).agg(F.min("rid").alias("_first"))
    return ranked.join(F.broadcast(first), label).join(F.broadcast(cap)).where(F.col("rid") - F.col("_first") < F.col("cap")).drop("rid", "_first", "cap")


def resample_weighted(df: DataFrame, weight: str, order: str, draws: int) -> DataFrame:
    """Systematic draws over cumulated weights: row i is taken floor(end * n) - floor(start * n) times."""
    n = numbered(df.where(F.col(weight) > 0), order)
    parts = F.floor(F.col("rid") / 4096)
    sums = cut(n.groupBy(parts.alias("_p")).agg(F.sum(weight).alias("_s")))
    total = sums.agg(F.sum("_s")).first()[0] or 0.0
    starts, run = [], 0.0
    for r in sums.orderBy("_p").toLocalIterator():
        starts.append((r["_p"], run))
        run += r["_s"]
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _o double")
    from pyspark.sql import Window

    inside = Window.partitionBy("_p").orderBy("rid")
    laid = n.withColumn("_p", parts).join(offsets, "_p").withColumn("_end", F.col("_o") + F.sum(weight).over(inside))
    scale = F.lit(draws / total if total else 0.0)
    times = F.floor(F.col("_end") * scale + 1e-9) - F.floor((F.col("_end") - F.col(weight)) * scale + 1e-9)
    return laid.withColumn("times", times.cast("long")).drop("rid", "_p", "_o", "_end")
