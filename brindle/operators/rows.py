"""Row filters, samples by hashed draws, joins by range and time, grouping sets and pivots.

Random choices are functions of a seed and a key, so that reruns, retried tasks and other engines make the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import fold_column, numbered


def uniform(key: Column, seed: int = 1) -> Column:
    """A number in [0, 1) for each key: 32 bits of an MD5 of the seed and the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def identity(df: DataFrame) -> DataFrame:
    return df


def nothing(df: DataFrame) -> DataFrame:
    """The columns without any row."""
    return df.where(F.lit(False))


def randomized(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows with their position ``rid`` in a shuffled order."""
    return numbered(df, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)


def resampled(df: DataFrame, *order: str, percent: float = 100.0, seed: int = 1) -> DataFrame:
    """Draws with replacement, ``draw`` from 0: each takes the row at a hashed position."""
    rows = numbered(df, *order)
    n = df.count()
    draws = df.sparkSession.range(int(n * percent / 100)).withColumnRenamed("id", "draw")
    return draws.withColumn("rid", F.floor(uniform(F.col("draw"), seed) * n)).join(rows, "rid").drop("rid")


def class_resampled(df: DataFrame, label: str, *order: str, bias: float = 0.0, percent: float = 100.0, seed: int = 1) -> DataFrame:
    """Draws with replacement; a share ``bias`` of them takes a class first, all alike, and then a row of it."""
    rows = numbered(df.where(F.col(label).isNotNull()), label, *order)
    spans = rows.groupBy(label).agg(F.min("rid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    classes = numbered(spans, label, name="_c").drop(label)
    total = classes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("k")).first()
    draws = df.sparkSession.range(int(total["n"] * percent / 100)).withColumnRenamed("id", "draw")
    u = lambda part: uniform(F.concat_ws("/", F.col("draw").cast("string"), F.lit(part)), seed)
    by_class = draws.where(u("b") < bias).withColumn("_c", F.floor(u("c") * total["k"])).join(classes, "_c")
    one = by_class.select("draw", (F.col("_first") + F.floor(u("r") * F.col("_n"))).alias("rid"))
    other = draws.where(u("b") >= bias).select("draw", F.floor(u("r") * total["n"]).alias("rid"))
    return one.unionByName(other).join(rows, "rid").drop("rid")


def remove_with_values(df: DataFrame, column: str, split: float | None = None, labels: Iterable[str] | None = None, invert: bool = False, match_missing: bool = False) -> DataFrame:
    """Drops rows below ``split``, or whose label is among ``labels``; ``invert`` keeps only them; a row without a value
    goes with those that match if ``match_missing``, else it stays."""
    c = F.col(column)
    hit = (c < F.lit(split)) if split is not None else c.isin(*(labels or []))
    hit = F.coalesce(hit, F.lit(match_missing))
    return df.where(hit if invert else ~hit)


def remove_range(df: DataFrame, expression: str, *order: str, invert: bool = False) -> DataFrame:
    """Drops rows by position, counted from one: '1-3,7,last'."""
    n = df.count()
    index = lambda t: 1 if t.strip().lower() == "first" else n if t.strip().lower() == "last" else int(t)
    hit = F.lit(False)
    for part in filter(None, (p.strip() for p in expression.split(","))):
        ends = part.split("-")
        hit = hit | (F.col("rid") + 1).between(index(ends[0]), index(ends[-1]))
    return numbered(df, *order).where(hit if invert else ~hit).drop("rid")


def remove_folds(df: DataFrame, folds: int, fold: int, *order: str | Column, invert: bool = False, label: str | None = None) -> DataFrame:
    """The rows of one fold (from 1), or with ``invert`` all others; with ``label`` folds are dealt class by class."""
    if label:
        dealt = numbered(df, label, *order).withColumn("_f", F.col("rid") % folds)
    else:
        dealt = numbered(df, *order).withColumn("_f", fold_column(F.col("rid"), df.count(), folds))
    here = F.col("_f") == fold - 1
    return dealt.where(~here if invert else here).drop("rid", "_f")


def train_test(df: DataFrame, key: str, percent: float, seed: int = 1) -> DataFrame:
    """Rows with ``part``: train for a share of keys by hash, test for the rest."""
    return df.withColumn("part", F.when(uniform(F.col(key), seed) < percent / 100, "train").otherwise("test"))


def concatenated(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of tables with equal headers, one after another."""
    for other in others:
        if not same_header(first, other):
            raise ValueError("headers differ: " + "; ".join(header_difference(first, other)))
        first = first.unionByName(other)
    return first


def header_difference(a: DataFrame, b: DataFrame) -> list[str]:
    """What differs between two headers, column by column."""
    out = [f"{i}: {x} / {y}" for i, (x, y) in enumerate(zip(a.dtypes, b.dtypes), 1) if x != y]
    return out + ([f"{len(a.columns)} / {len(b.columns)} columns"] if len(a.columns) != len(b.columns) else [])


def same_header(a: DataFrame, b: DataFrame) -> bool:
    return not header_difference(a, b)


def sorted_by_all(df: DataFrame) -> DataFrame:
    """Position ``rid`` in the order of all columns, missing values first."""
    return numbered(df, *[F.col(c).asc_nulls_first() for c in df.columns])


def ends_of(df: DataFrame, *order: str) -> DataFrame:
    """The first and the last row, with ``place``."""
    whole, key = F.struct(*df.columns), F.struct(*order)
    ends = df.agg(F.min_by(whole, key).alias("first"), F.max_by(whole, key).alias("last"))
    return ends.select(F.explode(F.array(*[F.struct(F.lit(p).alias("place"), F.col(p).alias("x")) for p in ("first", "last")])).alias("e")).select("e.place", "e.x.*")


def without_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.na.drop(subset=list(columns) or None)


def renamed_label(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def as_array(df: DataFrame, column: str, *order: str) -> DataFrame:
    """The column's values in order as one array: for columns that fit in a row."""
    cells = F.array_sort(F.collect_list(F.struct(*order, F.col(column).alias("_v"))))
    return df.agg(F.transform(cells, lambda x: x["_v"]).alias("values"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, kind, present, missing, distinct, least and largest (as text) of each column, in one pass."""
    kinds = dict(df.dtypes)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), F.count(c).alias("present"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("largest")) for c in columns]
    return df.agg(F.array(*cells).alias("all")).select(F.explode("all").alias("x")).select("x.*")


def to_sparse(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """key, cells: a map from column position (from 0) to value; zeros are left out, missing values are not."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    return df.select(key, F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNull() | (x["v"] != 0))).alias("cells"))


def to_dense(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """The columns again: what the map does not name is zero."""
    return df.select(key, *[F.when(F.map_contains_key("cells", F.lit(i)), F.try_element_at("cells", F.lit(i))).otherwise(F.lit(0.0)).alias(c) for i, c in enumerate(columns)])


def kept_by(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows with a partner; none is repeated."""
    return df.join(other, on, "left_semi")


def missing_from(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a partner, as when results that are there already are skipped."""
    return df.join(other, on, "left_anti")


def range_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points with every range [low, high) that they lie in: an equi-join on cells of ``width``, then the exact test.

    A range goes to each cell that it touches, a point to one, so no pair is met twice and no cross join is made.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    tiled = ranges.where(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("_cell", cell(at)).join(tiled, "_cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], time: str, value: str, out: str = "last") -> DataFrame:
    """``left`` with the value of the latest right row of the same key at or before its time (null if none).

    Both sides are laid one after another and a running last value is taken inside a key, so that a shuffle and a sort do
    what a join by inequality would do with pairs.
    """
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(dict(right.dtypes)[value])})
    b = right.select(*on, time, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(*on).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(out, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_side", "_v")


def cubed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts for every subset of the keys (null: not grouped by), the cache that network scores read."""
    return df.cube(*keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("grouping"))


def pivoted(df: DataFrame, row: str, column: str, labels: list[str]) -> DataFrame:
    """A column of counts for each of the stated labels."""
    return df.groupBy(row).pivot(column, labels).agg(F.count(F.lit(1))).na.fill(0)


def sort_aggregate(df: DataFrame, column: str) -> DataFrame:
    """distinct and unique values by a sorted scan: a value is new where it differs from the one before.

    Range partitions hold all rows of a value, so the scan needs no other partition.
    """
    w = Window.partitionBy("_p").orderBy(column)
    laid = df.where(F.col(column).isNotNull()).select(column).repartitionByRange(F.col(column)).withColumn("_p", F.spark_partition_id())
    new, last = F.coalesce(F.lag(column).over(w) != F.col(column), F.lit(True)), F.coalesce(F.lead(column).over(w) != F.col(column), F.lit(True))
    return laid.select(new.alias("new"), (new & last).alias("alone")).agg(F.count_if("new").alias("n_distinct"), F.count_if("alone").alias("n_unique"))


def remove_misclassified(df: DataFrame, label: str, key: str, learn: Callable[[DataFrame, DataFrame], DataFrame], folds: int = 0, rounds: int = 1, tolerance: float | None = None) -> DataFrame:
    """Rows that ``learn(train, test)`` (key, prediction) gets right: on their own training rows, or in folds; repeated up to
    ``rounds`` times while rows go.  A numeric label is right within ``tolerance``."""
    from .relational import cut, with_folds

    for _ in range(rounds):
        if folds:
            dealt = cut(with_folds(df, folds, key))
            parts = [learn(dealt.where(F.col("fold") != f).drop("fold"), dealt.where(F.col("fold") == f).drop("fold")) for f in range(folds)]
            got = parts[0]
            for p in parts[1:]:
                got = got.unionByName(p)
        else:
            got = learn(df, df)
        got = got.select(F.col(key).alias("_k"), F.col("prediction").alias("_p"))
        right = F.col("_p") == F.col(label) if tolerance is None else F.abs(F.col("_p") - F.col(label)) <= tolerance
        before = df.count()
        df = cut(df.join(got, F.col(key) == F.col("_k"), "left").where(F.coalesce(right, F.lit(False))).select(*df.columns))
        if df.count() == before:
            break
    return df
