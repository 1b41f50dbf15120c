"""Column transforms.  Statistics come from one aggregation and are frozen; the transform itself is narrow."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures
from .relational import numbered

FUNCTIONS = {"log": F.log, "abs": F.abs, "cos": F.cos, "exp": F.exp, "sqrt": F.sqrt, "floor": F.floor, "ceil": F.ceil, "rint": F.rint, "tan": F.tan, "sin": F.sin}


def expression(text: str, columns: list[str]) -> Column:
    """Infix arithmetic over a1, a2, ...; results that are not finite become null."""

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp):
            left, right = build(node.left), build(node.right)
            match node.op:
                case ast.Add():
                    return left + right
                case ast.Sub():
                    return left - right
                case ast.Mult():
                    return left * right
                case ast.Div():
                    return F.try_divide(left, right)
                case ast.Pow():
                    return F.pow(left, right)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -build(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id[:1] == "a" and node.id[1:].isdigit():
            return F.col(columns[int(node.id[1:]) - 1]).cast("double")
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and len(node.args) == 1:
            return FUNCTIONS[node.func.id](build(node.args[0])).cast("double")
        raise ValueError(f"not an arithmetic expression: {text}")

    value = build(ast.parse(text.replace("^", "**"), mode="eval").body)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def ranges_of(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("z", F.max))]).first()
    return {c: (row[f"a{i}"], row[f"z{i}"]) for i, c in enumerate(columns)}


def normalize(df: DataFrame, columns: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """Min-max to [0, 1]; a constant column becomes 0."""
    bounds = ranges_of(fitted if fitted is not None else df, columns)
    out = {}
    for c, (a, z) in bounds.items():
        scaled = (F.col(c) - F.lit(a)) / F.lit(z - a) if a is not None and z > a else F.lit(0.0)
        out[c] = F.when(F.col(c).isNotNull(), scaled)
    return df.withColumns(out)


def standardize(df: DataFrame, columns: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """Centre and divide by the sample deviation; a constant column is only centred."""
    row = (fitted if fitted is not None else df).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def normalize_rows(df: DataFrame, columns: list[str], norm: float = 1.0, power: float = 2.0) -> DataFrame:
    length = F.pow(sum((F.pow(F.abs(F.col(c)), F.lit(power)) for c in columns), F.lit(0.0)), F.lit(1 / power))
    return df.withColumns({c: F.when(length > 0, F.col(c) * norm / length).otherwise(F.col(c).cast("double")) for c in columns})


def replace_missing(df: DataFrame, numeric: list[str], nominal: list[str]) -> DataFrame:
    means = df.agg(*[measures.weighted_mean(c).alias(c) for c in numeric]).first()
    fill: dict = {c: float(means[c]) for c in numeric}
    for c in nominal:
        best = df.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.min_by(c, F.struct(-F.col("count"), F.col(c)))).first()[0]
        if best is not None:
            fill[c] = best
    return df.fillna(fill)


def equal_width(df: DataFrame, column: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins 0 to bins - 1; a value at a cut point goes left."""
    a, z = ranges_of(df, [column])[column]
    width = (z - a) / bins if a is not None and z > a else 0.0
    cuts = [a + width * i for i in range(1, bins)] if width else []
    return df.withColumn(out, binned(F.col(column), cuts))


def binned(x: Column, cuts: list[float]) -> Column:
    if not cuts:
        return F.when(x.isNotNull(), F.lit(0))
    n = F.lit(0)
    for c in cuts:
        n = n + (x > F.lit(c)).cast("int")
    return F.when(x.isNotNull(), n)


def frequency_cuts(df: DataFrame, column: str, bins: int) -> list[float]:
    """Exact equal-frequency cuts: midpoints between neighbouring distinct values at the quantile ranks."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).count()
    ranked = numbered(counts, "v")
    total = df.where(F.col(column).isNotNull()).count()
    wanted = sorted({max(1, math.ceil(total * i / bins)) for i in range(1, bins)})
    quantiles = df.where(F.col(column).isNotNull()).agg(F.percentile(column, [w / total for w in wanted] if total else [0.5])).first()[0]
    values = sorted({float(q) for q in quantiles or []})
    cuts: list[float] = []
    for v in values:
        low = ranked.where(F.col("v") <= v).agg(F.max("v")).first()[0]
        high = ranked.where(F.col("v") > v).agg(F.min("v")).first()[0]
        if low is not None and high is not None:
            cuts.append((low + high) / 2)
    return sorted(set(cuts))


def equal_frequency(df: DataFrame, column: str, bins: int, out: str = "bin") -> DataFrame:
    return df.withColumn(out, binned(F.col(column), frequency_cuts(df, column, bins)))


def proportional(df: DataFrame, column: str, out: str = "bin") -> DataFrame:
    """Equal frequency with as many bins as the root of the rows that have a value."""
    n = df.where(F.col(column).isNotNull()).count()
    return equal_frequency(df, column, max(1, math.isqrt(n)), out)


def numeric_to_binary(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), (F.col(c) != 0).cast("int")) for c in columns})


def nominal_to_binary(df: DataFrame, column: str, labels: list[str] | None = None) -> DataFrame:
    from .columns import labels_of

    labels = labels or labels_of(df, column)
    return df.withColumns({f"{column}={x}": F.when(F.col(column).isNotNull(), (F.col(column) == x).cast("int")) for x in labels}).drop(column)


def make_indicator(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    return df.withColumn(column, F.col(column).isin(labels).cast("double"))


def merge_two_values(df: DataFrame, column: str, first: str, second: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(first, second), F.lit(f"{first}_{second}")).otherwise(F.col(column)))


def swap_values(df: DataFrame, column: str, first: str, second: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == first, F.lit(second)).when(F.col(column) == second, F.lit(first)).otherwise(F.col(column)))


def first_order(df: DataFrame, columns: list[str]) -> DataFrame:
    diffs = {f"{b}-{a}": F.col(b) - F.col(a) for a, b in zip(columns, columns[1:])}
    return df.select(*[c for c in df.columns if c not in columns], *[e.alias(n) for n, e in diffs.items()])


def shifted(df: DataFrame, columns: list[str], by: int, series: list[str], order: list[str], delta: bool = False) -> DataFrame:
    """Values from ``by`` rows away inside a series (before, if negative); ``delta``: the difference to them."""
    w = Window.partitionBy(*series).orderBy(*order)
    return df.withColumns({c: (F.col(c) - F.lag(c, -by).over(w)) if delta else F.lag(c, -by).over(w) for c in columns})


def class_order(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Codes of labels by frequency (ties by label)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count()
    order = [F.col("count").asc() if ascending else F.col("count").desc(), F.col(column)]
    codes = numbered(counts, *order, name="code").select(F.col(column).alias("_v"), "code")
    return df.join(codes, F.col(column) == F.col("_v"), "left").drop("_v")


def remove_useless(df: DataFrame, columns: list[str], most_varied: float = 99.0) -> DataFrame:
    """Drops constant columns, and text columns with too many labels for their rows."""
    kinds = dict(df.dtypes)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    useless = [c for i, c in enumerate(columns) if row[f"d{i}"] <= 1 or (kinds[c] == "string" and row["n"] and 100 * row[f"d{i}"] / row["n"] > most_varied)]
    return df.drop(*useless)


def word_vector(df: DataFrame, key: str, text: str, keep: int, tf: bool = False, idf: bool = False) -> DataFrame:
    """key, word, weight for the ``keep`` words in most rows (ties by word); null texts have none."""
    words = df.select(key, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''")
    counts = words.groupBy(key, "word").count()
    frequency = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "word").limit(keep)
    rows = df.count()
    weight = F.log(1 + F.col("count")) if tf else F.col("count").cast("double")
    if idf:
        weight = weight * F.log(F.lit(float(rows)) / F.col("df"))
    return counts.join(F.broadcast(frequency), "word").select(key, "word", F.round(weight, 6).alias("weight"))


def random_projection(df: DataFrame, columns: list[str], dimensions: int, seed: int = 42) -> DataFrame:
    """Sums of columns with entries of sqrt(3) times -1, 0 or 1, chosen with odds 1:4:1."""
    import random

    rng = random.Random(seed)
    out = {}
    for k in range(dimensions):
        entries = [(c, rng.choice((1, 0, 0, 0, 0, -1))) for c in columns]
        out[f"k{k + 1}"] = sum((F.col(c) * (s * math.sqrt(3)) for c, s in entries if s), F.lit(0.0))
    return df.withColumns(out)
