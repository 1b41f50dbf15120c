"""More column transforms: by type, by named function, frozen labels, noise, ordered indicators, cluster membership."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import numbered
from .rows import uniform
from .transforms import ranges_of

#: Functions of one number by name.
NAMED = {"abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "cbrt": F.cbrt, "ceil": F.ceil, "cos": F.cos, "cosh": F.cosh, "exp": F.exp, "expm1": F.expm1, "floor": F.floor, "log": F.log, "log10": F.log10, "log1p": F.log1p, "rint": F.rint, "signum": F.signum, "sin": F.sin, "sinh": F.sinh, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh, "toDegrees": F.degrees, "toRadians": F.radians}
KINDS = {"numeric": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"), "string": ("string",), "date": ("date", "timestamp", "timestamp_ntz"), "nominal": ("boolean",)}


def of_kind(df: DataFrame, kind: str) -> list[str]:
    """Columns that are numeric, string, date or nominal (boolean)."""
    return [c for c, t in df.dtypes if t.split("(")[0] in KINDS[kind]]


def remove_type(df: DataFrame, kind: str, invert: bool = False) -> DataFrame:
    named = of_kind(df, kind)
    return df.select(*[c for c in df.columns if (c in named) == invert])


def numeric_transform(df: DataFrame, columns: list[str], function: str = "abs") -> DataFrame:
    """Results that are no number or not finite become null."""
    if function not in NAMED:
        raise ValueError(f"no function {function} among {', '.join(NAMED)}")

    def applied(c: str) -> Column:
        y = NAMED[function](F.col(c).cast("double")).cast("double")
        return F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y)

    return df.withColumns({c: applied(c) for c in columns})


def labels_of(df: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """The distinct labels in order; more than ``most`` are an error, as they would be columns or branches of a plan."""
    found = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} labels")
    return found


def string_to_nominal(df: DataFrame, column: str, fitted: DataFrame | None = None) -> DataFrame:
    """The column with labels frozen from ``fitted``: later strings that it does not have become null."""
    first = fitted if fitted is not None else df
    known = first.where(F.col(column).isNotNull()).select(F.col(column).alias("_l")).distinct()
    return df.join(known, F.col(column) == F.col("_l"), "left").withColumn(column, F.col("_l")).drop("_l")


def add_noise(df: DataFrame, column: str, key: str, percent: float = 10.0, seed: int = 1) -> DataFrame:
    """A share of the rows, by a hash of the key, gets another label than its own: the one that many places on."""
    labels = labels_of(df, column)
    if len(labels) < 2:
        return df
    names = F.array(*[F.lit(x) for x in labels])
    step = 1 + F.floor(uniform(F.concat(F.col(key).cast("string"), F.lit("/label")), seed) * (len(labels) - 1))
    other = names[F.pmod(F.array_position(names, F.col(column)) - 1 + step, F.lit(len(labels))).cast("int")]
    return df.withColumn(column, F.when(F.col(column).isNotNull() & (uniform(F.col(key), seed) < percent / 100), other).otherwise(F.col(column)))


def ordered_indicators(df: DataFrame, column: str, target: str) -> DataFrame:
    """For k labels ordered by their mean target, k - 1 columns: whether the label comes after the first i of them."""
    means = df.where(F.col(column).isNotNull() & F.col(target).isNotNull()).groupBy(column).agg(F.avg(target).alias("m"))
    ordered = [r[column] for r in means.orderBy("m", column).collect()]
    made = {f"{column}={','.join(ordered[i:])}": F.when(F.col(column).isNotNull(), F.col(column).isin(ordered[i:]).cast("double")) for i in range(1, len(ordered))}
    return df.withColumns(made).drop(column)


def cluster_membership(df: DataFrame, columns: list[str], centres: list[tuple[tuple[float, ...], tuple[float, ...], float]]) -> DataFrame:
    """Columns p0, p1, ... instead: the posterior of each (means, deviations, prior) under independent normal columns."""
    def log_density(means: tuple[float, ...], deviations: tuple[float, ...], prior: float) -> Column:
        out = F.lit(math.log(max(prior, 1e-300)))
        for c, m, s in zip(columns, means, deviations):
            s = max(s, 1e-6)
            z = (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s))
            out = out + F.when(F.col(c).isNotNull(), -z * z / 2 - F.lit(math.log(s * math.sqrt(2 * math.pi)))).otherwise(F.lit(0.0))
        return out

    logs = F.array(*[log_density(*c) for c in centres])
    with_l = df.withColumn("_l", logs).withColumn("_m", F.array_max("_l"))
    total = F.aggregate("_l", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_m")))
    return with_l.withColumn("_t", total).withColumns({f"p{i}": F.exp(F.col("_l")[i] - F.col("_m")) / F.col("_t") for i in range(len(centres))}).drop("_l", "_m", "_t", *columns)


def date_through_format(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """The date as text of a pattern read back, so that what the pattern does not hold is lost."""
    return df.withColumn(column, F.to_timestamp(F.date_format(column, pattern), pattern))


def obfuscated(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Columns named A1, A2, ... with their labels as V1, V2, ... in label order; other columns stay."""
    names = {c: f"A{i}" for i, c in enumerate(columns, 1)}
    for c in columns:
        if dict(df.dtypes)[c] == "string":
            codes = numbered(df.where(F.col(c).isNotNull()).select(F.col(c).alias("_v")).distinct(), "_v", name="_i")
            df = df.join(codes, F.col(c) == F.col("_v"), "left").withColumn(c, F.concat(F.lit("V"), (F.col("_i") + 1).cast("string"))).drop("_v", "_i")
    return df.withColumnsRenamed(names), names


def best_width_bins(df: DataFrame, column: str, most: int = 10) -> int:
    """How many equal-width bins, up to ``most``, leave the least leave-one-out entropy; one pass over the rows."""
    a, z = ranges_of(df, [column])[column]
    if a is None or z <= a:
        return 1
    rows = df.where(F.col(column).isNotNull())
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.least(F.greatest(F.ceil((F.col(column) - a) / ((z - a) / k)) - 1, F.lit(0)), F.lit(k - 1)).alias("bin")) for k in range(1, most + 1)])
    counts = rows.select(F.explode(cells).alias("x")).groupBy("x.k", "x.bin").count()
    n, k = F.col("count"), F.col("k")
    score = counts.groupBy("k").agg((-F.sum(n * F.when(n > 1, F.log((n - 1) * k / F.lit(z - a))).otherwise(F.lit(-1e300)))).alias("e"))
    return score.agg(F.min_by("k", F.struct(F.round("e", 9), "k"))).first()[0]


def word_weights(df: DataFrame, key: str, text: str, keep: int, label: str | None = None, tf: bool = False, idf: bool = False, stop: list[str] | None = None, average_length: bool = False, binary: bool = False) -> DataFrame:
    """key, word, weight for the ``keep`` commonest words (of each class, if a label is given), ties by word.

    Null texts have none.  With ``average_length`` a row's weights are scaled to the mean length of all rows.
    """
    words = df.select(key, *([label] if label else []), F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")).alias("word"))
    if stop:
        words = words.where(~F.col("word").isin(stop))
    counts = words.groupBy(key, *([label] if label else []), "word").count()
    per = [label] if label else []
    ranked = numbered(counts.groupBy(*per, "word").agg(F.sum("count").alias("n")), *[F.col(c) for c in per], F.col("n").desc(), F.col("word"))
    first = ranked.groupBy(*per).agg(F.min("rid").alias("_first")) if per else ranked.agg(F.min("rid").alias("_first"))
    kept = (ranked.join(F.broadcast(first), per) if per else ranked.join(F.broadcast(first))).where(F.col("rid") - F.col("_first") < keep).select("word").distinct()
    weight = F.lit(1.0) if binary else F.col("count").cast("double")
    weight = F.log(1 + weight) if tf else weight
    out = counts.join(kept, "word")
    if idf:
        frequency = counts.groupBy("word").agg(F.count_distinct(key).alias("_df"))
        rows = df.agg(F.count(F.lit(1)).alias("_rows"))
        out = out.join(frequency, "word").join(F.broadcast(rows))
        weight = weight * F.log(F.col("_rows") / F.col("_df"))
    out = out.select(key, "word", weight.alias("weight"))
    if average_length:
        lengths = out.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_len"))
        mean = lengths.agg(F.avg("_len").alias("_avg"))
        out = out.join(lengths, key).join(F.broadcast(mean)).select(key, "word", F.when(F.col("_len") > 0, F.col("weight") * F.col("_avg") / F.col("_len")).otherwise(F.lit(0.0)).alias("weight"))
    return out
