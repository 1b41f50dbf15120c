"""Delimited files with a header, C4.5 pairs, JDBC and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """'?' and empty cells are null; a column is numeric if every other cell is a number."""
    raw = spark.read.option("header", True).option("sep", separator).option("nullValue", "?").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.select(*[F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in raw.columns])
    bad = raw.agg(*[F.count(F.when(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` AS double)").isNull(), 1)).alias(f"b{i}") for i, c in enumerate(raw.columns)]).first()
    return raw.select(*[(F.col(f"`{c}`").cast("double") if bad[i] == 0 else F.col(f"`{c}`")).alias(c) for i, c in enumerate(raw.columns)])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("nullValue", "?").csv(path)


def read_c45(spark: SparkSession, names: str, data: str) -> DataFrame:
    """A .names file gives classes, then one 'attribute: kind' a line; the class is the last column of .data."""
    text = " ".join(r[0].split("|")[0] for r in spark.read.text(names).collect())
    parts = [p.strip() for p in text.replace("..", ".").split(".") if p.strip()]
    attributes = [p.split(":", 1) for p in parts if ":" in p]
    columns = [(a.strip(), k.strip()) for a, k in attributes]
    schema = ", ".join(f"`{a}` string" for a, _ in columns) + ", `class` string"
    raw = spark.read.option("nullValue", "?").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).schema(schema).csv(data)
    kept = [(F.col(f"`{a}`").cast("double") if k == "continuous" else F.col(f"`{a}`")).alias(a) for a, k in columns if k != "ignore"]
    return raw.select(*kept, F.regexp_replace("class", r"\.$", "").alias("class"))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.options(**options).jdbc(url, table)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.options(**options).jdbc(url, table, mode=mode)


def write_c45(df: DataFrame, names: str, data: str, label: str, most_labels: int = 1000) -> None:
    """A .names folder with the classes and one 'attribute: kind.' a line, and a .data folder of rows, the class last."""
    from ..operators.columns import labels_of
    from ..operators.models import numeric

    others = [c for c in df.columns if c != label]
    say = lambda c: "continuous" if numeric(df, c) else ", ".join(labels_of(df, c, most_labels))
    lines = [", ".join(labels_of(df.select(F.col(label).cast("string").alias(label)), label, most_labels)) + ".", *[f"{c}: {say(c)}." for c in others]]
    df.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(names)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("?")) for c in [*others, label]]
    df.select(F.concat(F.concat_ws(",", *cells), F.lit(".")).alias("value")).write.text(data)


def write_serialized(df: DataFrame, path: str, relation: str = "data", label: str | None = None) -> None:
    """A whole dataset as Parquet, with its relation name and class column in the schema's metadata."""
    first = df.columns[0]
    meta = {"relation": relation, "label": label or ""}
    df.withColumn(first, F.col(first).alias(first, metadata=meta)).write.parquet(path)


def read_serialized(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def serialized_info(df: DataFrame) -> tuple[str, str | None]:
    """The relation name and class column that were written with a dataset."""
    meta = df.schema[0].metadata
    return meta.get("relation", "data"), meta.get("label") or None


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], sparse: bool = False) -> DataFrame:
    """The result of an SQL text over named tables, numbers as doubles; ``sparse`` drops columns that are all zero."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(sql)
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "decimal")
    out = out.select(*[(F.col(f"`{c}`").cast("double") if t.split("(")[0] in kinds else F.col(f"`{c}`")).alias(c) for c, t in out.dtypes])
    if sparse:
        numbers = [c for c, t in out.dtypes if t == "double"]
        some = out.agg(*[F.max(F.coalesce(F.abs(F.col(f"`{c}`")), F.lit(1.0))).alias(f"m{i}") for i, c in enumerate(numbers)]).first()
        out = out.drop(*[c for i, c in enumerate(numbers) if some[f"m{i}"] == 0])
    return out
