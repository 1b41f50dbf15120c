"""ARFF files: a typed header, then comma-separated or sparse rows; '?' is null.

The header is read from the file's first lines alone; rows are cut into cells by regular expressions in the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ATTRIBUTE = re.compile(r"@attribute\s+('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\S+)\s+(.*)", re.I)
#: A cell: quoted in either way with backslash escapes, or anything up to a comma.
CELL = r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,'"]*?)"""
DIRECTIVE = r"(?i)^@(relation|attribute|data|end)\b"


@dataclass
class Attribute:
    name: str
    kind: str
    labels: list[str] | None = None
    format: str = "yyyy-MM-dd'T'HH:mm:ss"

    @property
    def spark(self) -> str:
        return {"numeric": "double", "date": "timestamp"}.get(self.kind, "string")


def unquoted(text: str) -> str:
    if len(text) > 1 and text[0] in "'\"" and text[-1] == text[0]:
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    return text


def header(lines: list[str]) -> list[Attribute]:
    out: list[Attribute] = []
    for line in lines:
        if not (m := _ATTRIBUTE.match(line.strip())):
            continue
        name, kind = unquoted(m[1]), m[2].strip()
        if kind.startswith("{"):
            inner = kind[1 : kind.rindex("}")]
            out.append(Attribute(name, "nominal", [unquoted(c.strip()) for c in re.findall(r"\s*" + CELL + r"\s*(?:,|$)", inner)][: -1 if inner.strip() else None]))
            continue
        word, _, rest = kind.partition(" ")
        kind = {"numeric": "numeric", "real": "numeric", "integer": "numeric", "date": "date"}.get(word.lower(), "string")
        out.append(Attribute(name, kind, format=unquoted(rest.strip())) if kind == "date" and rest.strip() else Attribute(name, kind))
    return out


def _value(cell: Column, a: Attribute) -> Column:
    """A cell as its attribute's type: '?' without quotes is null, and so is what the type cannot hold."""
    inside = F.regexp_replace(F.substring(cell, F.lit(2), F.length(cell) - 2), r"\\(.)", "$1")
    text = F.when((F.length(cell) > 1) & cell.rlike(r"^(?:'(?s:.)*'|\"(?s:.)*\")$"), inside).otherwise(cell)
    text = F.when((cell == "?") | (cell == ""), F.lit(None)).otherwise(text)
    if a.kind == "numeric":
        return text.try_cast("double")
    return F.try_to_timestamp(text, F.lit(a.format)) if a.kind == "date" else text


def head_of(text: DataFrame) -> list[str]:
    """Lines up to '@data', taken in growing numbers from the start of the file."""
    n, most = 256, 1 << 20
    while True:
        lines = [r[0] for r in text.limit(n).collect()]
        at = next((i for i, x in enumerate(lines) if re.match(r"(?i)\s*@data\b", x)), None)
        if at is not None or len(lines) < n:
            return lines if at is None else lines[:at]
        if n >= most:
            raise ValueError("no @data among the first lines")
        n *= 8


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file, or of a folder that ``write`` made.  A sparse row holds 0, the first label or an empty text where
    it names no cell.  Rows that begin with '@' are data unless they are a directive."""
    try:
        attributes = header(head_of(spark.read.text(f"{path}/part=0")))
    except Exception as e:  # a single file has no such part
        if "PATH_NOT_FOUND" not in str(e):
            raise
        attributes = header(head_of(spark.read.text(path)))
    line = F.trim("value")
    data = spark.read.text(path).select(line.alias("value")).where((line != "") & ~line.startswith("%") & ~line.rlike(DIRECTIVE))
    dense = F.regexp_extract_all("value", F.lit(r"\s*" + CELL + r"\s*(?:,|$)"), F.lit(1))
    inner = F.regexp_extract("value", r"(?s)^\{(.*)\}\s*$", 1)
    pair = r"\s*(\d+)\s+" + CELL + r"\s*(?:,|$)"
    sparse = F.map_from_arrays(F.transform(F.regexp_extract_all(inner, F.lit(pair), F.lit(1)), lambda i: i.cast("int")), F.regexp_extract_all(inner, F.lit(pair), F.lit(2)))
    rows = data.select(F.col("value").startswith("{").alias("s"), F.when(~F.col("value").startswith("{"), dense).alias("d"), F.when(F.col("value").startswith("{"), sparse).alias("m"))
    out = []
    for i, a in enumerate(attributes):
        absent = F.lit(0.0) if a.kind == "numeric" else F.lit((a.labels or [""])[0]) if a.kind != "date" else F.to_timestamp(F.lit("1970-01-01"))
        named = F.map_contains_key("m", F.lit(i))
        cell = F.when(F.col("s"), F.try_element_at("m", F.lit(i))).otherwise(F.try_element_at("d", F.lit(i + 1)))
        out.append(F.when(F.col("s") & ~named, absent).otherwise(_value(cell, a)).cast(a.spark).alias(a.name))
    return rows.select(*out)


def write(df: DataFrame, path: str, relation: str = "data") -> None:
    """A header file and row files: text parts that sort after it."""
    types = {"string": "string", "timestamp": "date 'yyyy-MM-dd HH:mm:ss'", "date": "date 'yyyy-MM-dd'"}
    lines = [f"@relation '{relation}'", *[f"@attribute '{c}' {types.get(t, 'numeric')}" for c, t in df.dtypes], "@data"]
    escaped = [F.coalesce(F.concat(F.lit("'"), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")) if t in types else F.col(c).cast("string"), F.lit("?")) for c, t in df.dtypes]
    df.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{path}/part=0")
    df.select(F.concat_ws(",", *escaped).alias("value")).write.text(f"{path}/part=1")
