"""A training corpus in five stages, each reading what the one before has kept.

In every stage ids may be null or repeat (rows are told apart by keys of their own), texts may be null, empty or very
long, other columns pass through whatever their names, and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import mix, neardup, pii, quality, queries, tokenbin
from brindle.llm._common import release, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts good.  Null and empty texts are judged like any text; equal texts alike."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (5-word shingles, Jaccard 0.8), that of the smallest id, null ids last.

    Of equal ids the smallest text hash stays; null and empty texts are copies of each other."""
    return neardup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data replaced by its kind and n_chars of the text as it is then; null texts stay null."""
    found = pii.redact(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in training order.  Texts without a word are not taken; equal rows are mixed
    as separate documents; a null source is a source of its own."""
    return mix.ordered(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; null and empty texts have no token."""
    return queries.bpe_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: SQL cannot express the first stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages; each but the last is written to the shared folder and read again.

    What a stage has staged for itself is deleted once its rows are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = tokenbin.shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
