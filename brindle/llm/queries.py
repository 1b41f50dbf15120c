"""The queries of this subpackage for the driver's contract, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, mix, nra, perplexity, pii, quality, simhash, suffix, tokenbin
from ._common import table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_kn_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judged(table(spark, sf_dir, "documents"))


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def bpe_digest(docs: DataFrame) -> DataFrame:
    """What op4 returns, for any documents."""
    rows = bpe.round_trip(docs, word_bpe())
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))


def op5_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op6_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.curriculum_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op7_bigru_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op8_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenbin.write(table(spark, sf_dir, "documents"), word_bpe(), tokenbin.shared_path(spark, "tokens"))
    return tokenbin.digest(tokenbin.read(spark, path))


def op9_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summarise(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_radix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix.deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows of 50 bytes as 100 hexadecimal digits; runs of removed bytes are islands of window starts at most 50 apart.
OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substring(h, 2 * p + 1, 100) AS c FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d WHERE len(h) >= 100)),
m AS (SELECT c, min(doc_id) AS least FROM w GROUP BY c HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS fresh FROM w JOIN m USING (c) WHERE doc_id > least),
i AS (SELECT doc_id, min(p) AS s, max(p) + 50 AS e FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g) GROUP BY doc_id, k),
k AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substring(h, 2 * a + 1, 2 * (s - a)), '' ORDER BY s) AS kept, max(e) AS last
  FROM (SELECT i.doc_id, s, e, h, coalesce(lag(e) OVER (PARTITION BY i.doc_id ORDER BY s), 0) AS a FROM i JOIN d USING (doc_id)) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE k.kept || substring(h, 2 * k.last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_knn_quality": op1_knn_quality,
        "op2_kn_perplexity": op2_kn_perplexity,
        "op3_simhash_bktree": op3_simhash_bktree,
        "op4_chunked_bpe": op4_chunked_bpe,
        "op5_nra_topk": op5_nra_topk,
        "op6_curriculum_mix": op6_curriculum_mix,
        "op7_bigru_langid": op7_bigru_langid,
        "op8_token_parquet": op8_token_parquet,
        "op9_weak_pii": op9_weak_pii,
        "op10_radix_suffix": op10_radix_suffix,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_nra_topk": OP5, "op10_radix_suffix": OP10}
