"""Token ids in Parquet list columns.

Documents are range-sorted by id, one file for each range.  Ids lie in a list column with dictionary or delta
encoding; row groups and pages have given sizes, and Parquet's page indexes let a reader skip to some documents, or to
the small columns alone.  Where a file starts in the whole sequence follows from the files' token counts, which a
read of two small columns gives.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from ._common import batches_of, parts_for, ready

#: Rows of a batch, words and their letters that a worker of ``write`` keeps: it has no store of chunks beside them, and
#: what it forgets it has to merge again.
BATCH, KEPT_WORDS, KEPT_LETTERS = 1024, 600_000, 400_000
#: Writer settings for each encoding of ids.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"},
}


def write(docs: DataFrame, tokenizer: str, out: str, end_id: int = 1, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10) -> str:
    """Write doc_id, part, local_start, n_tokens and token_ids of every document to ``out``; returns ``out``.

    Every document ends with ``end_id``, so null and empty texts have one token.  Null ids come first; rows with the
    same id follow each other by text.  An empty table gives files without rows.  Other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    batches_of(spark, BATCH)
    bpe.checked(tokenizer)
    kind = dict(docs.dtypes)["doc_id"]
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = bpe.encoder(tokenizer, KEPT_WORDS, KEPT_LETTERS), 0
        for b in batches:
            got = [x + end for x in words.encode(bpe.texts_of(b.column(1)))]
            n = np.array([len(x) // 4 for x in got], dtype="int64")
            ends = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(got))]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(start + ends - n), pa.array(n), ids], ["doc_id", "part", "local_start", "n_tokens", "token_ids"])
            start += int(ends[-1]) if len(ends) else 0

    laid = docs.select("doc_id", "text").repartitionByRange(parts_for(docs, 64), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = laid.withColumn("part", F.spark_partition_id()).mapInArrow(run, f"doc_id {kind}, part int, local_start long, n_tokens long, token_ids array<int>")
    options = ENCODINGS[encoding] | {"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "compression": "zstd"}
    rows.write.options(**options).parquet(out)
    return out


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before; reads only the named columns."""
    rows = spark.read.parquet(path)
    totals = sorted(rows.groupBy("part").agg(F.sum("n_tokens")).collect())
    starts, total = [], 0
    for part, n in totals:
        starts.append((part, total))
        total += n
    first = spark.createDataFrame(starts, "part int, part_start long")
    rows = rows.join(F.broadcast(first), "part").withColumn("start", F.col("part_start") + F.col("local_start"))
    return rows.select(*(columns or ["doc_id", "start", "n_tokens", "token_ids"]))


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows of ``read``."""
    kind = dict(rows.dtypes)["doc_id"]
    batches_of(rows.sparkSession, 512)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            raw = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).view(np.uint8)
            cuts = (ids.offsets.to_numpy().astype("int64") * 4).tolist()
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "token_ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{ready(spark).sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
