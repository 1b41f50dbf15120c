"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words (hashed, one plus the logarithm of their counts), runs of four character classes, how much
of it repeats, and its length.  Term weights times inverse document frequency of a bounded sample of labelled texts are
factored by a randomised singular value decomposition; the sample's vectors and labels are broadcast (their size is
bounded by ``SAMPLE`` x ``RANK``), and every document's exact cosines with all of them are computed block by block.  The
nearest neighbours vote, each with its cosine as weight.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches_of, held_out, ready
from .bpe import texts_of

#: Labelled rows that are used at most, latent dimensions, neighbours.
SAMPLE, RANK, NEIGHBOURS = 4096, 64, 15
#: Terms: hashed runs of classes, repeats and length, hashed words.
RUNS, EXTRA, WORDS = 2048, 48, 2048
TERMS = RUNS + EXTRA + WORDS
#: Classes of bytes: letters (and what is beyond ASCII), capitals, digits, white space, line ends, marks.
CLASS = np.full(256, 0, dtype=np.uint16)
CLASS[65:91], CLASS[48:58], CLASS[[9, 11, 12, 13, 32]], CLASS[10] = 1, 2, 3, 4
CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
CLASS[[ord(c) for c in "!"]] = 6
CLASS[[ord(c) for c in "#*$%&<>@^~=+_\\/[]{}`"]] = 7
CLASS[ord("|")] = 8
CLASS[[x for x in range(9)]], CLASS[[x for x in range(14, 32)]], CLASS[127] = 9, 9, 9
CLASSES = 10
_SLOT = (np.arange(CLASSES**4, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 11)).astype(np.int64)


def terms(text: bytes) -> np.ndarray:
    """Weights of a text's terms before document frequencies: RUNS hashed runs, EXTRA others, WORDS hashed words."""
    out = np.zeros(TERMS, dtype=np.float32)
    runs = np.zeros(CLASSES**4, dtype=np.int64)
    for a in range(0, len(text), 1 << 20):
        c = CLASS[np.frombuffer(text, np.uint8, min(len(text) - a, (1 << 20) + 3), a)]
        if len(c) >= 4:
            runs += np.bincount(((c[:-3] * CLASSES + c[1:-2]) * CLASSES + c[2:-1]) * CLASSES + c[3:], minlength=CLASSES**4)
    if total := runs.sum():
        out[:RUNS] = np.sqrt(np.bincount(_SLOT, weights=runs, minlength=RUNS) / total)
    words = text.split()
    n = len(words)
    if n:
        again = sum(map(eq, words, words[1:])) / n
        fresh = len(set(words)) / n
        out[RUNS + min(15, int(16 * again))] = 0.5 * np.sqrt(again) if again else 0.0
        out[RUNS + 16] = np.sqrt(again)
        out[RUNS + 17] = np.sqrt(1 - fresh)
        count = Counter(text.lower().split())
        slot = np.fromiter(map(crc32, count), "int64", len(count)) % WORDS
        own = np.bincount(slot, weights=1 + np.log(np.fromiter(count.values(), "float64", len(count))), minlength=WORDS)
        out[RUNS + EXTRA :] = own / np.linalg.norm(own)
    out[RUNS + 24 + min(23, int(2 * np.log2(n + 1)))] = 0.15
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, rows: np.ndarray) -> np.ndarray:
        z = (rows * self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each weighted by its cosine (none below 0)."""
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        cosine = self.latent(rows) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1).astype("float64"), 0) + 1e-9
        return np.clip((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1), 0.0, 1.0)


#: What a model consists of.
PARTS = {"idf": "float32", "basis": "float32", "vectors": "float32", "labels": "float64"}


def fit(rows: np.ndarray, labels: np.ndarray, rank: int = RANK, rounds: int = 4) -> Model:
    """Factor the labelled rows by a subspace that power iterations sharpen; signs and ties do not matter to cosines."""
    n, d = rows.shape
    idf = (np.log((n + 1) / ((rows > 0).sum(axis=0) + 1)) + 1).astype(np.float32)
    rank = min(rank, d)
    if not n:
        return Model(idf, np.zeros((d, rank), np.float32), np.zeros((0, rank), np.float32), labels.astype("float64"))
    a = rows.astype(np.float32)
    a *= idf
    z = a @ np.random.default_rng(0).normal(size=(d, min(rank + 16, d))).astype(np.float32)
    for _ in range(rounds):
        z = a @ (a.T @ np.linalg.qr(z)[0])
    basis = np.linalg.svd(np.linalg.qr(z)[0].T @ a, full_matrices=False)[2][:rank].T.astype(np.float32)
    vectors = a @ basis
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Model(idf, basis, vectors, labels.astype("float64"))


def learned(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """The model of at most ``bound`` labelled rows that are not held out, chosen by a hash of the id.

    One task gathers the terms and fits; only the model (2 MB at ``SAMPLE`` rows) comes to the driver."""
    spark = ready(docs.sparkSession)
    batches_of(spark, 512)
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    known = known.checkpoint()
    chosen = known.orderBy(F.xxhash64(F.col("doc_id"), F.lit(7)), "doc_id").limit(bound)  # ids are distinct: reruns agree
    texts = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), F.col("_id") == F.col("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([terms(t).astype("float16").tobytes() for t in texts_of(b.column(2))], pa.binary())], ["doc_id", "quality", "terms"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks = np.zeros((bound, TERMS), "float16"), []
        for b in batches:
            for mark, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows[len(marks)] = np.frombuffer(own, "float16")
                marks.append(mark)
        model = fit(rows[: len(marks)], np.array(marks, dtype="float64"))
        parts = [getattr(model, c).tobytes() for c in PARTS]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], list(PARTS))

    kind = dict(docs.dtypes)["doc_id"]
    # Ids may repeat in the documents, without a bound: the bound holds for rows too, in an order that reruns share.
    got = texts.select("doc_id", "quality", "text").mapInArrow(run, f"doc_id {kind}, quality int, terms binary").orderBy("doc_id", "terms").limit(bound)
    made = got.select("quality", "terms").coalesce(1).mapInArrow(fitted, ", ".join(f"{c} binary" for c in PARTS)).collect()
    if not made:  # a table that is known to be empty has no task
        return fit(np.zeros((0, TERMS), "float16"), np.zeros(0))
    parts = {c: np.frombuffer(made[0][c], kind) for c, kind in PARTS.items()}
    basis = parts["basis"].reshape(TERMS, -1)
    return Model(parts["idf"], basis, parts["vectors"].reshape(-1, basis.shape[1]), parts["labels"])


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; score is that label 1 is likelier, from 0 to 1.

    Null and empty texts are scored by their length term alone.  Ids may be null (never held out) or repeat; a label
    may be null or repeat (the mean decides).  Without a label every score is 0.5.  An empty table gives an empty table.
    Source, language and other columns are not read.
    """
    spark = ready(docs.sparkSession)
    model = spark.sparkContext.broadcast(learned(docs, labels))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([terms(t) for t in texts_of(b.column(1))], dtype=np.float32).reshape(b.num_rows, TERMS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.value.score(rows))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that are predicted good, in one pass over the texts."""
    spark = ready(docs.sparkSession)
    model = spark.sparkContext.broadcast(learned(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([terms(t) for t in texts_of(b.column(at))], dtype=np.float32).reshape(b.num_rows, TERMS)
            yield b.filter(pa.array(model.value.score(rows) >= threshold))

    return docs.mapInArrow(run, docs.schema)
