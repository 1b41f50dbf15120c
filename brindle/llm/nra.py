"""Exact top-k by inner product with no random access.

Candidates lie in blocks of bounded size; in a block every dimension is a list, of which the two ends are known.  A query
reads list after list from start to end, those first that can change a score most (its component times the list's span).
What has been read gives each candidate a partial sum.  What has not been read adds at most the heads of the unread
lists, and at most the product of the two rests' lengths (the length of a vector is known, and what has been read of it),
and at least the negative of that product.  Candidates whose upper bound is below the k-th lower bound, or below the
k-th score of the blocks before, are outsiders and are not read on.  When few are left, or the lists are read through,
the scores of those that are left are resolved in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ready, tasks

#: Vectors in a block, queries in a block, lists read between two looks at the bounds.
BLOCK, QUERIES, LISTS = 2048, 8192, 8
EXACT = float(1 << 53)


@dataclass
class Reader:
    """The k best for each query over the blocks read so far, and how many list entries were there and were read."""

    queries: np.ndarray
    ids: np.ndarray
    k: int
    best: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    there: int = 0
    read: int = 0

    def __post_init__(self) -> None:
        self.best = [(np.zeros(0, "int64"), np.zeros(0, "int64")) for _ in self.ids]

    def block(self, vectors: np.ndarray, vid: np.ndarray) -> None:
        """Read the lists of one block (n vectors of d whole numbers) for every query."""
        n, d = vectors.shape
        bound = max(float(np.abs(self.queries).max(initial=0)), 1.0) * max(float(np.abs(vectors).max(initial=0)), 1.0) * max(d, 1)
        lists = np.ascontiguousarray(vectors.T.astype("float64"))
        squares = lists * lists
        length = squares.sum(axis=0)
        low, high = (lists.min(axis=1), lists.max(axis=1)) if n and d else (np.zeros(d), np.zeros(d))
        for i, q in enumerate(self.queries):
            self.there += n * d
            left = np.flatnonzero(vid != self.ids[i])
            if bound < EXACT:  # else sums of floats are not exact, and all are resolved
                left = self._left(q.astype("float64"), lists, squares, length, low, high, left, self.best[i][0])
            scores, ids = self.best[i]
            scores, ids = np.concatenate([scores, vectors[left] @ self.queries[i]]), np.concatenate([ids, vid[left]])
            order = np.lexsort((ids, -scores))[: self.k]
            self.best[i] = scores[order], ids[order]

    def _left(self, q: np.ndarray, lists: np.ndarray, squares: np.ndarray, length: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The candidates that can still be among the k best when reading stops."""
        floor = float(known[-1]) if len(known) == self.k else -np.inf
        order = np.argsort(-np.abs(q) * (high - low), kind="stable")
        heads = np.maximum(q * low, q * high)[order]
        unread = np.append(np.cumsum(heads[::-1])[::-1], 0.0)
        rest = np.append(np.cumsum((q[order] ** 2)[::-1])[::-1], 0.0)
        total, other = np.zeros(len(left)), length[left]
        for a in range(0, len(q), LISTS):
            if len(left) <= 4 * self.k:
                break
            now, b = order[a : a + LISTS], min(a + LISTS, len(q))
            whole = len(left) == lists.shape[1]
            self.read += len(now) * len(left)
            total = total + q[now] @ (lists[now] if whole else lists[now][:, left])
            other = other - (squares[now].sum(axis=0) if whole else squares[now][:, left].sum(axis=0))
            slack = np.sqrt(rest[b] * np.maximum(other, 0.0)) * (1 + 1e-9)
            lower = total - slack
            if len(left) > self.k:
                floor = max(floor, np.partition(lower, len(left) - self.k)[len(left) - self.k])
            keep = total + np.minimum(slack, unread[b]) >= floor - 1e-6 * max(1.0, abs(floor))
            left, total, other = left[keep], total[keep], other[keep]
        return left

    def rows(self) -> pd.DataFrame:
        n = [len(s) for s, _ in self.best]
        return pd.DataFrame({"query_id": np.repeat(self.ids, n), "vec_id": np.concatenate([i for _, i in self.best] or [np.zeros(0, "int64")]), "score": np.concatenate([s for s, _ in self.best] or [np.zeros(0, "int64")])})


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of (vec_id, v) with one dimension packed to about ``size`` vectors: dim, ids, data."""
    n = F.lit(max(1, int(np.ceil(rows.count() / size))))
    ready(rows.sparkSession)

    def pack(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        ids = f["vec_id"].to_numpy("int64")
        data = np.concatenate([np.asarray(x, dtype="int64") for x in f["v"]]) if len(f) else np.zeros(0, "int64")
        return pd.DataFrame({"dim": [key[0]], name: [key[1]], "ids": [ids.tobytes()], "data": [data.tobytes()]})

    keyed = rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), n).cast("int")).withColumn("dim", F.size("v"))
    return keyed.groupBy("dim", name).applyInPandas(pack, f"dim int, {name} int, ids binary, data binary")


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as a double; vectors that are null, or hold a null, NaN or infinite component, and null ids are left out."""
    whole = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = whole.where("forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    return fine.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v"))


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors for each row that ``is_query`` takes, ties to the smaller id.

    Vectors are compared with those of the same length (an empty one scores 0).  Candidates with the query's own id take
    no part; ids (whole numbers) that repeat count row by row.  An empty table, or no query, gives an empty result.

    A cell is a block of queries and a share of the candidate blocks, which a task reads one after another, the k best so
    far bounding the next block; so a cell returns k rows for each query.  Cells are as many as keep all tasks busy:
    where there are more query blocks than tasks, a query's candidates are all read by one task and nothing is merged.
    """
    spark = ready(vectors.sparkSession)
    rows = quantised(vectors, scale).checkpoint()
    cand, ask = blocks(rows, BLOCK, "b"), blocks(rows.where(is_query), QUERIES, "qb").checkpoint()
    q_blocks = ask.select("dim", "qb")
    n = max(1, q_blocks.count())
    share = F.lit(max(1, -(-tasks(spark) // n)))
    cells = q_blocks.withColumn("g", F.explode(F.sequence(F.lit(0), share - 1)))
    asked = cells.join(ask, ["dim", "qb"]).withColumn("b", F.lit(-1))
    given = cand.withColumn("g", F.pmod(F.col("b"), share)).join(q_blocks, "dim")
    both = asked.unionByName(given).repartition(max(tasks(spark), min(n, 100_000)), "dim", "qb", "g").sortWithinPartitions("dim", "qb", "g", "b")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader: Reader | None = None
        for f in frames:
            for r in f.itertuples(index=False):
                ids = np.frombuffer(r.ids, "int64")
                data = np.frombuffer(r.data, "int64").reshape(len(ids), r.dim)
                if r.b >= 0:
                    reader.block(data, ids)
                    continue
                if reader:
                    yield reader.rows()
                reader = Reader(data, ids, k)
        if reader:
            yield reader.rows()

    found = both.select("dim", "b", "ids", "data").mapInPandas(score, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("all"))
    return best.select("query_id", F.posexplode(F.slice("all", 1, k)).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).cast("long").alias("score"))
