"""Mixing sources to target weights along a time-varying curriculum.

Each source has a base weight and a schedule over training time u in [0, 1].  Targets share all words by weight, no
target above ``cap`` times its source's size (the excess is shared again by weight).  The integral of a source's
schedule says how much of its target is due by time u; inverting that cumulative demand turns a word offset inside
the source into a training position.  Documents are then range-sorted by position.

Offsets are running sums over documents in a hashed order.  They are taken over range partitions (any source may span
many of them), so that a source with a third of all rows is never in one task; the driver sees one row per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free, n_words, parts_for, ready, staged

Schedule = tuple[list[float], list[float]]


def default_schedule(weight: int) -> Schedule:
    """Knots and heights of a piecewise linear schedule: light sources come early, heavy ones late."""
    slope = (weight - 2) * 0.5
    return [0.0, 1.0], [1.0 - slope, 1.0 + slope]


def cyclic_weight(index: int) -> int:
    return 1 + index % 3


def cumulative(schedule: Schedule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Knots, heights and the integral up to each knot, with a total of 1."""
    u, w = np.asarray(schedule[0], float), np.asarray(schedule[1], float)
    if len(u) < 2 or (np.diff(u) <= 0).any() or (w < 0).any() or u[0] != 0 or u[-1] != 1:
        raise ValueError("a schedule needs rising knots from 0 to 1 and no negative height")
    area = np.concatenate([[0.0], np.cumsum(np.diff(u) * (w[1:] + w[:-1]) / 2)])
    if area[-1] <= 0:
        raise ValueError("a schedule needs a positive integral")
    return u, w / area[-1], area / area[-1]


def invert(schedule: Schedule, share: np.ndarray) -> np.ndarray:
    """The time at which a share of the source's demand is reached."""
    u, w, area = cumulative(schedule)
    share = np.clip(np.asarray(share, float), 0.0, 1.0)
    k = np.clip(np.searchsorted(area, share, side="right") - 1, 0, len(u) - 2)
    rest, h = share - area[k], u[k + 1] - u[k]
    slope = (w[k + 1] - w[k]) / h
    root = np.sqrt(np.maximum(w[k] ** 2 + 2 * slope * rest, 0.0))
    t = np.divide(2 * rest, w[k] + root, out=np.zeros_like(rest), where=w[k] + root > 0)
    return u[k] + np.clip(t, 0.0, h)


def row_index(df: DataFrame, order: list, name: str = "ix") -> DataFrame:
    """A global row number in the given order, from counts of range partitions."""
    kept = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    kept = kept.withColumn("_pid", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted((r["_pid"], r["n"]) for r in kept.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = {}, 0
    for pid, n in counts:
        starts[pid], total = total, total + n
    first = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]) if starts else None
    ix = (first[F.col("_pid")] if starts else F.lit(0)) + F.col("_row")
    return kept.withColumn(name, ix.cast("long")).drop("_at", "_pid", "_row")


def source_targets(sizes: DataFrame, weight_of: Callable[[int], int] = cyclic_weight, period: int = 3, cap: float = 3.0) -> DataFrame:
    """From (source, size) per document: source, rank, weight, source_size, target.

    Ranks follow code points, null last.  Targets are min(cap * size, level * weight); the level rises until no new
    source is capped, a fixed point that is reached after at most one step per capped source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = row_index(per, [F.col("source").isNull(), F.col("source")], "rank")
    weights = F.array(*[F.lit(float(weight_of(i))) for i in range(period)])
    ranked = ranked.withColumn("weight", weights[(F.col("rank") % period).cast("int")])
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    level, capped = 0.0, -1
    most = F.lit(cap) * F.col("source_size")
    while True:
        is_capped = F.lit(capped >= 0) & (most <= F.lit(level) * F.col("weight"))
        r = ranked.agg(F.sum(F.when(is_capped, most)).alias("full"), F.sum(F.when(~is_capped, F.col("weight"))).alias("w"), F.sum(is_capped.cast("long")).alias("n")).first()
        if (r["n"] or 0) <= capped or not r["w"]:
            break
        level, capped = (total - (r["full"] or 0.0)) / r["w"], r["n"] or 0
    return ranked.withColumn("target", F.least(most, F.lit(float(level)) * F.col("weight")))


def curriculum_mix(docs: DataFrame, schedule_of: Callable[[int], Schedule] = default_schedule, weight_of: Callable[[int], int] = cyclic_weight, period: int = 3, cap: float = 3.0, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, positions, position; sorted by position.

    ``size`` counts words (null or empty text: 0), ``taken`` is a whole number of passes over the document times its
    size, ``positions`` holds one training time in [0, 1] per pass and ``position`` the first of them.  Every source
    takes its whole passes for each document, and one pass more for the documents whose middle lies below what is then
    left of the target, in an order fixed by a hash of the id; so the words taken miss the target by half a document at
    most, and reruns agree.  Rows that take nothing (empty texts, sources below one pass) have no position and come
    first.  A null source is a source of its own, last in order; null ids are allowed; equal rows are mixed as separate
    documents; an empty table gives an empty table.  Other columns are ignored, but ``row`` is kept: a key of whole rows (long).
    """
    ready(docs.sparkSession)
    key = [row] if row else []
    base = docs.select("doc_id", "source", n_words().alias("size"), *key).checkpoint()
    sources = source_targets(base, weight_of, period, cap)
    joined = base.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    order = ["rank", "_h", "doc_id", "size", *key]
    laid = joined.withColumn("_h", F.xxhash64(F.col("doc_id"))).repartitionByRange(parts_for(base, 16), *order).sortWithinPartitions(*order)
    laid = laid.withColumn("_pid", F.spark_partition_id()).checkpoint()
    sums = laid.groupBy("_pid", "rank").agg(F.sum("size").alias("n")).groupBy("_pid").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.max_by("n", "rank").alias("n"))
    before, rank, run = {}, None, 0
    for r in sorted(sums.collect(), key=lambda r: r["_pid"]):
        before[r["_pid"]] = run if r["first"] == rank else 0
        run = r["n"] + (run if r["first"] == rank and r["last"] == rank else 0)
        rank = r["last"]
    schedules = {i: schedule_of(int(weight_of(i))) for i in range(period)}

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank, run = None, 0
        for f in frames:
            if not len(f):
                continue
            if rank is None:
                rank, run = f["rank"].iloc[0], before[int(f["_pid"].iloc[0])]
            ranks, size = f["rank"].to_numpy(), f["size"].to_numpy()
            total = np.cumsum(size)
            fresh = np.flatnonzero(np.concatenate([[ranks[0] != rank], ranks[1:] != ranks[:-1]]))
            offset = np.full(len(f), run, dtype="int64")
            for k in fresh:
                offset[k:] = -(total[k] - size[k])
            start = total - size + offset
            rank, run = ranks[-1], int(start[-1] + size[-1])
            target, whole = f["target"].to_numpy(), np.maximum(f["source_size"].to_numpy(), 1)
            passes = np.minimum(np.floor(target / whole + 1e-9), np.floor(cap)).astype("int64")
            rest = target - passes * whole
            middle = start + size / 2
            more = (middle <= rest) & (size > 0) & (passes < int(cap))
            n = np.where(size > 0, passes + more, 0)
            ends = np.cumsum(n)
            times = np.empty(int(n.sum()))
            for kind, schedule in schedules.items():
                k = np.flatnonzero((n > 0) & (ranks % period == kind))
                turn = np.arange(n[k].sum()) - np.repeat(np.cumsum(n[k]) - n[k], n[k])
                k, slot = np.repeat(k, n[k]), np.repeat((ends - n)[k], n[k]) + turn
                times[slot] = invert(schedule, (turn * whole[k] + middle[k]) / np.maximum(target[k], 1e-9))
            out = f[["doc_id", "source", "size", "source_size", "target", *key]].copy()
            out["taken"] = size * n
            out["positions"] = pd.Series(pd.arrays.ArrowExtensionArray(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype("int32"), times)), index=f.index)
            out["position"] = np.where(n > 0, times[np.minimum(ends - n, max(len(times) - 1, 0))] if len(times) else 0.0, np.nan)
            yield out

    kinds = dict(docs.select("doc_id", "source").dtypes)
    placed = laid.mapInPandas(place, f"doc_id {kinds['doc_id']}, source {kinds['source']}, size long, source_size long, target double{f', {row} long' if row else ''}, taken long, positions array<double>, position double")
    placed = placed.withColumn("position", F.when(F.size("positions") > 0, F.col("position")))
    return placed.repartitionByRange(parts_for(base, 16), "position", "doc_id").sortWithinPartitions("position", "doc_id")


def training_order(docs: DataFrame, mixed: DataFrame, row: str = "doc_id") -> DataFrame:
    """The documents that the mix takes, once per pass, range-sorted by training position.

    ``row`` is the key by which both tables know a row; ids will do where none is null or repeated.
    """
    at = free(docs, "_at")
    turns = mixed.where("taken > 0").select(row, F.explode("positions").alias(at))
    return docs.join(turns, row).repartitionByRange(parts_for(docs, 64), at, "doc_id").sortWithinPartitions(at, "doc_id").select(*docs.columns)


def ordered(docs: DataFrame) -> DataFrame:
    """Mixed documents in training order, row by row: ids may be null or repeat."""
    row = free(docs, "_row")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "mixed")
    return training_order(rows, curriculum_mix(rows, row=row), row).drop(row)
