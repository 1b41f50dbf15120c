"""Near-dedup of whole rows: word shingles of ``SHINGLE`` words, copies at a Jaccard similarity of 4/5 or more.

Rows with equal shingle sets are one node, and a node has the SimHash of its shingles.  Nodes whose fingerprints differ in
``RADIUS`` bits or less are candidates, found by the BK-trees of ``simhash``.  A pair at 4/5 differs in about ten bits, which
no tree finds in less than all pairs, so there is a way for the rest: nodes that agree in a band of MinHash values are
candidates too.  With ``BANDS`` bands of ``DEEP`` values a pair at 4/5 has no band in common in about 5 of a million cases,
and more alike pairs less often.  Candidates are only what is compared, set by set, in two steps: first every node with the least node of each of its
bands, an edge at a time; then, in each connected group of candidates that these links leave in pieces, the nodes outside
the largest piece with all nodes of the group that are not in their own piece yet.  Groups are dealt out as cells of
``STRAYS`` such nodes by ``TILE`` nodes, so no task holds more than a cell's sets, however large a group is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches_of, free, ready, staged
from .bpe import texts_of
from .simhash import contracted, edges

SHINGLE, BANDS, DEEP = 5, 40, 6
STRAYS, TILE = 512, 2048
#: Bits in which fingerprints of candidates differ at most.
RADIUS = 6
FACTORS = np.random.default_rng(7).integers(0, 2**63, BANDS * DEEP, dtype="uint64") * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; shorter texts are one run, empty ones have none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "uint64")
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(whole)], "uint64")
    ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-width] + 1]).tolist()
    return np.unique(np.array([digest(whole[a:b]) for a, b in zip(first, ends[width - 1 :].tolist())], "uint64"))


def fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of hashes: bits that are set in over half of them."""
    votes = np.zeros(64, "int64")
    for a in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[a : a + (1 << 16)].view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int32")
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<i8")[0])


def simhash_candidates(nodes: DataFrame) -> DataFrame:
    """a, b: nodes (node, fp) that join the same groups as all links of ``RADIUS`` bits or less between their fingerprints."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    blocks = RADIUS + (2 if nodes.count() <= 64 << 16 else 3)
    equal = nodes.join(first, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = edges(first.select("fp"), RADIUS, blocks).withColumnsRenamed({"a": "_a", "b": "_b"})
    ends = near.join(first.select(F.col("fp").alias("_a"), F.col("first").alias("a")), "_a").join(first.select(F.col("fp").alias("_b"), F.col("first").alias("b")), "_b")
    return equal.union(ends.select("a", "b"))


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS numbers for each set; none may be empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), BANDS), "uint64")
    with np.errstate(over="ignore"):
        for k, factor in enumerate(FACTORS):
            least = np.minimum.reduceat(flat * factor, starts)
            at = out[:, k // DEEP]
            at[:] = (at ^ least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    return out.view("int64")


def linked(sets: list[np.ndarray], label: np.ndarray | None = None, asked: np.ndarray | None = None) -> np.ndarray:
    """A label for each set: equal for those that links of 4/5 or more connect, given pieces that are connected already.

    Only sets in ``asked`` are compared, with all others; else the fewest that tell all groups.
    """
    n, size = len(sets), np.array([len(s) for s in sets], "int64")
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1].astype("int64")
    tested = np.zeros(n, bool) if asked is None else ~asked
    while True:
        count = np.bincount(label, minlength=n)
        left = np.flatnonzero(~tested & (label != count.argmax())) if asked is None else np.flatnonzero(~tested)
        if not len(left):  # of two groups, all of one have been compared with everything
            return label
        i = left[count[label[left]].argmin()]
        tested[i] = True
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        many = high - low
        shared = np.bincount(owner[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())], minlength=n)
        near = 5 * shared >= 4 * (size + size[i] - shared)
        joined = np.unique(label[near])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]


def alike(a: bytes, b: bytes) -> bool:
    """Whether two packed sets are at 4/5 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(np.frombuffer(a, "uint64"), np.frombuffer(b, "uint64"), assume_unique=True))
    return 5 * shared >= 4 * ((len(a) + len(b)) // 8 - shared)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, null ids last.

    Rows are told apart by a key of their own, so ids may be null or repeat and no row stands for another text.  Null and
    empty texts are copies of each other.
    """
    spark = ready(docs.sparkSession)
    batches_of(spark, 512)
    row = free(docs, "_row")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    texts = rows.select(F.col(row).alias("_row"), "text", "doc_id")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in texts_of(b.column(1))]
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            for i, row in zip(full, bands_of([sets[i] for i in full]) if full else ()):
                bands[i] = row
            prints = [fingerprint(s) if len(s) else None for s in sets]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.int64())], ["_row", "doc_id", "mark", "key", "bands", "fp"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([shingles(t).tobytes() for t in texts_of(b.column(1))], pa.binary())], ["_row", "root", "hashes"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0, 1]).filter(pa.array([alike(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], pa.bool_()))

    def links(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("asked", ascending=False).drop_duplicates("_row").reset_index(drop=True)
        nodes, piece = f["_row"].to_numpy(), f["piece"].to_numpy()
        label = linked([np.frombuffer(x, "uint64") for x in f["hashes"]], piece, f["asked"].to_numpy(bool))
        first = pd.Series(nodes).groupby(label).transform("first").to_numpy()
        own = first != nodes
        return pd.DataFrame({"a": nodes[own], "b": first[own]})

    kind = dict(docs.dtypes)["doc_id"]
    sketched = texts.select("_row", "text", "doc_id", F.xxhash64("text").alias("mark")).mapInArrow(sketch, f"_row long, doc_id {kind}, mark long, key binary, bands array<long>, fp long")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "_row")
    nodes = sketched.groupBy("key").agg(F.min(order).alias("order"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    nodes = staged(nodes.select(F.col("order._row").alias("node"), "order", "bands", "fp"), "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("at", "band"))
    firsts = banded.groupBy("at", "band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = banded.join(firsts, ["at", "band"]).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    close = simhash_candidates(nodes.where("fp IS NOT NULL").select("node", "fp"))
    stars = staged(close.union(met).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    near = contracted(stars)
    asked = texts.select("_row", "text").join(near.withColumnRenamed("node", "_row"), "_row").select("_row", "text", "root")
    sets = staged(asked.mapInArrow(packed, "_row long, root long, hashes binary"), "sets")
    one = sets.select(F.col("_row").alias("a"), F.col("hashes").alias("x"))
    both = stars.join(one, "a").join(one.withColumnsRenamed({"a": "b", "x": "y"}), "b").select("a", "b", "x", "y")
    sure = staged(both.mapInArrow(verified, "a long, b long"), "sure")
    pieces = contracted(sure).withColumnsRenamed({"node": "_node", "root": "piece"})
    placed = sets.select("_row", "root").join(pieces, F.col("_row") == F.col("_node"), "left").select("_row", "root", F.coalesce("piece", "_row").alias("piece"))
    sizes = placed.groupBy("root", "piece").agg(F.count(F.lit(1)).alias("n"))
    broken = sizes.groupBy("root").agg(F.max(F.struct("n", "piece")).alias("most"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
    rest = placed.join(broken.select("root", F.col("most.piece").alias("main"), F.ceil((F.col("n") - F.col("most.n")) / STRAYS).alias("s"), F.ceil(F.col("n") / TILE).alias("t")), "root")
    own = rest.withColumns({"i": F.pmod(F.xxhash64("_row"), F.col("s")), "j": F.pmod(F.xxhash64("_row", F.lit(1)), F.col("t"))})
    strays = own.where("piece <> main").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("t") - 1))).select("_row", "root", "piece", "i", "j", F.lit(True).alias("asked"))
    others = own.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select("_row", "root", "piece", "i", "j", F.lit(False).alias("asked"))
    cells = strays.unionByName(others).join(sets.select("_row", "hashes"), "_row").select("_row", "root", "piece", "i", "j", "asked", "hashes")
    found = cells.groupBy("root", "i", "j").applyInPandas(links, "a long, b long")
    roots = contracted(sure.union(found)).withColumnRenamed("node", "_node")
    grouped = nodes.join(roots, F.col("node") == F.col("_node"), "left").groupBy(F.coalesce("root", "node").alias("root"))
    return rows.join(grouped.agg(F.min("order").alias("order")).select(F.col("order._row").alias(row)), row, "left_semi").drop(row)
