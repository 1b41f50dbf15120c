"""SimHash near-dedup over shard trees.

Fingerprints of 64 bits link at a Hamming distance of ``RADIUS`` or less.  Cut into m blocks, two such fingerprints
agree in m - RADIUS blocks at least, so every distinct fingerprint goes to one shard for each choice of that many blocks:
four shards of 16 bits with m = 4, ten of about 26 with m = 5, twenty of 32 with m = 6; m follows the number of
fingerprints, so that shards do not grow with the corpus.  A shard holds a BK-tree: a child hangs from its parent by the
integer distance between the two, and a search follows only the edges whose distance differs from the query's by the
radius or less.  Trees are built and searched level by level for all shards of
a task at once.  A subtree that lies in the query's own group already is skipped, so a dense group of near copies costs
little more than its size.  A shard above ``TILE`` fingerprints is dealt out as pairs of tiles.  Tasks return one edge
for each fingerprint and local group, never the pairs; groups are then contracted across shards until no edge is left.
"""

from __future__ import annotations

from collections.abc import Iterator

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected
from ._common import batches_of, free, parts_for, ready, staged
from .bpe import texts_of

#: Radius, fingerprints of a tile, fingerprints that a shard holds on average before more blocks are cut.
RADIUS, TILE, SHARD = 3, 16384, 1024
#: Rounds of joining groups before the order of nodes is varied.
PLAIN = 6
#: Links that one task joins.
FEW = 500_000
#: Rows of whole shards that a task searches at once, and pairs of query and node.
AT_ONCE, PAIRS = 100_000, 300_000


def fingerprints_of(texts: list[bytes], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text: bits set in over half of the shingles' hashes."""
    out = np.zeros(len(texts), dtype="uint64")
    hashes: list[int] = []
    starts, rows = [], []
    digest = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        words = t.lower().split()
        if not words:
            continue
        starts.append(len(hashes))
        rows.append(i)
        whole = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(digest(whole, seed))
            continue
        ends = np.cumsum(np.fromiter(map(len, words), "int64", len(words)) + 1) - 1
        first = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
        hashes.extend([digest(whole[a:b], seed) for a, b in zip(first, ends[shingle - 1 :].tolist())])
    if rows:
        bounds = [*starts, len(hashes)]
        all_hashes = np.array(hashes, dtype="<u8")
        for k, i in enumerate(rows):
            own = all_hashes[bounds[k] : bounds[k + 1]]
            votes = np.zeros(64, dtype="int64")
            for a in range(0, len(own), 1 << 16):
                votes += np.unpackbits(own[a : a + (1 << 16)].view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int32")
            out[i] = np.packbits(votes * 2 > len(own), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, fp (long) of every whole text; null and empty texts have fingerprint 0.  ``row``: a long column to keep."""
    spark = ready(docs.sparkSession)
    batches_of(spark, 512)
    kind = dict(docs.dtypes)["doc_id"]
    key = [row] if row else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(fingerprints_of(texts_of(b.column(1))).view("int64"))], ["doc_id", *key, "fp"])

    return docs.select("doc_id", "text", *key).mapInArrow(run, f"doc_id {kind},{f' {row} long,' if row else ''} fp long")


class Forest:
    """BK-trees of many shards.  shard: sorted shard numbers; key: the fingerprint of each row."""

    def __init__(self, shard: np.ndarray, key: np.ndarray) -> None:
        n = len(key)
        self.shard, self.key = shard, key
        self.parent, self.edge, self.level = np.full(n, -1), np.zeros(n, "int64"), np.zeros(n, "int64")
        first = np.concatenate([[True], shard[1:] != shard[:-1]]) if n else np.zeros(0, bool)
        self.root_of = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, "int64")
        at, rest, depth = self.root_of.copy(), np.flatnonzero(~first), 0
        while len(rest):
            depth += 1
            d = np.bitwise_count(key[rest] ^ key[at[rest]]).astype("int64")
            slot = at[rest] * 65 + d
            _, where, back = np.unique(slot, return_index=True, return_inverse=True)
            child = rest[where]
            self.parent[child], self.edge[child], self.level[child] = at[child], d[where], depth
            at[rest] = child[back]
            placed = np.zeros(len(rest), bool)
            placed[where] = True
            rest = rest[~placed]
        slots = np.where(self.parent >= 0, self.parent * 65 + self.edge, -1)
        self.by_slot = np.argsort(slots, kind="stable")
        self.slots = slots[self.by_slot]
        self.deep = [np.flatnonzero(self.level == x) for x in range(depth, 0, -1)]

    def links(self, radius: int) -> np.ndarray:
        """A label for each row: the first row of its group within the shard."""
        n = len(self.key)
        label = np.arange(n)
        order = np.argsort(self.level, kind="stable")
        a, step = 0, max(1, min(1024, PAIRS // max(1, int(np.bincount(self.root_of).max(initial=1)))))
        while a < n:
            low, high = label.copy(), label.copy()
            for rows in self.deep:  # what a subtree's labels span
                np.minimum.at(low, self.parent[rows], low[rows])
                np.maximum.at(high, self.parent[rows], high[rows])
            whole = np.where(low == high, low, -1)
            b, visits = min(n, a + step), 0
            q = order[a:b]
            node, found = self.root_of[q], []
            while len(q):
                live = whole[node] != label[q]
                q, node = q[live], node[live]
                visits += len(q)
                d = np.bitwise_count(self.key[q] ^ self.key[node]).astype("int64")
                near = d <= radius
                found.append(np.unique(label[q[near]] * n + label[node[near]]))
                lo = np.searchsorted(self.slots, node * 65 + np.maximum(d - radius, 0), side="left")
                hi = np.searchsorted(self.slots, node * 65 + np.minimum(d + radius, 64), side="right")
                count = hi - lo
                q = np.repeat(q, count)
                offset = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(q))
                node = self.by_slot[offset]
            pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, "int64")
            pairs = np.stack([pairs // n, pairs % n])
            label = merged(label, pairs[:, pairs[0] != pairs[1]])
            step = max(1, min(4 * step, PAIRS * (b - a) // max(1, visits)))  # what the last round took bounds the next
            a = b
        return label


def merged(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Labels after their groups are joined by pairs of labels."""
    if not pairs.shape[1]:
        return label
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for x, y in pairs.T.tolist():
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    to = np.arange(len(label))
    for x in list(root):
        to[x] = top(x)
    return to[label]


def shards_of(blocks: int, radius: int) -> list[Column]:
    """A number for each choice of ``blocks`` - ``radius`` blocks: equal where two fingerprints agree in all of them."""
    if not radius < blocks:
        raise ValueError("the radius must be below the number of blocks")
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(n).cast("long")
        for i in chosen:
            width = cuts[i + 1] - cuts[i]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << width) - 1)))
        out.append(key)
    return out


def edges(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """a, b: edges that join the same groups as all links between the fingerprints of ``distinct`` (fp)."""
    if blocks is None:
        n, blocks = distinct.count(), radius + 1
        while n > SHARD << (64 * (blocks - radius) // blocks) and blocks < 2 * radius:
            blocks += 1
    keyed = distinct.select("fp", F.explode(F.array(*shards_of(blocks, radius))).alias("shard"))
    large = keyed.groupBy("shard").count().where(F.col("count") > TILE)
    dealt = keyed.join(large, "shard", "left").withColumn("_n", F.coalesce(F.ceil(F.col("count") / TILE), F.lit(1)))
    dealt = dealt.withColumn("_t", F.pmod(F.xxhash64("fp"), F.col("_n"))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    cells = dealt.select("fp", "shard", F.least("_t", "_j").alias("i"), F.greatest("_t", "_j").alias("j"))
    laid = cells.repartition(parts_for(keyed, 64), "shard", "i", "j").sortWithinPartitions("shard", "i", "j", "fp")

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        s = f[["shard", "i", "j"]].to_numpy("int64")
        shard = np.concatenate([[0], np.cumsum((s[1:] != s[:-1]).any(axis=1))]) if len(f) else np.zeros(0, "int64")
        fp = f["fp"].to_numpy("int64")
        label = Forest(shard, fp.view("uint64")).links(radius)
        own = label != np.arange(len(f))
        return pd.DataFrame({"a": fp[own], "b": fp[label[own]]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            held.append(f)
            if sum(map(len, held)) < AT_ONCE:
                continue
            f = pd.concat(held, ignore_index=True)
            last = f[["shard", "i", "j"]].iloc[-1]
            open_end = ((f["shard"] == last["shard"]) & (f["i"] == last["i"]) & (f["j"] == last["j"])).to_numpy()
            if not open_end.all():
                yield solve(f[~open_end])
            held = [f[open_end]]
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return laid.mapInPandas(run, "a long, b long")


def contracted(links: DataFrame) -> DataFrame:
    """node, root for every end of ``links`` (a, b; long): one root for each connected group.

    While there are more than ``FEW`` links, each round hangs every node from its least neighbour and relabels the edges,
    which ends stars and most other groups in a few rounds.  After ``PLAIN`` rounds every other one compares numbers with
    some bits flipped, other ones each time: chains of rising numbers, which would shorten by one node a round, about halve
    in these.  So rounds grow with the logarithm of a group's size.  What is left is joined in one task, as each round costs
    the driver several jobs.
    """
    links = links.where("a <> b").distinct().checkpoint()
    roots: DataFrame | None = None
    turn = 0

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)
        if sum(map(len, held)):
            nodes, least = connected(*pd.concat(held)[["a", "b"]].to_numpy("int64").T)
            for i in range(0, len(nodes), 10_000):
                yield pd.DataFrame({"node": nodes[i : i + 10_000], "to": least[i : i + 10_000]})

    while True:
        turn += 1
        few = links.count() <= FEW
        if few:
            ends = links.coalesce(1).mapInPandas(join, "node long, to long").checkpoint()
        else:
            mask = F.lit(0 if turn <= PLAIN or turn % 2 else (turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63))
            least = F.least(F.min(F.col("b").bitwiseXOR(mask)), F.first(F.col("a").bitwiseXOR(mask)))
            ends = links.union(links.select("b", "a")).groupBy("a").agg(least.bitwiseXOR(mask).alias("to")).withColumnRenamed("a", "node")
            ends = ends.checkpoint()
        if roots is None:
            roots = ends.withColumnRenamed("to", "root")
        else:
            step = ends.withColumnsRenamed({"node": "root", "to": "_to"})
            roots = roots.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("root")).checkpoint()
        if few:
            return roots
        new = links.join(ends.withColumnsRenamed({"node": "a", "to": "_a"}), "a").join(ends.withColumnsRenamed({"node": "b", "to": "_b"}), "b")
        links = new.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct().checkpoint()


def _grouped(base: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """fp, root, least (smallest id) of every distinct fingerprint of ``base`` (doc_id, fp)."""
    distinct = base.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = contracted(edges(distinct, radius, blocks))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links) for every row of ``docs``.

    Empty and null texts share fingerprint 0 and link like any other; equal fingerprints always link.  Null ids get the
    smallest id that is not null in their group, or null.  Repeated rows stay.  An empty table gives an empty table.
    Other columns are ignored.
    """
    base = fingerprints(docs).checkpoint()
    rooted = _grouped(base, radius, blocks)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(smallest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return base.join(by_fp, F.col("fp") == F.col("_fp")).drop("_fp")


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, null ids last, of equal ids the smallest text hash.

    Rows are told apart by a key of their own, so a row never goes because another row of its id does.
    """
    row = free(docs, "_row")
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    base = fingerprints(rows.withColumn("doc_id", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), F.col(row).alias("at")))).checkpoint()
    first = _grouped(base, radius).groupBy("root").agg(F.min("least").alias("x")).select(F.col("x.at").alias(row))
    return rows.join(first, row, "left_semi").drop(row)


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
