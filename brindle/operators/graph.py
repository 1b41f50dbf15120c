"""Connected groups of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import cut

#: Links that one task joins.
FEW = 500_000


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links and the smallest node of the group of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    to = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(to[x], to[y]), np.maximum(to[x], to[y])
        x, y = low[low != high], high[low != high]
        np.minimum.at(to, y, x)
        while ((up := to[to]) != to).any():
            to = up
    return nodes, nodes[to]


def groups(links: DataFrame, a: str = "id1", b: str = "id2") -> DataFrame:
    """node, group for every end of the links: the group is its smallest node.

    While there are more than ``FEW`` links, every node hangs from its least neighbour in a round and edges are relabelled.
    Every other round compares by a new hash: stars need one plain round, and chains in order are about halved by a hashed
    one, so rounds grow with the logarithm of the links.  What is left is joined in one task.
    """
    edges = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    kind = dict(edges.dtypes)["a"]

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = pd.concat(frames, ignore_index=True)
        nodes, least = connected(f["a"].to_numpy(), f["b"].to_numpy())
        for i in range(0, len(nodes), 10_000):
            yield pd.DataFrame({"node": nodes[i : i + 10_000], "to": least[i : i + 10_000]})

    at: DataFrame | None = None
    turn = 0
    while at is None or not edges.isEmpty():
        turn += 1
        few = edges.count() <= FEW
        hashed = lambda c, k=turn: F.lit(0).cast("long") if k % 2 else F.xxhash64(c, F.lit(k))
        ranked = lambda c, k=turn: F.struct(hashed(c, k).alias("h"), F.col(c).alias("n"))
        if few:
            hop = cut(edges.coalesce(1).mapInPandas(join, f"node {kind}, to {kind}"))
        else:
            both = edges.union(edges.select("b", "a"))
            hop = cut(both.groupBy("a").agg(F.min(ranked("b")).alias("m")).select(F.col("a").alias("node"), F.least("m", ranked("a"))["n"].alias("to")))
        if at is None:
            at = hop.withColumnRenamed("to", "root")
        else:
            at = cut(at.join(hop.withColumnsRenamed({"node": "root", "to": "_to"}), "root", "left").select("node", F.coalesce("_to", "root").alias("root")))
        if few:
            break
        moved = edges.join(hop.withColumnsRenamed({"node": "a", "to": "_a"}), "a").join(hop.withColumnsRenamed({"node": "b", "to": "_b"}), "b")
        edges = cut(moved.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct())
    least = at.groupBy("root").agg(F.min("node").alias("group"))
    return at.join(least, "root").select("node", "group")
