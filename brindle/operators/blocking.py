"""Blocking predicates: each gives a record a set of keys, and records that share a key are candidates.

What a predicate would cost and find is told from group sizes, so learning a choice of predicates makes neither the
candidate pairs nor the true ones.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linkage import tokens
from .relational import cut

Predicate = Callable[[str], Column]


def exact(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.array(F.col(column).cast("string")))


def exact_number(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.array(F.col(column).cast("double").cast("string")))


def first_chars(column: str, n: int = 3) -> Column:
    return F.when(F.length(column) > 0, F.array(F.substring(column, 1, n)))


def common_words(column: str) -> Column:
    return F.array_distinct(tokens(column))


def common_integers(column: str) -> Column:
    """For each token that has a digit, its digits alone."""
    return F.array_distinct(F.filter(F.transform(tokens(column), lambda t: F.regexp_replace(t, "[^0-9]", "")), lambda t: t != ""))


def token_ngrams(column: str, n: int = 2) -> Column:
    """n tokens in a row, written together."""
    t = tokens(column)
    runs = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, F.lit(n)), ""))
    return F.when(F.size(t) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def conjunction(*parts: Column) -> Column:
    """Keys of several predicates at once: one from each."""
    def both(a: Column, b: Column) -> Column:
        return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws("\x1f", x, y))))

    return reduce(both, parts)


#: Predicates by name, for a text column.
PREDICATES: dict[str, Predicate] = {"exact": exact, "first3": first_chars, "words": common_words, "integers": common_integers, "bigrams": token_ngrams}


def blocks(df: DataFrame, key: str, blockers: dict[str, Column]) -> DataFrame:
    """blocker, block, key: every record under each of its keys."""
    each = F.array(*[F.struct(F.lit(n).alias("blocker"), k.alias("keys")) for n, k in blockers.items()])
    long = df.select(key, F.explode(each).alias("x")).select(key, "x.blocker", F.explode("x.keys").alias("block"))
    return long.select("blocker", "block", key)


def candidates(df: DataFrame, key: str, blockers: dict[str, Column]) -> DataFrame:
    """id1 < id2 of records that share a block of any blocker, once each: a union of equi-joins on the blocks."""
    b = blocks(df, key, blockers)
    left, right = b.select("blocker", "block", F.col(key).alias("id1")), b.select("blocker", "block", F.col(key).alias("id2"))
    return left.join(right, ["blocker", "block"]).where("id1 < id2").select("id1", "id2").distinct()


def block_sizes(df: DataFrame, key: str, blockers: dict[str, Column]) -> DataFrame:
    """blocker, block, n, pairs."""
    sizes = blocks(df, key, blockers).groupBy("blocker", "block").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("pairs", F.expr("n * (n - 1) div 2"))


def coverage(df: DataFrame, key: str, label: str, blockers: dict[str, Column]) -> DataFrame:
    """blocker, positives, negatives: pairs under one key that are of one object, and that are not, from group sizes.

    A pair that shares several keys of a blocker counts once for each of them, as in the block table.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("blocker"), k.alias("keys")) for n, k in blockers.items()]))
    b = df.where(F.col(key).isNotNull()).select(F.col(label).alias("_y"), each.alias("x")).select("_y", "x.blocker", F.explode("x.keys").alias("block"))
    cells = b.groupBy("blocker", "block", "_y").agg(F.count(F.lit(1)).alias("n"))
    per = cells.groupBy("blocker", "block").agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) div 2")).alias("same"))
    return per.groupBy("blocker").agg(F.sum("same").alias("positives"), F.sum(F.expr("n * (n - 1) div 2") - F.col("same")).alias("negatives"))


def true_pairs(df: DataFrame, key: str, label: str) -> DataFrame:
    """id1 < id2 of records of one object."""
    a, b = df.select(F.col(key).alias("id1"), F.col(label).alias("_y")), df.select(F.col(key).alias("id2"), F.col(label).alias("_y"))
    return a.join(b, "_y").where("id1 < id2").select("id1", "id2")


def covered(df: DataFrame, key: str, label: str, blockers: dict[str, Column]) -> DataFrame:
    """blocker, id1, id2 of true pairs that a blocker brings together: candidates of one object, never others."""
    b = blocks(df, key, blockers).join(df.select(key, F.col(label).alias("_y")), key)
    left, right = b.select("blocker", "block", "_y", F.col(key).alias("id1")), b.select("blocker", "block", "_y", F.col(key).alias("id2"))
    return left.join(right, ["blocker", "block", "_y"]).where("id1 < id2").select("blocker", "id1", "id2").distinct()


#: Blockers whose subsets are counted; with more of them, classes of equal keys are compared.
MOST_SUBSETS = 10


class _Cover:
    """How many true pairs a blocker brings together that none of the chosen ones does.

    Records of one object with the same keys under all blockers are one class, of which only the size is kept.  Where no
    record has two keys of a blocker, pairs that agree in a set of blockers are sizes of groups, and inclusion and exclusion
    over the chosen ones gives the rest: no pair is made.  Else pairs of classes that share a key are, with the number of
    pairs of records they stand for.
    """

    def __init__(self, df: DataFrame, key: str, label: str, blockers: dict[str, Column]) -> None:
        self.names = list(blockers)
        sets = [F.array_sort(F.array_distinct(F.filter(k, lambda x: x.isNotNull()))).alias(f"_k{i}") for i, k in enumerate(blockers.values())]
        rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("_y"), *sets)
        self.at = [f"_k{i}" for i in range(len(blockers))]
        self.classes = cut(rows.groupBy("_y", *self.at).agg(F.count(F.lit(1)).alias("n")))
        most = self.classes.agg(*[F.max(F.size(c)) for c in self.at]).first()
        self.single = len(blockers) <= MOST_SUBSETS and all((m or 0) <= 1 for m in most)
        self.agree: dict[frozenset[int], int] = {}
        if not self.single:
            self.left = cut(self._pairs())

    def total(self) -> int:
        per = self.classes.groupBy("_y").agg(F.sum("n").alias("n"))
        return int(per.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0)

    def _count(self, wanted: list[frozenset[int]]) -> None:
        """True pairs that agree in every blocker of a set, for all sets at once."""
        wanted = sorted({w for w in wanted if w not in self.agree}, key=sorted)
        if not wanted:
            return
        each = []
        for g, w in enumerate(wanted):
            keys = F.array(*[F.try_element_at(self.at[i], F.lit(1)) for i in sorted(w)])
            each.append(F.when(~F.exists(keys, lambda x: x.isNull()), F.struct(F.lit(g).alias("g"), keys.alias("k"))))
        long = self.classes.select("_y", "n", F.explode(F.array(*each)).alias("x")).where("x IS NOT NULL")
        sizes = long.groupBy("_y", "x.g", "x.k").agg(F.sum("n").alias("n"))
        found = {r["g"]: int(r["p"]) for r in sizes.groupBy("g").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("p")).collect()}
        self.agree.update({w: found.get(g, 0) for g, w in enumerate(wanted)})

    def _pairs(self) -> DataFrame:
        """blocker, a, b, n: pairs of classes of one object that share a key of the blocker, a class with itself too."""
        own = cut(self.classes.withColumn("id", F.monotonically_increasing_id()))
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("blocker"), F.col(c).alias("keys")) for i, c in enumerate(self.at)]))
        long = own.select("_y", "id", "n", each.alias("x")).select("_y", "id", "n", "x.blocker", F.explode("x.keys").alias("key"))
        one, two = long.withColumnsRenamed({"id": "a", "n": "_n"}), long.withColumnsRenamed({"id": "b", "n": "_m"})
        size = F.when(F.col("a") == F.col("b"), F.expr("_n * (_n - 1) div 2")).otherwise(F.col("_n") * F.col("_m"))
        return one.join(two, ["_y", "blocker", "key"]).where("a <= b").select("blocker", "a", "b", size.alias("n")).where("n > 0").distinct()

    def gains(self, chosen: list[str]) -> dict[str, int]:
        """New true pairs of every blocker that is not chosen and has any."""
        taken = [self.names.index(c) for c in chosen]
        others = [i for i in range(len(self.names)) if i not in taken]
        if self.single:
            subsets = [frozenset(i for k, i in enumerate(taken) if bits >> k & 1) for bits in range(1 << len(taken))]
            self._count([s | {i} for s in subsets for i in others])
            new = {self.names[i]: sum((-1) ** len(s) * self.agree[s | {i}] for s in subsets) for i in others}
        else:
            new = {self.names[r["blocker"]]: int(r["n"]) for r in self.left.groupBy("blocker").agg(F.sum("n").alias("n")).collect()}
        return {n: g for n, g in new.items() if g}

    def take(self, name: str) -> None:
        if not self.single:
            i = self.names.index(name)
            gone = self.left.where(F.col("blocker") == i).select("a", "b")
            self.left = cut(self.left.where(F.col("blocker") != i).join(gone, ["a", "b"], "left_anti"))


def learn_cover(df: DataFrame, key: str, label: str, blockers: dict[str, Column], epsilon: int = 0, most_negatives: float = float("inf"), least_cover: float = 1e-3, damping: float = 50.0) -> list[str]:
    """Greedy set cover: the blocker with the most new true pairs for its negatives (plus ``damping``), until at most
    ``epsilon`` true pairs are left, or none gains.  Blockers above ``most_negatives`` are left out; ties go by name."""
    cost = {r["blocker"]: r["negatives"] for r in coverage(df, key, label, blockers).collect()} if blockers else {}
    allowed = {n: c for n, c in blockers.items() if cost.get(n, 0) <= most_negatives}
    if not allowed:
        return []
    cover = _Cover(df, key, label, allowed)
    total = cover.total()
    chosen: list[str] = []
    found = 0
    while total - found > epsilon:
        gains = cover.gains(chosen)
        best = min(gains, key=lambda n: (-gains[n] / (cost.get(n, 0) + damping), n), default=None)
        if best is None or gains[best] / (cost.get(best, 0) + damping) <= least_cover:
            break
        chosen.append(best)
        found += gains[best]
        cover.take(best)
    return chosen


def first_choice(df: DataFrame, key: str, label: str, blockers: dict[str, Column], damping: float = 50.0) -> str:
    """The blocker with the most true pairs for its negatives, where each gives a record one key at most; the first named of equals.

    Rows without a label are in no pair, and rows of one key make none with each other.
    """
    rows = df.where(F.col(label).isNotNull())
    again = rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key), key, "left_semi")
    own = coverage(again, key, label, {n: conjunction(k, exact(key)) for n, k in blockers.items()})
    less = own.select("blocker", (-F.col("positives")).alias("positives"), (-F.col("negatives")).alias("negatives"))
    per = coverage(rows, key, label, blockers).unionByName(less).groupBy("blocker").agg(F.sum("positives").alias("p"), F.sum("negatives").alias("n"))
    cover = {r["blocker"]: r["p"] / (r["n"] + damping) for r in per.collect()}
    return max(blockers, key=lambda n: cover.get(n, 0.0))


def conjunctions(blockers: dict[str, Column], most: int = 2) -> dict[str, Column]:
    """The blockers and all conjunctions of up to ``most`` of them, named a&b."""
    from itertools import combinations

    return {"&".join(names): conjunction(*[blockers[n] for n in names]) if len(names) > 1 else blockers[names[0]] for k in range(1, most + 1) for names in combinations(blockers, k)}


def random_choice(blockers: dict[str, Column], k: int, seed: int = 1) -> list[str]:
    return sorted(random.Random(seed).sample(sorted(blockers), min(k, len(blockers))))


def sample_objects(df: DataFrame, label: str, share: float, seed: int = 1) -> DataFrame:
    """All rows of a share of the objects, by a hash of the object."""
    from .rows import uniform

    return df.where(F.col(label).isNotNull() & (uniform(F.col(label), seed) < share))


def canopies(similar: DataFrame, nodes: DataFrame, key: str, loose: float = 0.6) -> DataFrame:
    """centre, member: in order of a hash, a row that is in no canopy yet becomes a centre and takes all similar rows.

    The order makes this a maximal independent set: in each round a row whose hash is below that of all its undecided
    similar rows becomes a centre, and its neighbours leave, so rounds grow with the logarithm of the rows.
    ``similar``: id1, id2, similarity.
    """
    near = similar.where(F.col("similarity") >= loose).select("id1", "id2")
    both = cut(near.union(near.select("id2", "id1")).where("id1 <> id2").distinct())
    open_rows = cut(nodes.select(F.col(key).alias("n")).distinct())
    rank = lambda c: F.struct(F.md5(F.col(c).cast("string")).alias("h"), F.col(c).alias("n"))
    centres: DataFrame | None = None
    while not open_rows.isEmpty():
        left = both.join(open_rows.withColumnRenamed("n", "id1"), "id1", "left_semi").join(open_rows.withColumnRenamed("n", "id2"), "id2", "left_semi")
        least = left.groupBy(F.col("id1").alias("n")).agg(F.min(rank("id2")).alias("m"))
        new = cut(open_rows.join(least, "n", "left").where(F.col("m").isNull() | (rank("n") < F.col("m"))).select("n"))
        centres = new if centres is None else centres.unionByName(new)
        gone = new.union(both.join(new.withColumnRenamed("n", "id1"), "id1", "left_semi").select("id2"))
        open_rows = cut(open_rows.join(gone, "n", "left_anti"))
    if centres is None:
        return nodes.select(F.col(key).alias("centre"), F.col(key).alias("member"))
    members = both.join(centres.withColumnRenamed("n", "id1"), "id1", "left_semi").select(F.col("id1").alias("centre"), F.col("id2").alias("member"))
    return members.union(centres.select(F.col("n").alias("centre"), F.col("n").alias("member")))
