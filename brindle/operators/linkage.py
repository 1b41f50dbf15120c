"""Record linkage: tokens, similarity joins, string measures, pair ranking and precision at recall.

Similarity joins work on classes of records with equal tokens, so that a name that many records share is compared once.
Classes meet on the rarest tokens of each (a prefix that two classes above the threshold must share), which is exact:
common tokens stay in the measure and are only left out of the index where the threshold allows it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = r"[\s\p{Punct}]+"


def tokens(text: str | Column) -> Column:
    """Lower-case tokens, repeats included; null has none."""
    return F.filter(F.split(F.lower(text), DELIMITERS), lambda t: t != "")


def ngrams(text: str | Column, n: int = 3) -> Column:
    """Character n-grams of the whole lower-case text."""
    t = F.lower(text)
    return F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def ngrams_but_last(text: str | Column, n: int = 3) -> Column:
    """Character n-grams without the last one of the text, as some tokenizers count them."""
    grams = ngrams(text, n)
    return F.slice(grams, F.lit(1), F.greatest(F.size(grams) - 1, F.lit(0)))


def shared_of_larger(a: Column, b: Column) -> Column:
    """Distinct shared tokens over the larger number of distinct tokens; 0 where both are empty."""
    largest = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(largest > 0, F.size(F.array_intersect(a, b)) / largest).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Distinct shared over distinct all; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def edit_similarity(a: str | Column, b: str | Column) -> Column:
    """1 minus the edit distance by the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def affine_distance(a: str, b: str, match: float = -5.0, mismatch: float = 5.0, gap_open: float = 5.0, gap_extend: float = 1.0) -> float:
    """Edit distance with affine gaps, divided by both lengths together."""
    if not a and not b:
        return 0.0
    far = float("inf")
    m, x, y = [0.0] + [far] * len(b), [far] * (len(b) + 1), [far] * (len(b) + 1)
    for j in range(1, len(b) + 1):
        x[j] = gap_open + gap_extend * (j - 1)
    for i in range(1, len(a) + 1):
        m2, x2, y2 = [far] * (len(b) + 1), [far] * (len(b) + 1), [far] * (len(b) + 1)
        y2[0] = gap_open + gap_extend * (i - 1)
        for j in range(1, len(b) + 1):
            m2[j] = min(m[j - 1], x[j - 1], y[j - 1]) + (match if a[i - 1] == b[j - 1] else mismatch)
            x2[j] = min(m2[j - 1] + gap_open, x2[j - 1] + gap_extend, y2[j - 1] + gap_open)
            y2[j] = min(m[j] + gap_open, y[j] + gap_extend, x[j] + gap_open)
        m, x, y = m2, x2, y2
    return min(m[-1], x[-1], y[-1]) / (len(a) + len(b))


def affine_distances(a: list[str], b: list[str], match: float = -5.0, mismatch: float = 5.0, gap_open: float = 5.0, gap_extend: float = 1.0) -> np.ndarray:
    """``affine_distance`` of many pairs at once: one step for each pair of positions, over all pairs of the batch.

    The gap inside a row runs along the row, so it is the one inner loop; pairs are padded to the longest of the batch and
    each is read where it ends.
    """
    k = len(a)
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    x = np.full((k, max(n.max(initial=0), 1)), -1, "int32")
    y = np.full((k, max(m.max(initial=0), 1)), -2, "int32")
    for i, (s, t) in enumerate(zip(a, b)):
        x[i, : len(s)], y[i, : len(t)] = [ord(c) for c in s], [ord(c) for c in t]
    width, far, rows = y.shape[1], np.inf, np.arange(k)
    best = np.full((k, width + 1), far)
    best[:, 0] = 0.0
    up = np.full((k, width + 1), far)
    across = np.concatenate([np.full(1, far), gap_open + gap_extend * np.arange(width)]) * np.ones((k, 1))
    end = lambda: np.minimum(np.minimum(best, across), up)[rows, m]
    out = np.where(n == 0, end(), far)
    for i in range(1, x.shape[1] + 1):
        before = np.minimum(np.minimum(best, across), up)
        new_up = np.minimum(np.minimum(best, across) + gap_open, up + gap_extend)
        new_up[:, 0] = gap_open + gap_extend * (i - 1)
        new = np.full((k, width + 1), far)
        new[:, 1:] = before[:, :-1] + np.where(x[:, i - 1 : i] == y, match, mismatch)
        new_across = np.full((k, width + 1), far)
        for j in range(1, width + 1):
            new_across[:, j] = np.minimum(np.minimum(new[:, j - 1], new_up[:, j - 1]) + gap_open, new_across[:, j - 1] + gap_extend)
        best, up, across = new, new_up, new_across
        out = np.where(n == i, end(), out)
    return np.where(n + m > 0, out / np.maximum(n + m, 1), 0.0)


def affine_similarity(pairs: DataFrame, a: str, b: str, out: str = "affine") -> DataFrame:
    """Distance of two text columns in Arrow batches, a batch at a time; null where either is."""

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        some = (x.notna() & y.notna()).to_numpy()
        got = np.full(len(x), np.nan)
        order = np.flatnonzero(some)
        order = order[np.argsort((x[some].str.len() + y[some].str.len()).to_numpy(), kind="stable")]
        for k in range(0, len(order), 512):  # of like lengths, so that little is padded
            part = order[k : k + 512]
            got[part] = affine_distances(x.iloc[part].tolist(), y.iloc[part].tolist())
        return pd.Series(got).astype("Float64").mask(~some)

    return pairs.withColumn(out, distance(a, b))


def token_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, weight, df: tf-idf of unit length per record."""
    counts = df.select(key, F.explode(tokens(text)).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))
    frequency = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rows = df.select(F.count(F.lit(1)).alias("rows"))
    raw = counts.join(frequency, "token").join(F.broadcast(rows)).withColumn("w", F.col("tf") * F.log(F.col("rows") / F.col("df")))
    length = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(length, key).where("len > 0").select(key, "token", (F.col("w") / F.col("len")).alias("weight"), "df")


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """set, t, token: the rarest tokens of each class, one of which any two classes at ``least`` or more have in common."""
    df = sets.select(F.explode("set").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = sets.select("set", F.explode("set").alias("token")).join(df, "token").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
    size = F.size("r")
    return ranked.select("set", F.explode(F.slice("r", F.lit(1), (size - F.ceil(least * size - F.lit(1e-9)) + 1).cast("int"))["token"]).alias("token"))


def jaccard_classes(sets: DataFrame, least: float) -> DataFrame:
    """a, b, similarity for pairs of token sets (``set``: sorted distinct tokens, none empty) at ``least`` or more, each with itself too."""
    p = _prefixes(sets, least)
    a, b = p.select(F.col("set").alias("a"), "token"), p.select(F.col("set").alias("b"), "token")
    small, large = F.least(F.size("a"), F.size("b")), F.greatest(F.size("a"), F.size("b"))
    met = a.join(b, "token").where((F.col("a") < F.col("b")) & (small >= least * large - 1e-9)).select("a", "b").distinct()
    shared = F.size(F.array_intersect("a", "b"))
    found = met.withColumn("similarity", shared / (F.size("a") + F.size("b") - shared)).where(F.col("similarity") >= least)
    return found.unionByName(sets.select(F.col("set").alias("a"), F.col("set").alias("b"), F.lit(1.0).alias("similarity")))


def jaccard_pairs(df: DataFrame, key: str, block: str, words: Column, least: float) -> DataFrame:
    """id1 < id2, similarity of records of one block whose distinct tokens are alike to ``least`` or more.

    Records without a token or a block have no pair.  Token sets are compared once, whatever the number of records and
    blocks that have them; joining the members back costs no more than the pairs that are returned.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(block).alias("_b"), F.array_sort(F.array_distinct(words)).alias("set")).where("_b IS NOT NULL AND size(set) > 0")
    near = jaccard_classes(rows.select("set").distinct(), least)
    both = near.union(near.where("a <> b").select("b", "a", "similarity"))
    left = rows.select(F.col("_k").alias("id1"), "_b", F.col("set").alias("a")).join(both, "a")
    return left.join(rows.select(F.col("_k").alias("id2"), "_b", F.col("set").alias("b")), ["_b", "b"]).where("id1 < id2").select("id1", "id2", "similarity")


def cosine_classes(df: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """key, class_id, links: the class of records with equal tf-idf vectors (its smallest key), and how many other records
    are at a cosine of ``least`` or more, copies included.

    Records without weight (no token, or only tokens that every record has) are in no class and left out.  In an order of
    tokens that all classes share (rarest first), the first token that two unit vectors at ``least`` have in common cannot
    lie in the rest of either, where squares sum to less than ``least`` squared; so each class is indexed by the tokens
    before that rest alone.  The cosine is then taken over all tokens.
    """
    w = token_weights(df, key, text)
    vectors = w.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_list(F.struct("df", "token", F.round("weight", 12).alias("w")))).alias("v"))
    classes = vectors.groupBy("v").agg(F.min("_k").alias("class_id"), F.count(F.lit(1)).alias("n"))
    rest = F.expr(f"filter(transform(v, (x, i) -> struct(x.token AS token, aggregate(slice(v, i + 1, size(v)), 0D, (s, y) -> s + y.w * y.w) AS rest)), x -> x.rest >= {least * least - 1e-9!r}D)")
    indexed = classes.withColumn("p", rest)
    a = indexed.select(F.col("class_id").alias("a"), F.explode("p.token").alias("token"))
    met = a.join(a.withColumnRenamed("a", "b"), "token").where("a < b").select("a", "b").distinct()
    flat = classes.select("class_id", F.explode("v").alias("x")).select("class_id", "x.token", "x.w")
    one = met.join(flat.select(F.col("class_id").alias("a"), "token", F.col("w").alias("w1")), "a")
    pairs = one.join(flat.select(F.col("class_id").alias("b"), "token", F.col("w").alias("w2")), ["b", "token"]).groupBy("a", "b").agg(F.sum(F.col("w1") * F.col("w2")).alias("c")).where(F.col("c") >= least)
    links = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("_o")).union(pairs.select("b", "a"))
    others = links.join(classes.select(F.col("class_id").alias("_o"), F.col("n").alias("_m")), "_o").groupBy("class_id").agg(F.sum("_m").alias("_m"))
    summed = classes.join(others, "class_id", "left").select("v", "class_id", (F.col("n") - 1 + F.coalesce("_m", F.lit(0))).alias("links"))
    return vectors.join(summed, "v").select(F.col("_k").alias(key), "class_id", "links")


def sorted_neighbourhood(df: DataFrame, key: str, order: str, window: int) -> DataFrame:
    """id1, id2 of rows at most ``window`` - 1 positions apart in the given order: an equi-join on position."""
    from .relational import numbered

    n = numbered(df, order, key)
    left = n.select(F.col(key).alias("id1"), F.explode(F.sequence(F.col("rid") + 1, F.col("rid") + window - 1)).alias("at"))
    return left.join(n.select(F.col(key).alias("id2"), F.col("rid").alias("at")), "at").select("id1", "id2")


def precision_recall(pairs: DataFrame, score: str, positive: str, total_true: int) -> DataFrame:
    """threshold, precision, recall, f_measure for every distinct score."""
    from .evaluation import threshold_counts

    c = threshold_counts(pairs, positive, score)
    p = F.col("tp") / (F.col("tp") + F.col("fp"))
    r = F.col("tp") / F.lit(max(total_true, 1))
    return c.select("threshold", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)), 6).alias("f_measure"))


def blocking_quality(pairs: DataFrame, truth: DataFrame, rows: int) -> DataFrame:
    """candidates, found, true, recall, precision and reduction of candidate pairs (id1, id2) against true pairs."""
    hit = pairs.join(truth, ["id1", "id2"]).agg(F.count(F.lit(1)).alias("found"))
    n, t = pairs.agg(F.count(F.lit(1)).alias("candidates")), truth.agg(F.count(F.lit(1)).alias("true_pairs"))
    all_pairs = max(rows * (rows - 1) / 2, 1)
    return hit.join(F.broadcast(n)).join(F.broadcast(t)).select(
        "candidates", "found", "true_pairs", F.round(F.col("found") / F.greatest("true_pairs", F.lit(1)), 6).alias("recall"),
        F.round(F.col("found") / F.greatest("candidates", F.lit(1)), 6).alias("precision"), F.round(1 - F.col("candidates") / F.lit(float(all_pairs)), 6).alias("reduction"),
    )
