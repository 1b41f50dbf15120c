"""Merit of attributes from contingency counts.

All attributes are counted in one pass: (attribute, value, class, n) is the only thing that is shuffled, after a map-side
combine, and every measure is an aggregation of that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.measures import xlogx


def contingency(df: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """attribute, value, label, n; rows with a null class are left out, a null value is a value of its own."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    long = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.explode(pairs).alias("x"))
    return long.select("x.attribute", "x.value", "label").groupBy("attribute", "value", "label").agg(F.count(F.lit(1)).alias("n"))


def _entropies(counts: DataFrame) -> DataFrame:
    """attribute with total, entropies of class, attribute and both."""
    total = counts.groupBy("attribute").agg(F.sum("n").alias("total"), F.sum(xlogx(F.col("n"))).alias("joint"))
    by_class = counts.groupBy("attribute", "label").agg(F.sum("n").alias("n")).groupBy("attribute").agg(F.sum(xlogx(F.col("n"))).alias("cls"))
    by_value = counts.groupBy("attribute", "value").agg(F.sum("n").alias("n")).groupBy("attribute").agg(F.sum(xlogx(F.col("n"))).alias("val"))
    t = total.join(by_class, "attribute").join(by_value, "attribute")
    entropy = lambda c: F.log2("total") - F.col(c) / F.col("total")
    return t.select("attribute", "total", entropy("cls").alias("h_class"), entropy("val").alias("h_value"), entropy("joint").alias("h_joint"))


def entropy_merits(df: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """attribute, info_gain, gain_ratio, symmetrical_uncertainty; ratios are 0 where the denominator is."""
    e = _entropies(contingency(df, attributes, label))
    gain = F.col("h_class") + F.col("h_value") - F.col("h_joint")
    ratio = F.when(F.col("h_value") > 1e-12, gain / F.col("h_value")).otherwise(F.lit(0.0))
    both = F.col("h_class") + F.col("h_value")
    return e.select("attribute", F.round(gain, 6).alias("info_gain"), F.round(ratio, 6).alias("gain_ratio"), F.round(F.when(both > 1e-12, 2 * gain / both).otherwise(F.lit(0.0)), 6).alias("symmetrical_uncertainty"))


def chi_squared(df: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """attribute, chi_squared, cramers_v.  Uses sum n^2 / (row * column) * total - total, so empty cells need no row."""
    counts = contingency(df, attributes, label)
    rows = counts.groupBy("attribute", "value").agg(F.sum("n").alias("r"))
    cols = counts.groupBy("attribute", "label").agg(F.sum("n").alias("c"))
    totals = counts.groupBy("attribute").agg(F.sum("n").alias("total"), F.count_distinct(F.coalesce("value", F.lit("\x00"))).alias("nr"), F.count_distinct("label").alias("nc"))
    cells = counts.join(rows.withColumnRenamed("value", "_v"), (counts["attribute"] == rows["attribute"]) & F.col("value").eqNullSafe(F.col("_v"))).drop(rows["attribute"]).join(cols, ["attribute", "label"])
    s = cells.groupBy("attribute").agg(F.sum(F.col("n").cast("double") / F.col("r") * F.col("n") / F.col("c")).alias("s")).join(totals, "attribute")
    chi = F.col("total") * (F.col("s") - 1)
    least = F.least("nr", "nc") - 1
    return s.select("attribute", F.round(chi, 4).alias("chi_squared"), F.round(F.when(least > 0, F.sqrt(F.greatest(chi, F.lit(0.0)) / (F.col("total") * least))).otherwise(F.lit(0.0)), 6).alias("cramers_v"))


def one_rule(df: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """attribute, correct, total: what a rule of the commonest class for each value gets right on its own rows."""
    counts = contingency(df, attributes, label)
    best = counts.groupBy("attribute", "value").agg(F.max("n").alias("best"), F.sum("n").alias("n"))
    return best.groupBy("attribute").agg(F.sum("best").alias("correct"), F.sum("n").alias("total"))


def consistency(df: DataFrame, subset: list[str], label: str) -> DataFrame:
    """1 minus the share of rows that are not of the commonest class among equal rows of the subset."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*subset, label).count()
    best = counts.groupBy(*subset).agg(F.max("count").alias("best"), F.sum("count").alias("n"))
    return best.agg(F.round(F.sum("best") / F.sum("n"), 6).alias("consistency"))


def pair_uncertainties(df: DataFrame, attributes: list[str], label: str) -> dict[tuple[str, str], float]:
    """Symmetrical uncertainty of every pair of attributes, and of each with the class (a bounded number of pairs)."""
    out: dict[tuple[str, str], float] = {}
    for i, a in enumerate(attributes):
        for r in entropy_merits(df, [*attributes[i + 1 :], label], a).collect():
            out[a, r["attribute"]] = out[r["attribute"], a] = r["symmetrical_uncertainty"]
    return out


def cfs_merit(subset: list[str], label: str, pairs: dict[tuple[str, str], float]) -> float:
    k = len(subset)
    if not k:
        return 0.0
    with_class = sum(pairs[a, label] for a in subset)
    among = sum(pairs[a, b] for i, a in enumerate(subset) for b in subset[i + 1 :])
    below = (k + 2 * among) ** 0.5
    return with_class / below if below else 0.0


def forward_selection(attributes: list[str], merit) -> list[str]:
    """Greedy: adds the attribute that raises the merit most (first on ties) until none does."""
    chosen: list[str] = []
    best = merit(chosen)
    while rest := [a for a in attributes if a not in chosen]:
        value, _, a = max((merit([*chosen, a]), -attributes.index(a), a) for a in rest)
        if value <= best + 1e-12:
            break
        chosen, best = [*chosen, a], value
    return chosen


def exhaustive_selection(attributes: list[str], merit) -> list[str]:
    from itertools import combinations

    subsets = [list(s) for k in range(len(attributes) + 1) for s in combinations(attributes, k)]
    return max(subsets, key=lambda s: (merit(s), -len(s)))
