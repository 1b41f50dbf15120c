"""More associations: rules for a class, rules by expected accuracy, and confirmation of clauses."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def items(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """basket, item: 'column=value' of every value that is there."""
    pairs = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in columns])
    return df.select(F.col(key).alias("basket"), F.explode(F.array_compact(pairs)).alias("item"))


def cell_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by their values: what every support is a sum of, so a search over rules never scans the rows again."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))


def _conditions(df: DataFrame, columns: list[str], most: int) -> list[tuple[str, str]]:
    out = []
    for c in columns:
        labels = [r[0] for r in df.where(F.col(c).isNotNull()).select(F.col(c).cast("string")).distinct().limit(most + 1).collect()]
        if len(labels) > most:
            raise ValueError(f"{c} has more than {most} labels")
        out += [(c, x) for x in sorted(labels)]
    return out


def supports(df: DataFrame, columns: list[str], size: int) -> DataFrame:
    """items (sorted 'column=value', joined by '|') with their support, for all sets of up to ``size`` columns: one pass
    over the distinct cells with partial sums."""
    cells = cell_counts(df, columns)
    sets = [F.array_join(F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in s]), "|") for k in range(1, size + 1) for s in itertools.combinations(sorted(columns), k)]
    return cells.select("_n", F.explode(F.array_compact(F.array(*sets))).alias("items")).groupBy("items").agg(F.sum("_n").alias("support"))


def class_rules(df: DataFrame, columns: list[str], label: str, size: int = 2, least_support: float = 0.1, least_confidence: float = 0.5) -> DataFrame:
    """premise, label, support, confidence of rules whose consequence is a class."""
    rows = df.where(F.col(label).isNotNull())
    cells = rows.groupBy(*columns, F.col(label).cast("string").alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    sets = [F.array_join(F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in s]), "|") for k in range(1, size + 1) for s in itertools.combinations(sorted(columns), k)]
    long = cells.select("_y", "_n", F.explode(F.array_compact(F.array(*sets))).alias("premise"))
    both = long.groupBy("premise", "_y").agg(F.sum("_n").alias("support"))
    alone = long.groupBy("premise").agg(F.sum("_n").alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("t"))
    out = both.join(alone, "premise").join(F.broadcast(total)).where(F.col("support") >= least_support * F.col("t"))
    confidence = F.col("support") / F.col("n")
    return out.where(confidence >= least_confidence).select("premise", F.col("_y").alias("label"), "support", F.round(confidence, 6).alias("confidence"))


def accuracy_prior(table: list[tuple[int, int]], bins: int = 100) -> list[float]:
    """The share of rules whose confidence lies in each bin, from counts (support of premise, of both); no bin is empty."""
    counts = [1.0] * bins
    for n, k in table:
        if n:
            counts[min(bins - 1, int(k / n * bins))] += 1
    return [c / sum(counts) for c in counts]


def expected_accuracy(n: int, k: int, prior: list[float]) -> float:
    """The mean accuracy of a rule that is right on k of n rows, given how accuracies are spread beforehand."""
    bins = len(prior)
    logs = []
    for i, p in enumerate(prior):
        c = (i + 0.5) / bins
        logs.append(math.log(p) + k * math.log(c) + (n - k) * math.log(1 - c))
    top = max(logs)
    weights = [math.exp(x - top) for x in logs]
    return sum(w * (i + 0.5) / bins for i, w in enumerate(weights)) / sum(weights)


def predictive_rules(df: DataFrame, columns: list[str], best: int = 10, size: int = 2) -> DataFrame:
    """premise, consequence, n, k, accuracy of the ``best`` rules by expected accuracy; of equal ones the more general.

    Supports of all item sets come from one aggregation; the rules among them are scored on the driver (their number is
    bounded by the labels of the columns, not by rows).
    """
    found = {tuple(r["items"].split("|")): r["support"] for r in supports(df, columns, size + 1).collect()}
    rules = []
    for whole, k in found.items():
        for y in whole:
            premise = tuple(x for x in whole if x != y)
            if premise:
                rules.append((premise, y, found[premise], k))
    prior = accuracy_prior([(n, k) for _, _, n, k in rules])
    scored = sorted(((round(expected_accuracy(n, k, prior), 9), -len(p), p, y, n, k) for p, y, n, k in rules), key=lambda r: (-r[0], -r[1], r[2], r[3]))[:best]
    return df.sparkSession.createDataFrame([("|".join(p), y, n, k, round(a, 6)) for a, _, p, y, n, k in scored], "premise string, consequence string, n long, k long, accuracy double")


def confirmation(total: float, body: float, head: float, counter: float) -> float:
    """How far counterexamples fall short of what independence would give, in units of what they could be."""
    expected = body * (total - head) / (total * total)
    observed = counter / total
    below = math.sqrt(expected) - expected
    return (expected - observed) / below if below > 1e-12 else 0.0


def confirmed_rules(df: DataFrame, columns: list[str], best: int = 10, size: int = 2, most_noise: float = 1.0, negate: bool = False, least_count: int = 1) -> DataFrame:
    """body, head, confirmation, counter: the ``best`` clauses 'body implies head' by confirmation, with bodies of up to
    ``size`` literals ('column=value', with ``negate`` also 'column!=value'), of one column each.

    All counts are sums over the distinct cells, which one aggregation gives.
    """
    rows = [(tuple(None if r[c] is None else str(r[c]) for c in columns), r["_n"]) for r in cell_counts(df, columns).collect()]
    total = sum(n for _, n in rows)
    literals = [(i, x, True) for i, c in enumerate(columns) for x in sorted({r[0][i] for r in rows if r[0][i] is not None})]
    literals += [(i, x, False) for i, x, _ in literals] if negate else []
    holds = lambda r, lit: r[lit[0]] is not None and (r[lit[0]] == lit[1]) == lit[2]
    say = lambda lit: f"{columns[lit[0]]}{'=' if lit[2] else '!='}{lit[1]}"
    out = []
    for k in range(1, size + 1):
        for body in itertools.combinations(literals, k):
            if len({x[0] for x in body}) < k:
                continue
            inside = [(r, n) for r, n in rows if all(holds(r, x) for x in body)]
            count = sum(n for _, n in inside)
            if count < least_count:
                continue
            for head in literals:
                if head[0] in {x[0] for x in body}:
                    continue
                counter = sum(n for r, n in inside if not holds(r, head))
                if counter / total > most_noise:
                    continue
                c = confirmation(total, count, sum(n for r, n in rows if holds(r, head)), counter)
                out.append((-round(c, 9), k, " and ".join(map(say, body)), say(head), counter))
    out.sort()
    return df.sparkSession.createDataFrame([(b, h, round(-c, 6), n) for c, _, b, h, n in out[:best]], "body string, head string, confirmation double, counter long")


def of_individuals(parts: DataFrame, owner: str, columns: list[str]) -> DataFrame:
    """Rows of parts as one row for each owner: for each column the sorted labels that some part has, as text."""
    return parts.groupBy(owner).agg(*[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(c) for c in columns])


def exists_literals(parts: DataFrame, owner: str, column: str, labels: list[str]) -> DataFrame:
    """owner with a 0/1 column for each label: whether a part of the owner has it."""
    return parts.groupBy(owner).agg(*[F.max((F.col(column) == x).cast("int")).alias(f"{column}={x}") for x in labels])


def literal_labels(df: DataFrame, columns: list[str], most: int = 100) -> list[tuple[str, str]]:
    return _conditions(df, columns, most)
