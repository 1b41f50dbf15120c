"""Trees that grow a level at a time: one aggregation counts all open nodes, the driver picks the splits.

A grown tree is compiled to one nested CASE that gives the number of the leaf, and an array of what the leaves hold.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import Coding, Model, Regressor, adding, cell_counts, cell_moments, classes_of, coded, entropy, let
from .relational import cut
from .rows import uniform


@dataclass
class Node:
    """Statistics of a node, and its split: by every label, or at a code of an ordered attribute."""

    stats: np.ndarray
    used: frozenset[int] = frozenset()
    attribute: int | None = None
    at: int | None = None
    children: list["Node"] = field(default_factory=list)
    number: int = -1

    def leaves(self) -> list["Node"]:
        return [self] if not self.children else [x for c in self.children for x in c.leaves()]

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def depth(self) -> int:
        return 1 + max((c.depth() for c in self.children), default=0)

    def heaviest(self) -> int:
        return int(np.argmax([weight_of(c.stats) for c in self.children]))


def weight_of(stats: np.ndarray) -> float:
    return float(stats.sum()) if stats.ndim == 1 else float(stats[0, 0])


def leaf_number(node: Node, codings: list[Coding], number: dict[int, int]) -> Column:
    """The number of the leaf that a row falls into; missing and unknown values follow the heaviest child."""
    if not node.children:
        return F.lit(number[id(node)])
    coding, parts = codings[node.attribute], [leaf_number(c, codings, number) for c in node.children]
    if node.at is not None:
        left = F.coalesce(coding.test("<=", node.at), F.lit(node.heaviest() == 0))
        return F.when(left, parts[0]).otherwise(parts[1])
    out = None
    for i, p in enumerate(parts):
        if i != node.heaviest():
            hit = coding.test("=", i)
            out = F.when(hit, p) if out is None else out.when(hit, p)
    return parts[0] if out is None else out.otherwise(parts[node.heaviest()])


def numbered_leaves(root: Node, codings: list[Coding]) -> tuple[list[Node], Column]:
    leaves = root.leaves()
    return leaves, leaf_number(root, codings, {id(x): i for i, x in enumerate(leaves)})


def _impurity(stats: np.ndarray, numeric: bool) -> np.ndarray:
    """Total impurity: bits for class weights, summed squares about the mean for moments."""
    if numeric:
        w, s, q = stats[..., 0], stats[..., 1], stats[..., 2]
        return np.maximum(q - np.divide(s * s, w, out=np.zeros_like(w), where=w > 0), 0)
    return stats.sum(axis=-1) * entropy(stats)


def best_split(tables: list[np.ndarray], codings: list[Coding], allowed: list[int], numeric: bool, ratio: bool, least: float) -> tuple[float, int, int | None, list[np.ndarray]] | None:
    """(gain, attribute, code or None, statistics of the children) of the split that lowers impurity most."""
    best = None
    for a in allowed:
        known = tables[a][:-1]
        whole = known.sum(axis=0)
        weight = whole[0] if numeric else whole.sum()
        if weight <= 0:
            continue
        if codings[a].labels is not None:
            options = [(None, list(known))]
        else:
            left = np.cumsum(known, axis=0)[:-1]
            options = [(i, [x, whole - x]) for i, x in enumerate(left)]
        for at, children in options:
            sizes = np.array([c[0] if numeric else c.sum() for c in children])
            if (sizes >= least).sum() < 2 or (at is not None and sizes.min() < least):
                continue
            gain = (_impurity(whole, numeric) - sum(_impurity(c, numeric) for c in children)) / weight
            if ratio:
                info = float(entropy(sizes))
                gain = gain / info if info > 1e-12 else 0.0
            key = (round(float(gain), 12), -a, 0 if at is None else -at)
            if gain > 1e-10 and (best is None or key > best[0]):
                best = (key, float(gain), a, at, children)
    return best and best[1:]


def grow(df: DataFrame, columns: list[str], label: str, *, classes: list[str] | None, weight: Column | None = None, max_depth: int = 30, least: float = 1.0, ratio: bool = False, per_node: int | None = None, seed: int = 1, bins: int = 32, codings: list[Coding] | None = None, splits: int | None = None) -> tuple[Node, list[Coding]]:
    """A tree for a class (``classes``) or a number (``classes`` is None), a job for each level.

    ``per_node`` attributes are drawn for each node; ``splits`` bounds how many splits are made in all (best gains first).
    """
    codings = codings or coded(df, columns, bins)
    numeric = classes is None
    rng = random.Random(seed)
    count = (lambda d, n: cell_moments(d, n, codings, label, weight)) if numeric else (lambda d, n: cell_counts(d, n, codings, label, classes, weight))
    width = 3 if numeric else len(classes)
    root = Node(np.zeros((1, 3)) if numeric else np.zeros(width))
    open_nodes, made = [root], 0
    for depth in range(max_depth + 1):
        numbers = {id(x): -1 for x in root.leaves()} | {id(x): i for i, x in enumerate(open_nodes)}
        at = leaf_number(root, codings, numbers)
        tables = count(df, F.when(at >= 0, at))
        wanted = []
        for i, node in enumerate(open_nodes):
            if i not in tables:
                continue
            total = tables[i][0].sum(axis=0)
            node.stats = total[None, :] if numeric else total
            if depth == max_depth:
                continue
            free = [a for a in range(len(codings)) if a not in node.used or codings[a].labels is None]
            chosen = sorted(rng.sample(free, min(per_node, len(free)))) if per_node else free
            if found := best_split(tables[i], codings, chosen, numeric, ratio, least):
                wanted.append((found, node))
        wanted.sort(key=lambda x: -x[0][0] * weight_of(x[1].stats))
        open_nodes = []
        for (gain, a, at_code, stats), node in wanted[: None if splits is None else max(0, splits - made)]:
            made += 1
            node.attribute, node.at = a, at_code
            node.children = [Node(s[None, :] if numeric else s, node.used | {a}) for s in stats]
            open_nodes += [c for c in node.children if weight_of(c.stats) > 0]
        if not open_nodes:
            break
    return root, codings


def _inherit(node: Node, stats: np.ndarray) -> None:
    """Leaves without rows predict as their parent."""
    if not node.children and weight_of(node.stats) <= 0:
        node.stats = stats
    for c in node.children:
        _inherit(c, node.stats)


def tree_model(root: Node, codings: list[Coding], classes: list[str]) -> Model:
    _inherit(root, root.stats)
    leaves, at = numbered_leaves(root, codings)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in n.stats]) for n in leaves])
    return Model(classes, table[at])


def tree_regressor(root: Node, codings: list[Coding]) -> Regressor:
    _inherit(root, root.stats)
    leaves, at = numbered_leaves(root, codings)
    means = [float(n.stats[0, 1] / n.stats[0, 0]) if n.stats[0, 0] > 0 else 0.0 for n in leaves]
    return Regressor(F.array(*[F.lit(m) for m in means])[at])


def as_text(root: Node, codings: list[Coding], classes: list[str] | None = None, indent: str = "") -> str:
    """The tree as indented text."""
    if not root.children:
        return indent + (classes[int(root.stats.argmax())] if classes else f"{root.stats[0, 1] / max(root.stats[0, 0], 1e-12):.6g}") + "\n"
    c = codings[root.attribute]
    names = [f"{c.column} <= {c.cuts[root.at]:.6g}", f"{c.column} > {c.cuts[root.at]:.6g}"] if root.at is not None else [f"{c.column} = {x}" for x in c.labels]
    return "".join(f"{indent}{n}\n" + as_text(x, codings, classes, indent + "  ") for n, x in zip(names, root.children))


def id3(df: DataFrame, columns: list[str], label: str, weight: Column | None = None) -> Model:
    """Splits nominal attributes by information gain until nothing gains; no pruning."""
    classes = classes_of(df, label)
    return tree_model(*grow(df, columns, label, classes=classes, weight=weight), classes)


def _pessimistic(node: Node, z: float) -> float:
    """Errors expected at a node with an upper confidence bound; prunes a split that does not lower them."""
    n = weight_of(node.stats)
    if n <= 0:
        return 0.0
    f = (n - float(node.stats.max())) / n
    own = n * (f + z * z / (2 * n) + z * math.sqrt(f / n - f * f / n + z * z / (4 * n * n))) / (1 + z * z / n)
    if not node.children:
        return own
    below = sum(_pessimistic(c, z) for c in node.children)
    if own <= below + 0.1:
        node.children, node.attribute, node.at = [], None, None
        return own
    return below


def c45(df: DataFrame, columns: list[str], label: str, weight: Column | None = None, confidence: float = 0.25, least: float = 2.0, max_depth: int = 12) -> Model:
    """Gain ratio, ordered splits of numbers, pruned where the pessimistic error does not rise."""
    classes = classes_of(df, label)
    root, codings = grow(df, columns, label, classes=classes, weight=weight, ratio=True, least=least, max_depth=max_depth)
    low, high = 0.0, 8.0  # the normal quantile of 1 - confidence
    for _ in range(60):
        z = (low + high) / 2
        low, high = (z, high) if 0.5 * math.erfc(z / math.sqrt(2)) > confidence else (low, z)
    _pessimistic(root, z)
    return tree_model(root, codings, classes)


def _reduced(node: Node, hold: dict[int, np.ndarray], classes: int) -> tuple[float, np.ndarray]:
    """Errors on held-out counts; a subtree that makes no fewer than its leaf would goes."""
    if not node.children:
        h = hold.get(id(node), np.zeros(classes))
        return float(h.sum() - h[int(node.stats.argmax())]), h
    parts = [_reduced(c, hold, classes) for c in node.children]
    below, h = sum(p[0] for p in parts), sum(p[1] for p in parts)
    own = float(h.sum() - h[int(node.stats.argmax())])
    if own <= below:
        node.children, node.attribute, node.at = [], None, None
        return own, h
    return below, h


def reduced_error_tree(df: DataFrame, columns: list[str], label: str, key: str, weight: Column | None = None, folds: int = 3, seed: int = 1, max_depth: int = 12) -> Model:
    """Grown on folds - 1 parts of the rows by a hash of the key, pruned by the errors on the other part."""
    classes = classes_of(df, label)
    held = uniform(F.col(key), seed) < 1 / folds
    root, codings = grow(df.where(~held), columns, label, classes=classes, weight=weight, least=2.0, max_depth=max_depth)
    leaves, at = numbered_leaves(root, codings)
    counts = df.where(held & F.col(label).isNotNull()).groupBy(at.alias("leaf"), F.col(label).cast("string").alias("y")).count().collect()
    hold: dict[int, np.ndarray] = {}
    for r in counts:
        hold.setdefault(id(leaves[r["leaf"]]), np.zeros(len(classes)))[classes.index(r["y"])] += r["count"]
    _reduced(root, hold, len(classes))
    return tree_model(root, codings, classes)


def random_tree(df: DataFrame, columns: list[str], label: str, weight: Column | None = None, per_node: int | None = None, seed: int = 1, max_depth: int = 20) -> Model:
    classes = classes_of(df, label)
    k = per_node or int(math.log2(len(columns))) + 1
    return tree_model(*grow(df, columns, label, classes=classes, weight=weight, per_node=k, seed=seed, max_depth=max_depth), classes)


def stump(df: DataFrame, columns: list[str], label: str, weight: Column | None = None) -> Model:
    classes = classes_of(df, label)
    return tree_model(*grow(df, columns, label, classes=classes, weight=weight, max_depth=1), classes)


def regression_tree(df: DataFrame, columns: list[str], label: str, weight: Column | None = None, max_depth: int = 6, least: float = 4.0) -> Regressor:
    return tree_regressor(*grow(df, columns, label, classes=None, weight=weight, max_depth=max_depth, least=least))


def _normal_equations(df: DataFrame, node: Column, terms: list[Column], target: Column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums of products for each node, in one aggregation."""
    k = len(terms)
    aggs = [F.sum(terms[i] * terms[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(t * target).alias(f"b{i}") for i, t in enumerate(terms)]
    out = {}
    for r in df.groupBy(node.alias("node")).agg(*aggs).collect():
        out[r["node"]] = (np.array([[r[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]), np.array([r[f"b{i}"] or 0.0 for i in range(k)]))
    return out


def model_tree(df: DataFrame, columns: list[str], label: str, max_depth: int = 3, least: float = 20.0, ridge: float = 1e-6, smooth: float = 15.0) -> Regressor:
    """A regression tree with a linear model of the numeric columns in each leaf, shrunk to the leaf's mean by its size."""
    from .models import numeric

    root, codings = grow(df, columns, label, classes=None, max_depth=max_depth, least=least)
    leaves, at = numbered_leaves(root, codings)
    numbers = [c for c in columns if numeric(df, c)]
    x = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers]]
    fitted = _normal_equations(df.where(F.col(label).isNotNull()), at, x, F.col(label).cast("double"))
    rows = []
    for i, leaf in enumerate(leaves):
        a, b = fitted.get(i, (np.eye(len(x)), np.zeros(len(x))))
        a = a + ridge * np.diag([0.0] + [max(a[j, j], 1.0) for j in range(1, len(x))])
        beta, n = np.linalg.lstsq(a, b, rcond=None)[0], max(a[0, 0], 1.0)
        mean = np.zeros(len(x))
        mean[0] = b[0] / n
        rows.append((n * beta + smooth * mean) / (n + smooth))
    table = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])
    return Regressor(let(table[at], lambda b: sum((b[i] * t for i, t in enumerate(x)), F.lit(0.0))))


def bayes_tree(df: DataFrame, columns: list[str], label: str, max_depth: int = 2, least: float = 30.0) -> Model:
    """A short tree with naive Bayes over the coded attributes in each leaf."""
    classes = classes_of(df, label)
    root, codings = grow(df, columns, label, classes=classes, max_depth=max_depth, least=least)
    leaves, at = numbered_leaves(root, codings)
    tables = cell_counts(df, at, codings, label, classes)
    zero = [np.zeros((c.size + 1, len(classes))) for c in codings]
    logs = []
    for i in range(len(leaves)):
        own = tables.get(i, zero)
        prior = own[0].sum(axis=0)
        logs.append(([float(x) for x in np.log((prior + 1) / (prior.sum() + len(classes)))], [[[float(x) for x in row] for row in np.log((t[:-1] + 1) / (t[:-1].sum(axis=0) + c.size))] for t, c in zip(own, codings)]))
    lit = lambda v: F.array(*[lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    priors = lit([p for p, _ in logs])
    cells = [lit([own[j] for _, own in logs]) for j in range(len(codings))]
    each = lambda leaf: F.array(priors[leaf], *[cells[j][leaf][c.code()] for j, c in enumerate(codings)])
    at_class = lambda y: lambda x: x[y]
    sums = let(let(at, each), lambda parts: F.array(*[F.aggregate(parts, F.lit(0.0), adding(at_class(y))) for y in range(len(classes))]))
    return Model(classes, let(sums, lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))))


def logistic_tree(df: DataFrame, columns: list[str], label: str, max_depth: int = 2, least: float = 30.0, rounds: int = 8, ridge: float = 1.0) -> Model:
    """A short tree with a logistic model of the numeric columns in each leaf, by Newton steps for all leaves at once."""
    from .models import numeric

    classes = classes_of(df, label)
    root, codings = grow(df, columns, label, classes=classes, max_depth=max_depth, least=least)
    leaves, at = numbered_leaves(root, codings)
    numbers = [c for c in columns if numeric(df, c)]
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(numbers) for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    x = [F.lit(1.0), *[F.coalesce((F.col(c).cast("double") - F.lit(row[f"m{i}"] or 0.0)) / F.lit(row[f"s{i}"] or 1.0), F.lit(0.0)) for i, c in enumerate(numbers)]]
    beta = np.zeros((len(leaves), len(classes), len(x)))
    lit = lambda b: F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in b])
    data = cut(df.where(F.col(label).isNotNull()).select(at.alias("_leaf"), F.col(label).cast("string").alias("_y"), *[t.alias(f"_x{i}") for i, t in enumerate(x)]))
    xs = [F.col(f"_x{i}") for i in range(len(x))]
    for _ in range(rounds):
        for k, y in enumerate(classes):
            table = lit(beta[:, k, :])
            p = 1 / (1 + F.exp(-sum((table[F.col("_leaf")][i] * t for i, t in enumerate(xs)), F.lit(0.0))))
            w = F.greatest(p * (1 - p), F.lit(1e-6))
            error = (F.col("_y") == y).cast("double") - p
            aggs = [F.sum(w * xs[i] * xs[j]).alias(f"a{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))] + [F.sum(error * t).alias(f"b{i}") for i, t in enumerate(xs)]
            for r in data.groupBy("_leaf").agg(*aggs).collect():
                h = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(len(xs))] for i in range(len(xs))]) + ridge * np.eye(len(xs))
                beta[r["_leaf"], k] += np.clip(np.linalg.solve(h, np.array([r[f"b{i}"] for i in range(len(xs))]) - ridge * beta[r["_leaf"], k]), -4, 4)
    tables = [lit(beta[:, k, :]) for k in range(len(classes))]
    return Model(classes, let(at, lambda leaf: F.array(*[1 / (1 + F.exp(-sum((t[leaf][i] * v for i, v in enumerate(x)), F.lit(0.0)))) for t in tables])))


def alternating_tree(df: DataFrame, columns: list[str], label: str, rounds: int = 10) -> Model:
    """Boosted rules under preconditions for two classes: every round adds the test, under the precondition, of the least
    Z; a prediction is the sign of the sum of all values that apply."""
    classes = classes_of(df, label)
    if len(classes) != 2:
        raise ValueError("an alternating tree needs two classes")
    codings = coded(df, columns, 16)
    plus = (F.col(label).cast("string") == classes[1]).cast("double")
    data = df.where(F.col(label).isNotNull())
    n = class_counts_two(data, plus)
    total: Column = F.lit(0.5 * math.log((n[1] + 1) / (n[0] + 1)))
    conditions: list[Column] = [F.lit(True)]
    for _ in range(rounds):
        margin = F.when(plus > 0, total).otherwise(-total)
        number = F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)])
        long = data.withColumn("_w", F.exp(-margin)).withColumn("_p", F.explode(F.filter(number, lambda x: x.isNotNull())))
        tables = cell_counts(long, F.col("_p"), codings, label, classes, F.col("_w"))
        whole = float(tables[0][0].sum()) if 0 in tables else 0.0
        best = None
        for p, own in tables.items():
            inside = own[0].sum()
            for a, c in enumerate(codings):
                known = own[a][:-1]
                options = [(i, known[i]) for i in range(c.size)] if c.labels is not None else list(enumerate(np.cumsum(known, axis=0)[:-1]))
                for i, yes in options:
                    no = own[a].sum(axis=0) - yes
                    z = 2 * (math.sqrt(yes[0] * yes[1]) + math.sqrt(no[0] * no[1])) + whole - inside
                    if best is None or (round(z, 12), p, a, i) < best[0]:
                        best = ((round(z, 12), p, a, i), yes, no)
        if best is None:
            break
        (_, p, a, i), yes, no = best
        test = F.coalesce(codings[a].test("=" if codings[a].labels is not None else "<=", i), F.lit(False))
        up, down = (0.5 * math.log((s[1] + 1) / (s[0] + 1)) for s in (yes, no))
        total = total + F.when(conditions[p] & test, F.lit(up)).when(conditions[p], F.lit(down)).otherwise(F.lit(0.0))
        conditions += [conditions[p] & test, conditions[p] & ~test]
    return Model(classes, let(total, lambda t: F.array(1 / (1 + F.exp(2 * t)), 1 / (1 + F.exp(-2 * t)))))


def class_counts_two(data: DataFrame, plus: Column) -> tuple[float, float]:
    r = data.agg(F.sum(1 - plus).alias("a"), F.sum(plus).alias("b")).first()
    return float(r["a"] or 0.0), float(r["b"] or 0.0)
