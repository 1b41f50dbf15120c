"""Rule learners: tests are chosen from counts of the rows that a rule still covers, one aggregation a test.

A rule is a list of tests (attribute, kind, code) and a class; a list of rules compiles to one CASE.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import Coding, Model, Regressor, cell_counts, class_counts, classes_of, coded, constant
from .rows import uniform
from .trees import grow, numbered_leaves, weight_of

Test = tuple[int, str, int]


@dataclass
class Rule:
    """``tests``: (attribute, '=' or '<=' or '>', code); a missing value fails every test."""

    label: str
    tests: list[Test] = field(default_factory=list)

    def covers(self, codings: list[Coding]) -> Column:
        out = F.lit(True)
        for a, kind, i in self.tests:
            out = out & F.coalesce(codings[a].test(kind, i), F.lit(False))
        return out

    def text(self, codings: list[Coding]) -> str:
        say = lambda a, kind, i: f"{codings[a].column} {kind} {codings[a].labels[i] if kind == '=' else format(codings[a].cuts[i], '.6g')}"
        return " and ".join(say(*t) for t in self.tests) + f" => {self.label}"


@dataclass
class RuleList:
    rules: list[Rule]
    codings: list[Coding]
    classes: list[str]
    default: str

    def model(self) -> Model:
        one = lambda label: F.array(*[F.lit(float(c == label)) for c in self.classes])
        out: Column | None = None
        for r in self.rules:
            hit = r.covers(self.codings)
            out = F.when(hit, one(r.label)) if out is None else out.when(hit, one(r.label))
        return Model(self.classes, one(self.default) if out is None else out.otherwise(one(self.default)))

    def texts(self) -> list[str]:
        return [r.text(self.codings) for r in self.rules] + [f"=> {self.default}"]


def stats_of_tests(table: list[np.ndarray], codings: list[Coding]) -> list[tuple[Test, np.ndarray]]:
    """Every test with the class weights of the rows that pass it."""
    out = []
    for a, c in enumerate(codings):
        known = table[a][:-1]
        if c.labels is not None:
            out += [((a, "=", i), known[i]) for i in range(c.size)]
        else:
            left = np.cumsum(known, axis=0)[:-1]
            out += [((a, "<=", i), x) for i, x in enumerate(left)] + [((a, ">", i), known.sum(axis=0) - x) for i, x in enumerate(left)]
    return out


def grow_rule(df: DataFrame, rule: Rule, codings: list[Coding], label: str, classes: list[str], merit: Callable[[np.ndarray, np.ndarray, int], float], stop: Callable[[np.ndarray, int], bool], most: int = 10, weight: Column | None = None) -> Rule:
    """Adds the test of the largest merit (the first on ties) until ``stop`` or nothing gains."""
    y = classes.index(rule.label)
    tests = list(rule.tests)
    while len(tests) < most:
        here = Rule(rule.label, tests).covers(codings)
        tables = cell_counts(df.where(here), F.lit(0), codings, label, classes, weight)
        if 0 not in tables:
            break
        before = tables[0][0].sum(axis=0)
        if stop(before, y):
            break
        used = {a for a, kind, _ in tests if kind == "="}
        options = [(round(merit(before, s, y), 12), -i, t) for i, (t, s) in enumerate(stats_of_tests(tables[0], codings)) if t[0] not in used and t not in tests and s.sum() > 0]
        if not options or max(options)[0] <= 1e-12:
            break
        tests.append(max(options)[2])
    return Rule(rule.label, tests)


def foil_gain(before: np.ndarray, after: np.ndarray, y: int) -> float:
    p, n, q, m = after[y], after.sum() - after[y], before[y], before.sum() - before[y]
    return p * (math.log2((p + 1) / (p + n + 1)) - math.log2((q + 1) / (q + m + 1))) if p > 0 else 0.0


def precision(before: np.ndarray, after: np.ndarray, y: int) -> float:
    """Share of the class, then how many it covers."""
    return after[y] / after.sum() + 1e-9 * after[y] - (before[y] / before.sum() + 1e-9 * before[y] if before.sum() else 0) + 1.0 if after.sum() else 0.0


def pure(before: np.ndarray, y: int) -> bool:
    return before.sum() - before[y] <= 0


def prism(df: DataFrame, columns: list[str], label: str, most_rules: int = 50) -> RuleList:
    """For every class, rules of the purest tests until all of its rows are covered."""
    classes, codings = classes_of(df, label), coded(df, columns)
    rules: list[Rule] = []
    for c in classes:
        rest = df
        while len(rules) < most_rules:
            left = class_counts(rest, label, classes)
            if left[classes.index(c)] <= 0:
                break
            rule = grow_rule(rest, Rule(c), codings, label, classes, precision, pure)
            rules.append(rule)
            if not rule.tests:
                break
            rest = rest.where(~(rule.covers(codings) & (F.col(label).cast("string") == c)))
    counts = class_counts(df, label, classes)
    return RuleList(rules, codings, classes, classes[int(counts.argmax())])


def conjunctive_rule(df: DataFrame, columns: list[str], label: str, key: str, most: int = 3, seed: int = 1, folds: int = 3) -> Model:
    """One rule by information gain, pruned on held-out rows; rows outside it get the distribution of the rest."""
    classes, codings = classes_of(df, label), coded(df, columns)
    held = uniform(F.col(key), seed) < 1 / folds
    train, hold = df.where(~held), df.where(held)

    def merit(before: np.ndarray, after: np.ndarray, y: int) -> float:
        from .models import entropy

        rest = before - after
        return float(before.sum() * entropy(before) - after.sum() * entropy(after) - rest.sum() * entropy(rest)) / before.sum() if after.sum() else 0.0

    rule = grow_rule(train, Rule(classes[0]), codings, label, classes, merit, lambda b, y: b.max() >= b.sum(), most)
    best = None
    for k in range(len(rule.tests), -1, -1):
        here = Rule(rule.label, rule.tests[:k]).covers(codings)
        inside, outside = class_counts(train.where(here), label, classes), class_counts(train.where(~here), label, classes)
        h_in, h_out = class_counts(hold.where(here), label, classes), class_counts(hold.where(~here), label, classes)
        right = h_in[inside.argmax()] + (h_out[outside.argmax()] if outside.sum() else 0)
        if best is None or right >= best[0]:
            best = (right, here, inside, outside)
    _, here, inside, outside = best
    outside = outside if outside.sum() else inside
    return Model(classes, F.when(here, F.array(*[F.lit(float(x)) for x in inside])).otherwise(F.array(*[F.lit(float(x)) for x in outside])))


def pruned(rule: Rule, hold: DataFrame, codings: list[Coding], label: str, classes: list[str]) -> Rule:
    """The prefix of the rule's tests with the largest (p - n) / (p + n) on held-out rows, counted for all prefixes at once."""
    y = F.col(label).cast("string") == rule.label
    aggs = []
    for k in range(1, len(rule.tests) + 1):
        here = Rule(rule.label, rule.tests[:k]).covers(codings)
        aggs += [F.count_if(here & y).alias(f"p{k}"), F.count_if(here & ~y).alias(f"n{k}")]
    if not aggs:
        return rule
    r = hold.agg(*aggs).first()
    worth = [((r[f"p{k}"] - r[f"n{k}"]) / max(r[f"p{k}"] + r[f"n{k}"], 1e-9), -k) for k in range(1, len(rule.tests) + 1)]
    return Rule(rule.label, rule.tests[: -max(worth)[1]])


def ripper(df: DataFrame, columns: list[str], label: str, key: str, seed: int = 1, folds: int = 3, most_rules: int = 30, rounds: int = 1) -> RuleList:
    """Rare classes first: rules grown by FOIL gain on two thirds of the rows and pruned on the rest, while a rule is right
    more often than not; then each rule is grown anew in the presence of the others, and the better one stays."""
    classes, codings = classes_of(df, label), coded(df, columns)
    counts = class_counts(df, label, classes)
    order = [classes[i] for i in np.argsort(counts, kind="stable")]
    held = lambda r: uniform(F.concat_ws("/", F.col(key).cast("string"), F.lit(r)), seed) < 1 / folds

    def one(rest: DataFrame, c: str, turn: int) -> Rule | None:
        rule = grow_rule(rest.where(~held(turn)), Rule(c), codings, label, classes, foil_gain, pure)
        rule = pruned(rule, rest.where(held(turn)), codings, label, classes)
        if not rule.tests:
            return None
        got = class_counts(rest.where(rule.covers(codings)), label, classes)
        return rule if got[classes.index(c)] * 2 > got.sum() else None

    rules: list[Rule] = []
    rest = df
    for c in order[:-1]:
        while len(rules) < most_rules and (rule := one(rest, c, len(rules))):
            rules.append(rule)
            rest = rest.where(~rule.covers(codings))
    for turn in range(rounds):
        for i, rule in enumerate(rules):
            others = rules[:i] + rules[i + 1 :]
            outside = df
            for o in others:
                outside = outside.where(~o.covers(codings))
            new = one(outside, rule.label, 1000 + turn * most_rules + i)
            if new:
                worth = lambda r: (lambda g: 2 * g[classes.index(r.label)] - g.sum())(class_counts(outside.where(r.covers(codings)), label, classes))
                if worth(new) > worth(rule):
                    rules[i] = new
    return RuleList(rules, codings, classes, order[-1])


def ripple_down(df: DataFrame, columns: list[str], label: str, key: str, depth: int = 3, most: int = 20, seed: int = 1) -> Model:
    """The commonest class, and rules for its exceptions, each with rules for their own exceptions."""
    classes, codings = classes_of(df, label), coded(df, columns)

    def build(rows: DataFrame, level: int) -> Column | None:
        counts = class_counts(rows, label, classes)
        if counts.sum() <= 0:
            return None
        default = int(counts.argmax())
        out = F.lit(classes[default])
        if level >= depth or counts.sum() - counts[default] < 2:
            return out
        exceptions: list[tuple[Column, Column]] = []
        rest = rows
        for i in np.argsort(-counts, kind="stable")[1:]:
            for turn in range(most):
                left = class_counts(rest, label, classes)
                if left[i] < 2:
                    break
                held = uniform(F.concat_ws("/", F.col(key).cast("string"), F.lit(f"{level}/{turn}")), seed) < 1 / 3
                rule = pruned(grow_rule(rest.where(~held), Rule(classes[i]), codings, label, classes, foil_gain, pure), rest.where(held), codings, label, classes)
                got = class_counts(rest.where(rule.covers(codings)), label, classes)
                if not rule.tests or got[i] * 2 <= got.sum():
                    break
                here = rule.covers(codings)
                exceptions.append((here, build(rest.where(here), level + 1)))
                rest = rest.where(~here)
        for here, value in reversed(exceptions):
            out = F.when(here, value).otherwise(out)
        return out

    value = build(df, 0)
    return Model(classes, F.array(*[(value == c).cast("double") for c in classes]))


def partial_tree_rules(df: DataFrame, columns: list[str], label: str, most_rules: int = 20, least: float = 2.0, max_depth: int = 4) -> RuleList:
    """A tree of the rows left, its leaf that covers most as a rule, and so on without the rows covered."""
    classes, codings = classes_of(df, label), coded(df, columns)
    rules: list[Rule] = []
    rest = df
    while len(rules) < most_rules:
        root, _ = grow(rest, columns, label, classes=classes, ratio=True, least=least, max_depth=max_depth, codings=codings)
        if not root.children:
            break
        paths: list[tuple[float, list[Test], np.ndarray]] = []

        def walk(node, tests: list[Test]) -> None:
            if not node.children:
                paths.append((weight_of(node.stats), tests, node.stats))
                return
            for i, c in enumerate(node.children):
                walk(c, [*tests, (node.attribute, "=", i) if node.at is None else (node.attribute, "<=" if i == 0 else ">", node.at)])

        walk(root, [])
        _, tests, stats = max(paths, key=lambda p: (p[0], -len(p[1])))
        rule = Rule(classes[int(stats.argmax())], tests)
        rules.append(rule)
        rest = rest.where(~rule.covers(codings))
        if class_counts(rest, label, classes).sum() < 2 * least:
            break
    counts = class_counts(rest, label, classes)
    counts = counts if counts.sum() else class_counts(df, label, classes)
    return RuleList(rules, codings, classes, classes[int(counts.argmax())])


def model_rules(df: DataFrame, columns: list[str], label: str, most_rules: int = 6, max_depth: int = 3, least: float = 20.0) -> Regressor:
    """The leaf of a regression tree that covers most, with a linear model, as a rule; and so on without the rows covered."""
    from .trees import model_tree

    codings = coded(df, columns)
    parts: list[tuple[Column, Column]] = []
    rest = df
    for _ in range(most_rules):
        root, _ = grow(rest, columns, label, classes=None, max_depth=max_depth, least=least, codings=codings)
        leaves, at = numbered_leaves(root, codings)
        heaviest = int(np.argmax([weight_of(x.stats) for x in leaves]))
        here = at == heaviest if root.children else F.lit(True)
        parts.append((here, model_tree(rest.where(here), columns, label, max_depth=0).value))
        rest = rest.where(~here)
        if not root.children or rest.limit(1).count() == 0:
            break
    value = parts[-1][1]
    for here, v in reversed(parts[:-1]):
        value = F.when(here, v).otherwise(value)
    return Regressor(value)


def decision_table(df: DataFrame, columns: list[str], label: str) -> tuple[DataFrame, str]:
    """The table of the columns' values with their commonest class (first on ties), and the class for rows it lacks."""
    y = F.col(label).cast("string")
    counts = df.where(F.col(label).isNotNull()).groupBy(*columns, y.alias("_y")).count()
    table = counts.groupBy(*columns).agg(F.min_by("_y", F.struct(-F.col("count"), F.col("_y"))).alias("prediction"))
    overall = counts.groupBy("_y").agg(F.sum("count").alias("n")).agg(F.min_by("_y", F.struct(-F.col("n"), F.col("_y")))).first()[0]
    return table, overall


def look_up(df: DataFrame, table: DataFrame, default: str, columns: list[str]) -> DataFrame:
    """Rows with the table's prediction: a null-safe equi-join on the columns."""
    renamed = table.select(*[F.col(c).alias(f"_t_{c}") for c in columns], "prediction")
    on = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in columns]
    joined = df.join(renamed, on, "left") if on else df.join(F.broadcast(renamed))
    return joined.withColumn("prediction", F.coalesce("prediction", F.lit(default))).drop(*[f"_t_{c}" for c in columns])


def table_accuracy(df: DataFrame, columns: list[str], label: str) -> float:
    """Leave-one-out share of right answers of the decision table, from counts alone."""
    y = F.col(label).cast("string")
    counts = df.where(F.col(label).isNotNull()).groupBy(*columns, y.alias("_y")).count()
    cells = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "_y")))
    groups = counts.groupBy(*columns).agg(cells.alias("c")) if columns else counts.agg(cells.alias("c"))
    # Taking one row out leaves its class ahead unless the next class has as many.
    best, second = -F.col("c")[0]["n"], F.coalesce(-F.try_element_at("c", F.lit(2))["n"], F.lit(0))
    right = F.when(best - 1 > second, best).when((best - 1 == second) & (F.size("c") > 1), best * (F.col("c")[0]["_y"] < F.try_element_at("c", F.lit(2))["_y"]).cast("long")).when(F.size("c") == 1, F.when(best > 1, best).otherwise(0)).otherwise(0)
    r = groups.agg(F.sum(right).alias("right"), F.sum(F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s - x["n"])).alias("n")).first()
    return float(r["right"] or 0) / max(1, r["n"] or 0)


def rule_stats(df: DataFrame, rules: RuleList, label: str) -> DataFrame:
    """rule, covered, right, wrong of each rule on the rows that no earlier rule covers, in one pass."""
    number = F.lit(len(rules.rules))
    for i in range(len(rules.rules) - 1, -1, -1):
        number = F.when(rules.rules[i].covers(rules.codings), F.lit(i)).otherwise(number)
    names = F.array(*[F.lit(r.label) for r in rules.rules], F.lit(rules.default))
    hit = F.col(label).cast("string") == names[F.col("rule")]
    rows = df.where(F.col(label).isNotNull()).withColumn("rule", number)
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("covered"), F.count_if(hit).alias("right"), F.count_if(~hit).alias("wrong"))


def nested_exemplars(df: DataFrame, columns: list[str], label: str, per_class: int = 8) -> Model:
    """Boxes of the class: each class is cut along its widest attribute into boxes, and a row takes the class of the nearest
    box (0 inside), the one of most rows on ties.  The boxes' bounds come from two aggregations."""
    classes = classes_of(df, label)
    data = df.where(F.col(label).isNotNull()).dropna(subset=columns)
    row = data.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("z", F.max))]).first()
    if row["a0"] is None:
        return constant(classes, class_counts(df, label, classes))
    low, span = [row[f"a{i}"] for i in range(len(columns))], [max(row[f"z{i}"] - row[f"a{i}"], 1e-12) for i in range(len(columns))]
    x = [(F.col(c).cast("double") - a) / s for c, a, s in zip(columns, low, span)]
    spread = data.groupBy(F.col(label).cast("string").alias("y")).agg(*[(F.stddev_pop(t)).alias(f"s{i}") for i, t in enumerate(x)], *[F.percentile_approx(t, [k / per_class for k in range(1, per_class)], 1000).alias(f"q{i}") for i, t in enumerate(x)]).collect()
    cell = F.lit(0)
    for r in spread:
        widest = max(range(len(columns)), key=lambda i: (r[f"s{i}"] or 0, -i))
        cuts = sorted(set(r[f"q{widest}"] or []))
        cell = F.when(F.col(label).cast("string") == r["y"], sum(((x[widest] > q).cast("int") for q in cuts), F.lit(0))).otherwise(cell)
    boxes = data.groupBy(F.col(label).cast("string").alias("y"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), *[f(t).alias(f"{n}{i}") for i, t in enumerate(x) for n, f in (("a", F.min), ("z", F.max))]).collect()
    options = []
    for b in sorted(boxes, key=lambda b: (b["y"], b["cell"])):
        d = F.lit(0.0)
        for i, t in enumerate(x):
            gap = F.greatest(F.lit(b[f"a{i}"]) - t, t - F.lit(b[f"z{i}"]), F.lit(0.0))
            d = d + F.coalesce(gap * gap, F.lit(1.0))
        options.append(F.struct(F.round(d, 12).alias("d"), F.lit(-b["n"]).alias("n"), F.lit(classes.index(b["y"])).alias("y")))
    best = F.array_min(F.array(*options))["y"]
    return Model(classes, F.array(*[(best == i).cast("double") for i in range(len(classes))]))
