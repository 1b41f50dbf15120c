"""Bayes networks: structure search over local or cross-validated scores, tables of estimates, XML files, sampling.

A score of a node and its parents is one aggregation of counts, kept in a cache for the whole search, so that searches
differ only in which (node, parents) they ask for.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import labels_of
from .models import Model, let
from .relational import cut

Structure = dict[str, list[str]]


@dataclass
class Scores:
    """Local scores of nodes given parents, from counts; larger is better.  ``kind``: bayes, bdeu, mdl, aic or entropy."""

    df: DataFrame
    nodes: list[str]
    kind: str = "bayes"
    alpha: float = 0.5
    cache: dict[tuple[str, tuple[str, ...]], float] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.df = cut(self.df.select(*[F.col(n).cast("string").alias(n) for n in self.nodes]))
        self.labels = {n: labels_of(self.df, n, 1000) for n in self.nodes}

    def counts(self, node: str, parents: tuple[str, ...]) -> np.ndarray:
        """One row for each combination of the parents' labels that is met, one column a label."""
        rows = self.df.where(F.col(node).isNotNull()).groupBy(*parents, node).count().collect()
        groups: dict[tuple, np.ndarray] = {}
        at = {x: i for i, x in enumerate(self.labels[node])}
        for r in rows:
            groups.setdefault(tuple(r[p] for p in parents), np.zeros(len(at)))[at[r[node]]] = r["count"]
        return np.array([groups[k] for k in sorted(groups, key=repr)]) if groups else np.zeros((1, max(1, len(at))))

    def __call__(self, node: str, parents: list[str] | tuple[str, ...]) -> float:
        key = (node, tuple(sorted(parents)))
        if key not in self.cache:
            n = self.counts(*key)
            k, q = n.shape[1], math.prod(len(self.labels[p]) for p in key[1])
            total = n.sum(axis=1)
            if self.kind in ("bayes", "bdeu"):
                a = self.alpha if self.kind == "bayes" else self.alpha / (k * q)
                lg = np.vectorize(math.lgamma)
                value = float((lg(np.full(len(total), k * a)) - lg(k * a + total)).sum() + (lg(n + a) - math.lgamma(a)).sum())
            else:
                p = np.divide(n, total[:, None], out=np.ones_like(n), where=total[:, None] > 0)
                value = float(np.where(n > 0, n * np.log(np.where(p > 0, p, 1)), 0).sum())
                free = q * (k - 1)
                value -= {"entropy": 0.0, "aic": free, "mdl": free * math.log(max(n.sum(), 1)) / 2}[self.kind]
            self.cache[key] = value
        return self.cache[key]

    def total(self, structure: Structure) -> float:
        return sum(self(n, p) for n, p in structure.items())


@dataclass
class CrossScores:
    """The same interface by cross-validated log loss of a class under the whole structure: a global score."""

    df: DataFrame
    nodes: list[str]
    label: str
    key: str
    folds: int = 3

    def total(self, structure: Structure) -> float:
        from .relational import with_folds

        if not hasattr(self, "_dealt"):
            self._dealt = cut(with_folds(self.df, self.folds, self.key))
            self._seen: dict[str, float] = {}
        key = repr(sorted((n, sorted(p)) for n, p in structure.items()))
        if key not in self._seen:
            loss = 0.0
            for f in range(self.folds):
                m = classifier(tables(self._dealt.where(F.col("fold") != f), structure), structure, self.label)
                p = F.element_at(m.probabilities(), F.array_position(F.array(*[F.lit(x) for x in m.labels]), F.col(self.label).cast("string")).cast("int"))
                loss += float(self._dealt.where(F.col("fold") == f).select(p.alias("p")).agg(F.sum(F.log(F.greatest("p", F.lit(1e-9))))).first()[0] or 0.0)
            self._seen[key] = loss
        return self._seen[key]


def empty(nodes: list[str]) -> Structure:
    return {n: [] for n in nodes}


def naive(nodes: list[str], label: str) -> Structure:
    """Every other node has the class as its parent."""
    return {n: [] if n == label else [label] for n in nodes}


def acyclic(structure: Structure) -> bool:
    left = {n: set(p) for n, p in structure.items()}
    while free := [n for n, p in left.items() if not p]:
        for n in free:
            del left[n]
        for p in left.values():
            p.difference_update(free)
    return not left


def moves(structure: Structure, most_parents: int, reverse: bool = True) -> list[Structure]:
    """All structures one arc away: an arc more, less, or turned round."""
    out = []
    for a, b in itertools.permutations(structure, 2):
        if a in structure[b]:
            less = structure | {b: [p for p in structure[b] if p != a]}
            out.append(less)
            if reverse and len(structure[a]) < most_parents:
                out.append(less | {a: [*structure[a], b]})
        elif len(structure[b]) < most_parents:
            out.append(structure | {b: [*structure[b], a]})
    return [s for s in out if acyclic(s)]


def k2_search(scores, order: list[str], most_parents: int = 2, start: Structure | None = None) -> Structure:
    """Greedy parents among earlier nodes while the total rises."""
    structure = start or empty(order)
    now = scores.total(structure)
    for i, node in enumerate(order):
        while len(structure[node]) < most_parents:
            tries = [(scores.total(s), -j, s) for j, p in enumerate(order[:i]) if p not in structure[node] for s in [structure | {node: [*structure[node], p]}] if acyclic(s)]
            best = max(tries, key=lambda t: t[:2], default=None)
            if best is None or best[0] <= now + 1e-9:
                break
            now, structure = best[0], best[2]
    return structure


def hill_climb(scores, start: Structure, most_parents: int = 2, most_steps: int = 100) -> Structure:
    """The best move while it raises the total."""
    structure, now = start, scores.total(start)
    for _ in range(most_steps):
        best = max(((scores.total(s), -i, s) for i, s in enumerate(moves(structure, most_parents))), key=lambda t: t[:2], default=None)
        if best is None or best[0] <= now + 1e-9:
            break
        now, structure = best[0], best[2]
    return structure


def random_structure(nodes: list[str], rng: random.Random, most_parents: int = 2, arcs: int | None = None) -> Structure:
    order, out = rng.sample(nodes, len(nodes)), empty(nodes)
    pairs = list(itertools.combinations(order, 2))
    for a, b in rng.sample(pairs, min(len(pairs), arcs if arcs is not None else len(nodes))):
        if len(out[b]) < most_parents:
            out[b].append(a)
    return out


def repeated_hill_climb(scores, nodes: list[str], runs: int = 3, most_parents: int = 2, seed: int = 1) -> Structure:
    """Hill climbing from the empty and from random structures; the best end stays."""
    rng = random.Random(seed)
    ends = [hill_climb(scores, s, most_parents) for s in [empty(nodes), *[random_structure(nodes, rng, most_parents) for _ in range(runs - 1)]]]
    return max(ends, key=scores.total)


def tabu_search(scores, start: Structure, most_parents: int = 2, steps: int = 20, memory: int = 5) -> Structure:
    """The best move that is not back to a recent structure, up or down; the best structure met stays."""
    say = lambda s: repr(sorted((n, sorted(p)) for n, p in s.items()))
    structure = best = start
    top, recent = scores.total(start), [say(start)]
    for _ in range(steps):
        options = [(scores.total(s), -i, s) for i, s in enumerate(moves(structure, most_parents)) if say(s) not in recent]
        if not options:
            break
        value, _, structure = max(options, key=lambda t: t[:2])
        recent = [*recent, say(structure)][-memory:]
        if value > top + 1e-9:
            top, best = value, structure
    return best


def anneal(scores, start: Structure, most_parents: int = 2, steps: int = 60, temperature: float = 10.0, cooling: float = 0.9, seed: int = 1) -> Structure:
    """Random moves, taken if they rise, or by chance the less they fall and the warmer it is; the best met stays."""
    rng = random.Random(seed)
    structure = best = start
    now = top = scores.total(start)
    for _ in range(steps):
        options = moves(structure, most_parents)
        if not options:
            break
        s = rng.choice(options)
        value = scores.total(s)
        if value >= now or rng.random() < math.exp((value - now) / max(temperature, 1e-9)):
            structure, now = s, value
            if now > top:
                best, top = structure, now
        temperature *= cooling
    return best


def genetic_structures(scores, nodes: list[str], population: int = 6, generations: int = 6, most_parents: int = 2, seed: int = 1) -> Structure:
    """Structures cross by taking each node's parents from either, and mutate by one move; the fittest half lives on."""
    rng = random.Random(seed)
    alive = [empty(nodes), *[random_structure(nodes, rng, most_parents) for _ in range(population - 1)]]
    for _ in range(generations):
        children = []
        for _ in range(population):
            a, b = rng.sample(alive, 2)
            child = {n: list((a if rng.random() < 0.5 else b)[n]) for n in nodes}
            while not acyclic(child):
                n = rng.choice([n for n in nodes if child[n]])
                child[n] = child[n][:-1]
            options = moves(child, most_parents)
            children.append(rng.choice(options) if options and rng.random() < 0.5 else child)
        alive = sorted(alive + children, key=scores.total, reverse=True)[:population]
    return alive[0]


def tree_augmented(scores: Scores, label: str) -> Structure:
    """The class is a parent of all others, which form a tree of the largest gain of score over having the class alone."""
    others = [n for n in scores.nodes if n != label]
    out = naive(scores.nodes, label)
    gain = {(a, b): scores(b, [label, a]) - scores(b, [label]) for a, b in itertools.permutations(others, 2)}
    inside = others[:1]
    while len(inside) < len(others):
        _, _, a, b = max((gain[a, b], (-inside.index(a), -others.index(b)), a, b) for a in inside for b in others if b not in inside)
        out[b].append(a)
        inside.append(b)
    return out


def global_tree_augmented(scores: CrossScores, label: str) -> Structure:
    """The same by adding, one at a time, the arc that raises the cross-validated score of the whole most."""
    others = [n for n in scores.nodes if n != label]
    out, inside = naive(scores.nodes, label), others[:1]
    while len(inside) < len(others):
        tries = [(scores.total(out | {b: [*out[b], a]}), -i, a, b) for i, (a, b) in enumerate((a, b) for a in inside for b in others if b not in inside)]
        _, _, a, b = max(tries)
        out = out | {b: [*out[b], a]}
        inside.append(b)
    return out


def independence_search(scores: Scores, most_given: int = 1) -> Structure:
    """Arcs where no set of up to ``most_given`` other nodes makes two nodes independent by the score (an extra parent does
    not raise it); colliders are turned first, other arcs follow the order of nodes."""
    linked, apart = set(), {}
    for a, b in itertools.combinations(scores.nodes, 2):
        others = [n for n in scores.nodes if n not in (a, b)]
        given = next((c for k in range(most_given + 1) for c in itertools.combinations(others, k) if scores(b, [*c, a]) <= scores(b, list(c)) + 1e-9), None)
        if given is None:
            linked.add((a, b))
        else:
            apart[a, b] = given
    out = empty(scores.nodes)
    met = lambda x, y: (x, y) in linked or (y, x) in linked
    turned: set[frozenset[str]] = set()
    for (a, b), given in apart.items():
        for c in scores.nodes:
            if c not in (a, b) and met(a, c) and met(b, c) and c not in given:
                for x in (a, b):
                    if frozenset((x, c)) not in turned and acyclic(out | {c: [*out[c], x]}):
                        out[c].append(x)
                        turned.add(frozenset((x, c)))
    for a, b in sorted(linked):
        if frozenset((a, b)) not in turned:
            ahead = out | {b: [*out[b], a]}
            out = ahead if acyclic(ahead) else out | {a: [*out[a], b]}
    return out


def tables(df: DataFrame, structure: Structure, alpha: float = 0.5) -> dict[str, dict[tuple, dict[str, float]]]:
    """For every node {labels of the parents: {label: probability}} with ``alpha`` added to each count."""
    out = {}
    for node, parents in structure.items():
        labels = [str(x) for x in labels_of(df.select(F.col(node).cast("string").alias(node)), node, 1000)]
        rows = df.where(F.col(node).isNotNull()).groupBy(*[F.col(p).cast("string").alias(p) for p in parents], F.col(node).cast("string").alias(node)).count().collect()
        cells: dict[tuple, dict[str, float]] = {}
        for r in rows:
            cells.setdefault(tuple(r[p] for p in parents), {})[r[node]] = float(r["count"])
        out[node] = {k: {x: (c.get(x, 0.0) + alpha) / (sum(c.values()) + alpha * len(labels)) for x in labels} for k, c in cells.items()}
        out[node][()] = out[node].get((), {x: 1 / max(1, len(labels)) for x in labels})
    return out


def averaged_tables(df: DataFrame, structure: Structure, alpha: float = 0.5, multinomial: bool = False) -> dict[str, dict[tuple, dict[str, float]]]:
    """Tables averaged over having the parents and having none, by how likely either makes the node's counts (``multinomial``:
    under counts with alpha spread over the table)."""
    scores = Scores(df, list(structure), "bdeu" if multinomial else "bayes", alpha)
    full, none = tables(df, structure, alpha), tables(df, empty(list(structure)), alpha)
    for node, parents in structure.items():
        if parents:
            share = 1 / (1 + math.exp(max(-700.0, min(700.0, scores(node, []) - scores(node, parents)))))
            full[node] = {k: {x: share * p + (1 - share) * none[node][()][x] for x, p in t.items()} if k else t for k, t in full[node].items()}
    return full


def classifier(made: dict[str, dict[tuple, dict[str, float]]], structure: Structure, label: str) -> Model:
    """The class given all other nodes: for each class the product of the class's table and those of its children."""
    labels = sorted(next(iter(made[label].values())))

    def log_p(node: str, value: str | None) -> F.Column:
        parents = structure[node]
        here = lambda p: F.lit(value) if p == label else F.coalesce(F.col(p).cast("string"), F.lit("\x00"))
        own = here(node)
        entries = [x for k, t in made[node].items() if (k or not parents) and (label not in parents or k[parents.index(label)] == value) for y, p in t.items() for x in (F.lit("\x1f".join([*map(str, k), y])), F.lit(math.log(max(p, 1e-300))))]
        if not entries:
            return F.lit(0.0)
        return F.coalesce(F.try_element_at(F.create_map(*entries), F.concat_ws("\x1f", *[here(p) for p in parents], own)), F.lit(0.0))

    involved = [label, *[n for n, p in structure.items() if label in p]]
    logs = F.array(*[sum((log_p(n, y) for n in involved), F.lit(0.0)) for y in labels])
    return Model(labels, let(logs, lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s)))))


def sampled(spark: SparkSession, made: dict[str, dict[tuple, dict[str, float]]], structure: Structure, rows: int, seed: int = 1) -> DataFrame:
    """Rows drawn from the network, node after node in an order in which parents come first."""
    from .rows import uniform

    df = spark.range(rows)
    left = dict(structure)
    while left:
        node = next(n for n, p in left.items() if all(x not in left for x in p))
        u = uniform(F.concat_ws("/", F.col("id").cast("string"), F.lit(node)), seed)

        def choose(t: dict[str, float]):
            out, total, names = None, 0.0, sorted(t)
            for x in names[:-1]:
                total += t[x]
                out = F.when(u < total, x) if out is None else out.when(u < total, x)
            return F.lit(names[-1]) if out is None else out.otherwise(names[-1])

        value = choose(made[node][()])
        for k, t in made[node].items():
            if k:
                hit = F.lit(True)
                for p, x in zip(structure[node], k):
                    hit = hit & (F.col(p) == x)
                value = F.when(hit, choose(t)).otherwise(value)
        df = df.withColumn(node, value)
        del left[node]
    return df


def to_bif(made: dict[str, dict[tuple, dict[str, float]]], structure: Structure, name: str = "network") -> str:
    """The network as an XML interchange document."""
    from xml.sax.saxutils import escape

    labels = {n: sorted(next(iter(t.values()))) for n, t in made.items()}
    out = ['<?xml version="1.0"?>', '<BIF VERSION="0.3">', "<NETWORK>", f"<NAME>{escape(name)}</NAME>"]
    for n in structure:
        out.append("<VARIABLE TYPE=\"nature\"><NAME>" + escape(n) + "</NAME>" + "".join(f"<OUTCOME>{escape(x)}</OUTCOME>" for x in labels[n]) + "</VARIABLE>")
    for n, parents in structure.items():
        flat = {x: 1 / len(labels[n]) for x in labels[n]}
        rows = [made[n].get(k, flat) for k in itertools.product(*[labels[p] for p in parents])]
        out.append("<DEFINITION><FOR>" + escape(n) + "</FOR>" + "".join(f"<GIVEN>{escape(p)}</GIVEN>" for p in parents) + "<TABLE>" + " ".join(repr(t[x]) for t in rows for x in labels[n]) + "</TABLE></DEFINITION>")
    return "\n".join([*out, "</NETWORK>", "</BIF>"])


def from_bif(text: str) -> tuple[dict[str, dict[tuple, dict[str, float]]], Structure]:
    """Tables and structure of such a document."""
    from xml.etree import ElementTree

    root = ElementTree.fromstring(text[text.index("<BIF") :])
    labels = {v.findtext("NAME").strip(): [o.text.strip() for o in v.findall("OUTCOME")] for v in root.iter("VARIABLE")}
    structure, made = {}, {}
    for d in root.iter("DEFINITION"):
        n, parents = d.findtext("FOR").strip(), [g.text.strip() for g in d.findall("GIVEN")]
        numbers, k = [float(x) for x in d.findtext("TABLE").split()], len(labels[n])
        structure[n] = parents
        made[n] = {key: dict(zip(labels[n], numbers[i * k : (i + 1) * k])) for i, key in enumerate(itertools.product(*[labels[p] for p in parents]))}
        made[n].setdefault((), {x: 1 / k for x in labels[n]})
    return made, {n: structure.get(n, []) for n in labels}


def cached_counts(df: DataFrame, nodes: list[str]) -> Callable[[list[str]], DataFrame]:
    """Counts of any subset of the nodes from one cube, written once: the cache that searches over many scores read."""
    cube = cut(df.cube(*nodes).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")))

    def counts(subset: list[str]) -> DataFrame:
        wanted = sum(1 << (len(nodes) - 1 - i) for i, n in enumerate(nodes) if n not in subset)
        return cube.where(F.col("_g") == wanted).select(*subset, "n")

    return counts
