"""What can be named and added: functions, tokenizers, blocking keys, string metrics, filters, learners, searches, sources.

A kind is a table of names; ``register`` adds one, ``find`` gets it, and modules named in the environment variable
BRINDLE_PLUGINS (separated by commas) are imported first, so that they can register theirs.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession


class Fitted(Protocol):
    """A transform whose statistics are frozen."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


class RowFilter(Protocol):
    """Learns from the first table what it needs; what it gives back is applied to that and to later ones."""

    def fit(self, df: DataFrame) -> Fitted: ...


class StringMetric(Protocol):
    """A distance or similarity of two columns; ``fit`` takes the corpus where it needs one."""

    def fit(self, df: DataFrame) -> "StringMetric": ...

    def column(self, a: Column, b: Column) -> Column: ...


class Updateable(Protocol):
    """A learner that takes rows batch by batch."""

    def update(self, batch: DataFrame) -> None: ...

    def predict(self, df: DataFrame) -> DataFrame: ...


_TABLES: dict[str, dict[str, Any]] = {}
_LOADED: set[str] = set()
_READY: list[bool] = []


def register(kind: str, name: str, value: Any) -> Any:
    """Adds a value; a name that is taken is an error."""
    _load()
    table = _TABLES.setdefault(kind, {})
    if name in table:
        raise ValueError(f"{kind} {name} is there already")
    table[name] = value
    return value


def plugin(kind: str, name: str) -> Callable[[Any], Any]:
    return lambda value: register(kind, name, value)


def _load() -> None:
    if not _READY:
        _READY.append(True)
        _own()
    for module in filter(None, (m.strip() for m in os.environ.get("BRINDLE_PLUGINS", "").split(","))):
        if module not in _LOADED:
            _LOADED.add(module)
            importlib.import_module(module)


def names(kind: str) -> list[str]:
    _load()
    return sorted(_TABLES.get(kind, {}))


def kinds() -> list[str]:
    _load()
    return sorted(_TABLES)


def find(kind: str, name: str) -> Any:
    _load()
    try:
        return _TABLES[kind][name]
    except KeyError:
        raise KeyError(f"no {kind} {name}; there are {', '.join(names(kind))}") from None


class Standardise:
    """Centres and scales by the statistics of the first table."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def fit(self, df: DataFrame) -> Fitted:
        from .operators.transforms import standardize

        return lambda other: standardize(other, self.columns, fitted=df)


class MinMax:
    def __init__(self, columns: list[str]) -> None:
        self.columns = columns

    def fit(self, df: DataFrame) -> Fitted:
        from .operators.transforms import normalize

        return lambda other: normalize(other, self.columns, fitted=df)


class Plain:
    """A metric that needs no corpus."""

    def __init__(self, f: Callable[[Column, Column], Column]) -> None:
        self.f = f

    def fit(self, df: DataFrame) -> "Plain":
        return self

    def column(self, a: Column, b: Column) -> Column:
        return self.f(a, b)


def streamable(transform: Fitted, df: DataFrame) -> bool:
    """Whether a transform works row by row: its plan has no exchange, aggregate, sort, limit or window."""
    plan = transform(df)._jdf.queryExecution().optimizedPlan().toString()
    return not any(word in plan for word in ("Aggregate", "Sort", "Limit", "Window", "Join", "Repartition", "Deduplicate"))


def apply_named(df: DataFrame, kind: str, name: str, *args: Any, **options: Any) -> DataFrame:
    """A registered filter, fitted on the table and applied to it."""
    return find(kind, name)(*args, **options).fit(df)(df)


def load(spark: SparkSession, path: str, form: str, **options: Any) -> DataFrame:
    """A table by the name of its format."""
    return find("loader", form)(spark, path, **options)


def save(df: DataFrame, path: str, form: str, **options: Any) -> None:
    find("saver", form)(df, path, **options)


def _own() -> None:
    from .operators import associations, blocking, clusters, estimators, linkage, meta, rules, selection, trees
    from .operators.bayes import naive_bayes
    from .operators.columns import NAMED
    from .sources import arff, tables

    own = {
        "scalar": dict(NAMED),
        "tokenizer": {"words": linkage.tokens, "ngrams": linkage.ngrams},
        "blocker": dict(blocking.PREDICATES),
        "metric": {"jaccard": Plain(lambda a, b: linkage.jaccard(linkage.tokens(a), linkage.tokens(b))), "edit": Plain(linkage.edit_similarity), "shared": Plain(lambda a, b: linkage.shared_of_larger(linkage.tokens(a), linkage.tokens(b)))},
        "filter": {"standardise": Standardise, "min max": MinMax},
        "estimator": {"discrete": estimators.discrete, "normal": estimators.normal, "kernel": estimators.kernel, "poisson": estimators.poisson},
        "learner": {"naive bayes": naive_bayes, "c45": trees.c45, "stump": trees.stump, "random tree": trees.random_tree},
        "rules": {"prism": rules.prism, "ripper": rules.ripper, "partial trees": rules.partial_tree_rules},
        "meta": {"bagging": meta.bagging, "ada boost": meta.ada_boost, "one against rest": meta.one_against_rest},
        "clusterer": {"k means": clusters.k_means, "farthest first": clusters.farthest_first},
        "associator": {"pairs": associations.pair_rules, "itemsets": associations.itemsets},
        "search": {"best first": selection.best_first, "greedy": selection.greedy_stepwise, "genetic": selection.genetic_search, "random": selection.random_search, "rank": selection.rank_search},
        "loader": {"arff": arff.read, "csv": tables.read_csv, "parquet": lambda spark, path: spark.read.parquet(path), "serialized": tables.read_serialized},
        "saver": {"arff": arff.write, "csv": tables.write_csv, "parquet": lambda df, path: df.write.parquet(path), "serialized": tables.write_serialized},
    }
    for kind, table in own.items():
        for name, value in table.items():
            _TABLES.setdefault(kind, {}).setdefault(name, value)
