"""Every query with an SQL oracle against DuckDB, the others for rows."""

import math

import duckdb
import pytest

from brindle.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}")
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


#: Modules whose queries learn a concept, for which the smallest tables have too few rows.
LARGER = ("catalog_learners", "catalog_analysis", "catalog_linkage")


def folder(name):
    return "/root/testdata/sf0.01" if catalog.queries()[name].__module__.endswith(LARGER) else "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ducks():
    out = {}
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.001"):
        out[sf] = duckdb.connect()
        for t in TABLES:
            out[sf].sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return out


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, ducks, name):
    df, duck = catalog.queries()[name](spark, folder(name)), ducks[folder(name)]
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = duck.sql(catalog.oracle_sql()[name])
    at = [list(sql.columns).index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)
    assert sorted(sql.columns) == columns
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, folder(name)).count() > 0
