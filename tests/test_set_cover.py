"""The set cover queries read every part: brute force over all pairs, on parts of any price and of none."""

import itertools

import duckdb
import pytest

from brindle.plans import catalog

#: Cheap parts agree in brand where they are of one type, dear ones and those of no price in size, or in name and size.
PARTS = (
    [(i, f"{'ab'[i % 2]}{i:02d} nut", f"B{i // 2 % 4}", f"T{i // 2 % 4}", i, 901.0) for i in range(12)]
    + [(20 + i, f"c{i % 9:02d} bolt", f"B{i % 5}", f"T{i // 3 % 6}", 50 + i // 3 % 6, 1500.0 if i % 4 else None) for i in range(36)]
    + [(60 + i, f"d{i // 2 % 5:02d} rod", f"B{i}", f"T{i // 2 % 5}", 80 + i // 4, 950.0) for i in range(20)]
)
KEYS = {"brand": lambda p: p[2], "size": lambda p: p[4], "first3": lambda p: p[1][:3]}
PAIRED = KEYS | {f"{a}&{b}": lambda p, a=a, b=b: (KEYS[a](p), KEYS[b](p)) for a, b in itertools.combinations(KEYS, 2)}


def greedy(parts, keys):
    pairs = list(itertools.combinations(parts, 2))
    left = {n: {(a[0], b[0]) for a, b in pairs if k(a) == k(b) and a[3] == b[3]} for n, k in keys.items()}
    cost = {n: sum(k(a) == k(b) and a[3] != b[3] for a, b in pairs) for n, k in keys.items()}
    chosen = []
    while any(left.values()):
        best = min((n for n in left if left[n]), key=lambda n: (-len(left[n]) / (cost[n] + 50), n))
        if len(left[best]) / (cost[best] + 50) <= 1e-3:
            break
        chosen.append(best)
        left = {n: x - left[best] for n, x in left.items() if n != best}
    return chosen


def learned(spark, folder, name, parts):
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")
    return [r["blocker"] for r in sorted(catalog.queries()[name](spark, folder).collect(), key=lambda r: r["place"])]


def cheap(parts):
    return [p for p in parts if p[5] is not None and p[5] < 950]


def test_set_cover_blocking_reads_all_parts(spark, tmp_path):
    assert greedy(PARTS, KEYS) != greedy(cheap(PARTS), KEYS)
    assert learned(spark, str(tmp_path), "set_cover_blocking", PARTS) == greedy(PARTS, KEYS)


def test_set_cover_dnf_blocking_reads_all_parts(spark, tmp_path):
    assert greedy(PARTS, PAIRED) != greedy(cheap(PARTS), PAIRED)
    assert learned(spark, str(tmp_path), "set_cover_dnf_blocking", PARTS) == greedy(PARTS, PAIRED)


def by_sql(folder):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW part AS SELECT * FROM read_parquet('{folder}/part.parquet/*.parquet')")
    return [r[1] for r in duck.sql(catalog.oracle_sql()["set_cover_first_choice"]).fetchall()]


def test_set_cover_first_choice_reads_all_parts(spark, tmp_path):
    assert learned(spark, str(tmp_path), "set_cover_first_choice", PARTS) == greedy(PARTS, KEYS)[:1] == by_sql(tmp_path)
    assert greedy(PARTS, KEYS)[0] != greedy(cheap(PARTS), KEYS)[0]


ODD = {
    "no parts": [],
    "no true pair": [(1, "abc", "B", "T", 1, None), (2, "abd", "C", "U", 2, 960.0)],
    "a tie of size and first3": [(1, "abc", "B", "T", 1, 960.0), (2, "abc", "C", "T", 1, 960.0)],
    "empty names": [(1, "", "B", "T", 1, None), (2, "", "C", "T", 2, None), (3, None, "D", "T", 3, 960.0), (4, None, "E", "T", 4, 960.0)],
    "no type": [(i, f"a{i:02d}", "B", None, 1, 960.0) for i in range(30)] + [(50, "a50", "B", "T", 2, 960.0), (51, "a51", "B", "T", 2, 960.0), (52, "a50", "D", "T", 1, 960.0), (53, "a61", "E", "T", 1, 960.0), (54, "a62", "B", "U", 1, 960.0)],
    "keys twice and none": [(0, f"a{i}c", "B", "T", 10 + i, 960.0) for i in range(3)] + [(None, "abc", "D", "T", 9, 960.0)] * 3 + [(3, "abd", "E", "T", 5, 960.0), (4, "abe", "F", "T", 5, 960.0)],
}


@pytest.mark.parametrize("name", ODD)
def test_set_cover_first_choice_is_that_of_sql_on_odd_parts(spark, tmp_path, name):
    assert learned(spark, str(tmp_path), "set_cover_first_choice", ODD[name]) == by_sql(tmp_path)
