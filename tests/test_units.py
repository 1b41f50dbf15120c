"""Functions and sources on small hand-checked inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import measures, ranges
from brindle.operators import associations, linkage, relational, transforms
from brindle.sources import arff, tables
from brindle.streaming import incremental


def test_column_ranges():
    names = list("abcdef")
    assert ranges.columns_in("first-2,5,last", names) == ["a", "b", "e", "f"]
    assert ranges.columns_in("2-4", names, invert=True) == ["a", "e", "f"]
    with pytest.raises(ValueError):
        ranges.columns_in("4-2", names)
    with pytest.raises(ValueError):
        ranges.columns_in("7", names)


def test_statistics():
    assert abs(measures.normal_cdf(1.959963984540054) - 0.975) < 1e-12
    assert abs(measures.t_two_sided(2.2281388519649385, 10) - 0.05) < 1e-9
    assert abs(measures.t_two_sided(12.706204736432095, 1) - 0.05) < 1e-9
    assert abs(measures.incomplete_beta(2, 3, 0.5) - 0.6875) < 1e-12
    assert abs(measures.ln_factorial(5) - 4.787491742782046) < 1e-12


def test_affine_gaps():
    assert linkage.affine_distance("abc", "abc") == -15 / 6
    assert linkage.affine_distance("", "") == 0
    assert linkage.affine_distance("ab", "") == (5 + 1) / 2
    assert linkage.affine_distance("abcd", "ad") == (-10 + 5 + 1) / 6


def test_string_measures(spark):
    row = spark.createDataFrame([("The Café, the bar", "the BAR", None)], "a string, b string, c string").select(
        linkage.tokens("a").alias("t"), linkage.jaccard(linkage.tokens("a"), linkage.tokens("b")).alias("j"), F.size(linkage.ngrams("b")).alias("g"),
        linkage.dice(linkage.tokens("a"), linkage.tokens("b")).alias("d"), linkage.overlap(linkage.tokens("a"), linkage.tokens("b")).alias("o"), linkage.tokens("c").alias("n"),
    ).first()
    assert row["t"] == ["the", "café", "the", "bar"] and row["n"] is None
    assert abs(row["j"] - 2 / 3) < 1e-12 and row["g"] == 5 and abs(row["d"] - 0.8) < 1e-12 and row["o"] == 1.0


def test_expression_rules(spark):
    df = spark.createDataFrame([(4.0, 0.0), (None, 2.0)], "x double, y double")
    got = [tuple(r) for r in df.select(transforms.expression("a1 / a2", df.columns).alias("q"), transforms.expression("-a1 ^ 2 + sqrt(a2)", df.columns).alias("r")).collect()]
    assert got == [(None, -16.0), (None, None)]
    with pytest.raises(ValueError):
        transforms.expression("__import__('os')", ["x"])


def test_frozen_statistics_and_constants(spark):
    first = spark.createDataFrame([(0.0, 7.0), (10.0, 7.0), (None, 7.0)], "x double, k double")
    second = spark.createDataFrame([(20.0, 9.0)], "x double, k double")
    assert [tuple(r) for r in transforms.normalize(second, ["x", "k"], fitted=first).collect()] == [(2.0, 0.0)]
    assert [tuple(r) for r in transforms.standardize(second, ["k"], fitted=first).collect()] == [(20.0, 2.0)]
    assert transforms.remove_useless(first, ["x", "k"]).columns == ["x"]


def test_equal_frequency(spark):
    df = spark.createDataFrame([(float(i),) for i in range(8)] + [(None,)], "x double")
    bins = sorted((r["x"], r["bin"]) for r in transforms.equal_frequency(df, "x", 4).where("x is not null").collect())
    assert [b for _, b in bins] == [0, 0, 1, 1, 2, 2, 3, 3]
    assert transforms.proportional(df, "x").where("x is null").first()["bin"] is None


def test_folds_are_disjoint_and_even(spark):
    df = spark.range(23).withColumnRenamed("id", "k")
    sizes = sorted(r["count"] for r in relational.with_folds(df, 5, "k").groupBy("fold").count().collect())
    assert sizes == [4, 4, 5, 5, 5]


def test_rules_by_hand(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "c"), (4, None)]
    got = {(r["antecedent"], r["consequent"]): r for r in associations.pair_rules(spark.createDataFrame(rows, "t int, i string"), "t", "i", 2, 0.0).collect()}
    r = got["a", "b"]
    assert (r["n"], round(r["confidence"], 4), round(r["lift"], 4), r["leverage"], r["conviction"]) == (2, 0.6667, 1.3333, 0.125, 0.75)


ARFF = """% comment
@relation 'demo'
@attribute name string
@attribute 'the age' numeric
@attribute kind {a, 'b c'}
@data
"it's, so", 3.5, a
'x\\'y', ?, 'b c'
{0 "sparse, so", 1 2}
@home,1,a
"""


def test_arff(spark, tmp_path):
    path = tmp_path / "demo.arff"
    path.write_text(ARFF)
    df = arff.read(spark, str(path))
    assert df.dtypes == [("name", "string"), ("the age", "double"), ("kind", "string")]
    rows = [tuple(r) for r in df.collect()]
    assert rows[0] == ("it's, so", 3.5, "a") and rows[1][0] == "x'y" and rows[1][2] == "b c" and rows[2] == ("sparse, so", 2.0, "a")
    assert rows[1][1] is None and rows[3] == ("@home", 1.0, "a")
    arff.write(df, str(tmp_path / "out"))
    again = arff.read(spark, str(tmp_path / "out"))
    assert again.dtypes == df.dtypes and sorted(map(repr, again.collect())) == sorted(map(repr, df.collect()))


def test_csv_and_c45(spark, tmp_path):
    (tmp_path / "t.csv").write_text("x,y\n1,a\n?,b\n2.5,?\n")
    df = tables.read_csv(spark, str(tmp_path / "t.csv"))
    assert df.dtypes == [("x", "double"), ("y", "string")] and sorted(r["x"] or 0 for r in df.collect()) == [0, 1.0, 2.5]
    (tmp_path / "g.names").write_text("yes, no. | classes\nage: continuous.\nskip: ignore.\ncolour: red, blue.\n")
    (tmp_path / "g.data").write_text("1.5, q, red, yes.\n?, q, blue, no\n")
    rows = [tuple(r) for r in tables.read_c45(spark, str(tmp_path / "g.names"), str(tmp_path / "g.data")).collect()]
    assert rows == [(1.5, "red", "yes"), (None, "blue", "no")]


def test_streams(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    incremental.drain(incremental.class_counts(stream, ["user_id"], "event_type"), "counts", str(tmp_path / "cp"))
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "in")).count()
    incremental.drain(incremental.windowed_counts(stream, "ts", "event_type"), "windows", str(tmp_path / "cp2"))
    assert spark.table("windows").agg(F.sum("count")).first()[0] > 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, v double, c string")
    assert relational.numbered(empty, "k").count() == 0
    assert relational.attribute_stats(empty, ["c"]).count() == 0
    assert transforms.word_vector(empty, "k", "c", 5).count() == 0


def test_neighbours_of_more_queries_than_a_block(spark, sf, monkeypatch):
    from brindle.operators import neighbours

    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    ask = lambda: sorted(map(tuple, neighbours.nearest(p, p, ["p_size", "p_retailprice"], "p_partkey", 3).collect()))
    want = ask()
    monkeypatch.setattr(neighbours, "MOST_QUERIES", 70)
    assert ask() == want and len(want) == 3 * p.count()


def test_neighbours_equal_all_pairs(spark, monkeypatch):
    """Copies of points and queries, ties, points apart and a search in several boxes and chunks."""
    from brindle.operators import neighbours

    rng = random.Random(3)
    rows = [(i, float(rng.randrange(12)), round(rng.gauss(0, 1), rng.choice([0, 1, 6]))) for i in range(700)] + [(700 + i, 3.0, 0.5) for i in range(60)] + [(760, None, 1.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(3)
    full = [r for r in rows if r[1] is not None]
    low, span = [min(r[c] for r in full) for c in (1, 2)], [max(r[c] for r in full) - min(r[c] for r in full) for c in (1, 2)]
    place = {r[0]: [(r[c] - low[c - 1]) / span[c - 1] for c in (1, 2)] for r in full}
    want = []
    for q in [k for k in place if k % 3 == 0]:
        near = sorted((round(math.sqrt(sum((a - b) ** 2 for a, b in zip(place[q], place[t]))), 9), t) for t in place)[:5]
        want += [(q, t, i + 1, round(d, 6)) for i, (d, t) in enumerate(near)]
    for most, size in ((200_000, 256), (150, 8)):
        monkeypatch.setattr(neighbours, "AT_ONCE", most)
        monkeypatch.setattr(neighbours, "BOX", size)
        assert sorted(map(tuple, neighbours.nearest(df, df.where("k % 3 = 0"), ["x", "y"], "k", 5).collect())) == sorted(want)
    assert neighbours.nearest(df, df.where("k < 0"), ["x", "y"], "k", 5).count() == 0


def test_a_box_of_queries_reads_only_near_boxes(monkeypatch):
    from brindle.operators import neighbours

    rng, read = np.random.default_rng(1), []
    real = np.partition
    monkeypatch.setattr(np, "partition", lambda d, *a, **k: read.append(d.size) or real(d, *a, **k))
    points = rng.random((40_000, 2))
    list(neighbours.searched(points, np.ones(len(points), "int64"), points[:20_000], 5))
    assert sum(read) < 0.1 * 20_000 * len(points)


def test_drained_streams_stay_off_the_driver(spark, sf, monkeypatch):
    import __spark_entry__
    from brindle.streaming import incremental

    monkeypatch.setattr(incremental, "drain", lambda *_: pytest.fail("the result was kept in the driver's memory"))
    got = __spark_entry__.queries()["stream_sessions"](spark, sf)
    assert got.inputFiles() and got.groupBy().sum("n").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_drained_streams_of_many_batches_and_none(spark, tmp_path):
    from brindle.streaming import incremental

    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)], "k long, c string").repartition(5)
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda p: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(p)
    counts = incremental.drained(stream(str(tmp_path / "in")).groupBy("c").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(tuple, counts.collect())) == [("a", 15), ("b", 15)]
    kept = incremental.drained(stream(str(tmp_path / "in")).where("k > 9"), str(tmp_path / "out2"), str(tmp_path / "cp2"), "append")
    assert sorted(r["k"] for r in kept.collect()) == list(range(10, 30))
    (tmp_path / "empty").mkdir()
    assert incremental.drained(stream(str(tmp_path / "empty")).groupBy("c").count(), str(tmp_path / "out3"), str(tmp_path / "cp3")).count() == 0
