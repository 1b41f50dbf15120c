"""Operators without an SQL statement of their own, against plain Python or known values."""

import itertools
import math
import random
import zipfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle import registry
from brindle.functions import scalars, stemming, tables
from brindle.operators import blocking, columns, deduping, densities, experiments, graph, lazy, learners, linkage, matrices, networks, rows, rulesets, selection, supervised, transforms, trees
from brindle.operators.bayes import naive_bayes
from brindle.sources import tables as sources

STEMS = """caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll as as""".split()


def test_stems(spark):
    for word, want in zip(STEMS[::2], STEMS[1::2]):
        assert stemming.stem(word) == want, word
    got = spark.createDataFrame([("Motoring",), (None,)], "w string").select(stemming.stemmed("w")).collect()
    assert [r[0] for r in got] == ["motor", None]


def test_affine_distances_of_batches(spark):
    rng = random.Random(4)
    say = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
    a, b = [say() for _ in range(300)], [say() for _ in range(300)]
    assert np.allclose(linkage.affine_distances(a, b), [linkage.affine_distance(x, y) for x, y in zip(a, b)])
    df = spark.createDataFrame([("ab", "ab"), (None, "x"), ("", "")], "a string, b string")
    assert [r["affine"] for r in linkage.affine_similarity(df, "a", "b").collect()] == [-2.5, None, 0.0]


def test_learned_edit_model():
    pairs = [("jon smith", "john smith"), ("ann lee", "anne lee"), ("bob ray", "bob rey"), ("kate fox", "kate  fox")] * 3
    fresh, model = deduping.AffineHMM(), deduping.AffineHMM().train(pairs, 8)
    like = lambda m: sum(math.log(m._forward(a, b)[1]) for a, b in pairs)
    assert like(model) > like(fresh)
    assert model.distance("jim poe", "jimm poe") < model.distance("jim poe", "al gray") and np.allclose(model.move.sum(axis=1), 1)


def records():
    rng = random.Random(7)
    words = ["red", "blue", "big", "old", "ring", "bolt", "gear", "nut", "cap"]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 4))) if i % 17 else None, rng.choice("xyz") if i % 13 else None) for i in range(120)]


def test_similarity_joins_equal_all_pairs(spark):
    data = records()
    df = spark.createDataFrame(data, "k int, t string, b string")
    sets = {i: frozenset(t.split()) for i, t, _ in data if t}
    block = {i: b for i, _, b in data}
    for least in (0.5, 0.8):
        want = {(i, j) for i, j in itertools.combinations(sorted(sets), 2) if block[i] is not None and block[i] == block[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9}
        got = {(r["id1"], r["id2"]) for r in linkage.jaccard_pairs(df, "k", "b", linkage.tokens("t"), least).collect()}
        assert got == want and want
    count = {i: {w: t.split().count(w) for w in set(t.split())} for i, t, _ in data if t}
    df_of = {w: sum(w in c for c in count.values()) for c in count.values() for w in c}
    vec = {i: {w: n * math.log(len(data) / df_of[w]) for w, n in c.items()} for i, c in count.items()}
    vec = {i: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for i, v in vec.items()}
    dot = lambda p, q: sum(x * q.get(w, 0) for w, x in p.items())
    for least in (0.6, 0.9):
        got = {r["k"]: (r["class_id"], r["links"]) for r in linkage.cosine_classes(df, "k", "t", least).collect()}
        assert got == {i: (min(j for j in vec if count[j] == count[i]), sum(j != i and dot(vec[i], vec[j]) >= least - 1e-9 for j in vec)) for i in vec}


def unions(edges, nodes):
    root = {n: n for n in nodes}
    for a, b in edges:
        x, y = root[a], root[b]
        if x != y:
            root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
    return {n: min(m for m in nodes if root[m] == r) for n, r in root.items()}


def test_groups_and_clusters(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["group"] for r in graph.groups(spark.createDataFrame(edges, "id1 int, id2 int")).collect()}
    want = unions(edges, sorted({x for e in edges if e[0] != e[1] for x in e}))
    assert got == want
    nodes = spark.range(30).withColumnRenamed("id", "k")
    pairs = [(i, j, rng.random()) for i, j in itertools.combinations(range(30), 2)]
    left, made = {i: i for i in range(30)}, 30
    for i, j, d in sorted(pairs, key=lambda p: p[2]):
        if made > 6 and left[i] != left[j]:
            a, b, made = left[i], left[j], made - 1
            left = {n: a if r == b else r for n, r in left.items()}
    got = {r["k"]: r["cluster"] for r in deduping.agglomerated(spark.createDataFrame(pairs, "id1 long, id2 long, distance double"), nodes, "k", "distance", 6).collect()}
    assert got == {n: min(m for m in left if left[m] == left[n]) for n in left}
    assert {r["cluster"] for r in deduping.agglomerated(spark.createDataFrame([], "id1 long, id2 long, distance double"), nodes, "k", "distance", 3).collect()} == set(range(30))


@pytest.mark.parametrize("few", [0, 30])
def test_groups_and_clusters_of_more_links_than_a_task_joins(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    test_groups_and_clusters(spark)
    tied = [(i, i + 1, 2.0 if i % 5 else 1.0) for i in range(40)]
    nodes = spark.range(41).withColumnRenamed("id", "k")
    for k in (30, 33, 40):
        got = deduping.agglomerated(spark.createDataFrame(tied, "id1 long, id2 long, distance double"), nodes, "k", "distance", k).collect()
        assert len({r["cluster"] for r in got}) == (1 if k < 33 else 33)


def test_distances_are_not_listed(spark, monkeypatch):
    """A million distances or more were cut, and a group was made for each halving of their list."""
    made = []
    real = deduping.groups
    monkeypatch.setattr(deduping, "groups", lambda *a: made.append(1) or real(*a))
    pairs = spark.createDataFrame([(i, i + 1, float(i * 37 % 101)) for i in range(90)], "id1 long, id2 long, distance double")
    assert deduping.agglomerated(pairs, spark.range(91).withColumnRenamed("id", "k"), "k", "distance", 4).select("cluster").distinct().count() == 4
    assert len(made) == 1


def test_chains_need_no_round(spark, monkeypatch):
    made = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: made.append(1) or real(df))
    links = spark.range(3000).selectExpr("id AS id1", "id + 1 AS id2")
    assert graph.groups(links).where("group = 0").count() == 3001 and len(made) == 2


def test_classes_of_pairs_stand_for_all_pairs(spark):
    rng = random.Random(10)
    data = [(i, rng.choice("ab") if i % 9 else None, float(rng.randrange(6))) for i in range(80)]
    df = spark.createDataFrame(data, "k long, b string, x double")
    every = deduping.with_fields(blocking.candidates(df, "k", {"b": blocking.exact("b")}), df, "k", ["x"])
    gap = F.abs(F.col("x_1") - F.col("x_2"))
    few = deduping.paired_classes(df, "k", "b", ["x"]).select(gap.alias("gap"), (gap < 2).alias("y"), "n").groupBy("gap", "y").agg(F.sum("n").alias("n"))
    all_pairs = every.select(gap.alias("gap"), (gap < 2).alias("y"))
    assert {(r["gap"], r["n"]) for r in few.collect()} == {(r["gap"], r["count"]) for r in all_pairs.groupBy("gap").count().collect()}
    measure = {"gap": F.col("gap")}
    one = deduping.classifier_distance(all_pairs, all_pairs, measure, "y").withColumn("s", -F.col("distance"))
    two = deduping.classifier_distance(few, few, measure, "y", weight="n").withColumn("s", -F.col("distance"))
    true = all_pairs.where("y").count()
    assert deduping.average_precision(one, "y", "s", true).first() == deduping.average_precision(two, "y", "s", true, "n").first()


def test_blocking_is_learned(spark):
    rng = random.Random(5)
    data = [(i, f"name{i // 3}", f"z{rng.randrange(4)}", i // 3) for i in range(60)]
    df = spark.createDataFrame(data, "k int, name string, zip string, object int")
    preds = {"name": blocking.exact("name"), "zip": blocking.exact("zip"), "first": blocking.first_chars("name", 2)}
    assert blocking.learn_cover(df, "k", "object", preds) == ["name"]
    assert set(blocking.conjunctions(preds)) == {"name", "zip", "first", "name&zip", "name&first", "zip&first"}
    assert blocking.learn_cover(df, "k", "object", {"zip": preds["zip"]}, most_negatives=1) == []
    assert {(r["id1"], r["id2"]) for r in blocking.candidates(df, "k", {"name": preds["name"]}).collect()} == {(r["id1"], r["id2"]) for r in blocking.true_pairs(df, "k", "object").collect()}
    assert len(blocking.random_choice(preds, 2)) == 2


def test_covers_are_learned_without_pairs(spark, monkeypatch):
    rng = random.Random(9)
    data = [(i, rng.choice(["red nut", "red bolt", "old nut", None, ""]), f"z{rng.randrange(5)}" if i % 9 else None, rng.randrange(4) if i % 11 else None) for i in range(150)]
    df = spark.createDataFrame(data, "k int, name string, zip string, object int")
    single = {"name": blocking.exact("name"), "zip": blocking.exact("zip"), "first": blocking.first_chars("name", 2)}
    keys = {"name": lambda r: {r[1]} - {None}, "zip": lambda r: {r[2]} - {None}, "first": lambda r: {r[1][:2]} if r[1] else set(), "words": lambda r: set((r[1] or "").split())}
    keys |= {f"{a}&{b}": lambda r, a=a, b=b: set(itertools.product(keys[a](r), keys[b](r))) for a, b in itertools.combinations(keys, 2)}
    cost = lambda preds: {r["blocker"]: r["negatives"] for r in blocking.coverage(df, "k", "object", preds).collect()}
    real = {(p[0], q[0]): (p, q) for p, q in itertools.combinations(data, 2) if p[3] is not None and p[3] == q[3]}

    def greedy(preds):
        left, chosen, price = {n: {x for x, (p, q) in real.items() if keys[n](p) & keys[n](q)} for n in preds}, [], cost(preds)
        while any(left.values()):
            best = min((n for n in left if left[n]), key=lambda n: (-len(left[n]) / (price.get(n, 0) + 50), n))
            if len(left[best]) / (price.get(best, 0) + 50) <= 1e-3:
                break
            chosen.append(best)
            left = {n: x - left[best] for n, x in left.items() if n != best}
        return chosen

    made = lambda *_: pytest.fail("true pairs were listed")
    monkeypatch.setattr(blocking, "covered", made)
    monkeypatch.setattr(blocking, "true_pairs", made)
    for preds in (single, blocking.conjunctions(single), blocking.conjunctions(single | {"words": blocking.common_words("name")})):
        got = blocking.learn_cover(df, "k", "object", preds)
        assert got == greedy(preds) and len(got) > 1


def test_canopies_cover_and_are_apart(spark):
    rng = random.Random(6)
    near = {(i, j) for i, j in itertools.combinations(range(40), 2) if rng.random() < 0.08}
    nodes = spark.range(40).withColumnRenamed("id", "k")
    got = blocking.canopies(spark.createDataFrame([(i, j, 0.9) for i, j in near], "id1 long, id2 long, similarity double"), nodes, "k").collect()
    centres = {r["centre"] for r in got}
    assert {r["member"] for r in got} == set(range(40)) and not any((a, b) in near for a in centres for b in centres)


def test_training_pairs_and_classifier_distance(spark):
    rng = random.Random(8)
    data = [(i, i // 2, float(i // 2) + rng.random() * 0.1) for i in range(60)]
    df = spark.createDataFrame(data, "k long, object int, x double")
    good = deduping.positives(df, "k", "object").withColumn("y", F.lit(True))
    bad = deduping.negatives(df, "k", "object", 60).withColumn("y", F.lit(False))
    assert good.count() == 30 and 0 < bad.count() <= 60
    pairs = deduping.with_fields(good.unionByName(bad), df, "k", ["x"])
    out = deduping.classifier_distance(pairs, pairs, {"gap": F.abs(F.col("x_1") - F.col("x_2"))}, "y")
    assert deduping.average_precision(out.withColumn("s", -F.col("distance")), "y", "s", 30).first()["max_f1"] == 1.0
    text = spark.createDataFrame([(i, f"common word{i // 2} extra{i}") for i in range(20)], "k long, t string")
    named = spark.createDataFrame([(i, i + 1, i % 2 == 0) for i in range(19)], "id1 long, id2 long, y boolean")
    scored = deduping.learned_cosine(named, named, text, "k", "t", "y")
    r = scored.groupBy("y").agg(F.avg("similarity").alias("s")).collect()
    assert dict((x["y"], x["s"]) for x in r)[True] > dict((x["y"], x["s"]) for x in r)[False]


def test_relief_weights(spark):
    rng = random.Random(9)
    data = [(i, rng.random(), rng.random(), "ab"[i % 2]) for i in range(60)]
    data = [(i, x + (y == "b"), z, y) for i, x, z, y in data]
    df = spark.createDataFrame(data, "k int, x double, z double, y string")
    span = [max(d[c] for d in data) - min(d[c] for d in data) for c in (1, 2)]
    total = [0.0, 0.0]
    for r in data:
        for y in "ab":
            near = sorted((round(math.sqrt(sum(((r[c] - s[c]) / span[c - 1]) ** 2 for c in (1, 2))), 9), s[0]) for s in data if s[3] == y and s[0] != r[0])[:3]
            for _, j in near:
                for c in (1, 2):
                    total[c - 1] += (-1 if y == r[3] else 1) * abs(r[c] - data[j][c]) / span[c - 1]
    got = {r["attribute"]: r["weight"] for r in selection.relief(df, ["x", "z"], "y", "k", 3).collect()}
    assert got == pytest.approx({"x": total[0] / 180, "z": total[1] / 180}, abs=1e-5) and got["x"] > got["z"]


def test_searches():
    merit = lambda s: len(set(s) & {"b", "d"}) - 0.1 * len(s)
    names = list("abcde")
    for found in (selection.best_first(names, merit), selection.greedy_stepwise(names, merit), selection.greedy_stepwise(names, merit, backward=True), selection.random_search(names, merit, 2.0), selection.genetic_search(names, merit, 12, 15, mutation=0.2), selection.best_first(names, merit, backward=True)):
        assert sorted(found) == ["b", "d"]
    assert selection.rank_search(["d", "b", "a"], merit) == ["d", "b"]
    assert sorted(selection.race_search(names, lambda s, f: [1 - 0.4 * len(set(s) & {"b", "d"}) + 0.001 * ((i + f) % 3) for i in range(10)], 3)) == ["b", "d"]


def test_network_scores_and_files(spark):
    rng = random.Random(3)
    data = [(i, x := rng.choice("pq"), "u" if rng.random() < (0.9 if x == "p" else 0.2) else "v") for i in range(200)]
    df = spark.createDataFrame(data, "k int, x string, z string")
    counts = {(a, b): sum(d[1] == a and d[2] == b for d in data) for a in "pq" for b in "uv"}
    want = sum(math.lgamma(1.0) - math.lgamma(1.0 + counts[a, "u"] + counts[a, "v"]) + sum(math.lgamma(0.5 + counts[a, b]) - math.lgamma(0.5) for b in "uv") for a in "pq")
    assert networks.Scores(df, ["x", "z"])("z", ["x"]) == pytest.approx(want)
    structure = {"x": [], "z": ["x"]}
    made = networks.tables(df, structure)
    again, same = networks.from_bif(networks.to_bif(made, structure))
    assert same == structure and again["z"]["p",] == pytest.approx(made["z"]["p",])
    drawn = networks.sampled(spark, made, structure, 4000)
    share = drawn.where("x = 'p'").agg(F.avg((F.col("z") == "u").cast("double"))).first()[0]
    assert abs(share - made["z"]["p",]["u"]) < 0.05
    assert networks.acyclic(structure) and not networks.acyclic({"x": ["z"], "z": ["x"]})


def test_matrix_parts():
    a = np.array([[2.0, 1, 1], [4, 3, 3], [8, 7, 9]])
    low, up, order = matrices.lu(a)
    assert np.allclose(low @ up, a[order]) and matrices.determinant(a) == pytest.approx(np.linalg.det(a))
    with pytest.raises(ValueError):
        matrices.cholesky(np.array([[1.0, 2], [0, 1]]))
    values, vectors = matrices.eigen(np.array([[2.0, 1], [1, 2]]))
    assert np.allclose(values, [3, 1]) and np.allclose(np.abs(vectors[:, 0]), math.sqrt(0.5))


def test_tails_and_tables():
    assert tables.chi_squared_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert tables.f_tail(4.9646027437307145, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert tables.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-9)
    t = [[10, 20], [30, 5]]
    assert tables.chi_squared(t) == pytest.approx(18.72619, abs=1e-3) and tables.chi_squared(t, yates=True) < tables.chi_squared(t)
    assert tables.reduced([[1, 0], [2, 0]]).shape == (2, 1) and tables.tau([[5, 0], [0, 5]]) == pytest.approx(1)
    assert tables.gain_ratio([[5, 0], [0, 5]]) == tables.symmetrical_uncertainty([[5, 0], [0, 5]]) == pytest.approx(1) and tables.cochran([[50, 50], [50, 50]])
    assert tables.conditional_on_columns([[5, 5], [5, 5]]) == pytest.approx(1) and tables.cramers_v([[5, 0], [0, 5]]) == pytest.approx(1)


def test_scalars(spark):
    r = spark.createDataFrame([([3, 1], [2, 2], [2, 1, 0, 1])], "r array<bigint>, c array<bigint>, t array<bigint>").select(scalars.log2_hypergeometric(F.col("r"), F.col("c"), F.col("t")).alias("h")).first()
    want = math.lgamma(4) + 0 + math.lgamma(3) * 2 - math.lgamma(5) - math.lgamma(3)
    assert r["h"] == pytest.approx(want / math.log(2), abs=1e-8)
    g = spark.range(4000).select(scalars.gamma(F.col("id"), 2.5).alias("a"), scalars.gamma(F.col("id"), 0.5).alias("b")).agg(F.avg("a"), F.var_samp("a"), F.avg("b")).first()
    assert g[0] == pytest.approx(2.5, abs=0.15) and g[1] == pytest.approx(2.5, abs=0.4) and g[2] == pytest.approx(0.5, abs=0.08)
    e = spark.createDataFrame([("a'b\n",)], "s string").select(scalars.escaped(F.col("s"))).first()[0]
    assert e == "a\\'b\\n"


def test_rules_by_expected_accuracy():
    prior = rulesets.accuracy_prior([(10, 9), (20, 18), (5, 1)])
    assert sum(prior) == pytest.approx(1)
    assert rulesets.expected_accuracy(100, 95, prior) > rulesets.expected_accuracy(10, 9, prior) > rulesets.expected_accuracy(10, 5, prior)
    assert rulesets.confirmation(100, 50, 50, 0) > 0 > rulesets.confirmation(100, 50, 50, 50)


def test_lazy_and_interval_learners(spark):
    data = [(i, "pqr"[i % 3], float(i % 10), "yes" if i % 3 == 0 or i % 10 > 6 else "no") for i in range(120)]
    df = spark.createDataFrame(data, "k int, a string, x double, y string")
    for model in (lazy.feature_intervals(df, ["a", "x"], "y"), lazy.pipes_model(df, ["a", "x"], "y"), naive_bayes(df, ["a", "x"], "y"), trees.c45(df, ["a", "x"], "y")):
        got = model.apply(df)
        assert got.where("prediction IS NULL").count() == 0 and abs(got.agg(F.avg(F.expr("aggregate(distribution, 0D, (s, x) -> s + x)"))).first()[0] - 1) < 1e-9
    assert trees.c45(df, ["a", "x"], "y").apply(df).where("prediction <> y").count() == 0
    parts = densities.cobweb(df, ["a", "x"], "k").groupBy("cluster").count().collect()
    assert sum(r["count"] for r in parts) == 120 and len(parts) > 1


def test_models_on_missing_values_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "p", 1.0, "u"), (2, None, None, "v"), (3, "q", 2.0, None), (4, "q", 3.0, "v")], "k int, a string, x double, y string")
    for learn in (naive_bayes, trees.c45, trees.id3, trees.random_tree, trees.stump):
        assert learn(df, ["a", "x"], "y").apply(df).where("prediction IS NULL").count() == 0
        assert learn(df.limit(0), ["a", "x"], "y").apply(df, "p", None).where("p IS NOT NULL").count() == 0
    assert learners.decision_stump(df.limit(0), "x", "y").collect()[0]["cut"] is None
    assert supervised.mdl_cuts(df.limit(0), "x", "y") == []
    model = learners.naive_bayes_counts(df.where("k = 1"), ["a"], "y")
    assert learners.naive_bayes_predict(df, model, ["a"], "y", "k", trained=df).count() == 4


def test_too_many_labels_are_an_error(spark):
    many = spark.range(20).selectExpr("id", "cast(id AS string) AS s")
    with pytest.raises(ValueError):
        columns.labels_of(many, "s", 10)
    assert len(transforms.nominal_to_binary(many, "s").columns) == 21


def test_outputs_as_an_archive_and_checks(spark):
    with zipfile.ZipFile(BytesIO(experiments.zipped({"b.txt": "two", "a.txt": "one"}))) as z:
        assert z.namelist() == ["a.txt", "b.txt"] and z.read("b.txt") == b"two"
    assert experiments.zipped({"a": "x"}) == experiments.zipped({"a": "x"})


def test_registry(spark):
    registry.register("scalar", "twice", lambda c: c * 2)
    with pytest.raises(ValueError):
        registry.register("scalar", "twice", None)
    with pytest.raises(KeyError):
        registry.find("learner", "none")
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert [r[0] for r in df.select(registry.find("scalar", "twice")(F.col("x"))).collect()] == [2.0, 6.0]
    assert registry.streamable(lambda d: d.where("x > 1"), df) and not registry.streamable(lambda d: d.distinct(), df)
    assert {"learner", "metric", "blocker", "loader", "saver", "search"} <= set(registry.kinds())


def test_database_tables(spark):
    url = "jdbc:derby:memory:brindle;create=true"
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "k int, s string, x double")
    try:
        sources.write_jdbc(df, url, "rows_of_test", mode="overwrite", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception as e:  # the database is not part of every Spark
        pytest.skip(str(e)[:80])
    assert sorted(map(tuple, sources.read_jdbc(spark, url, "rows_of_test").collect())) == [(1, "a", 2.5), (2, None, None)]


def test_row_filters_on_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, s string")
    empty = df.limit(0)
    assert rows.resampled(empty, "k").count() == 0 and rows.randomized(empty, "k").count() == 0
    assert rows.sorted_by_all(df).where("rid = 0").first()["k"] == 1
    assert rows.sort_aggregate(df, "k").first() == (2, 1)
    assert rows.range_join(df, "k", spark.createDataFrame([(1, 2), (5, 4)], "low int, high int"), "low", "high", 1.0).count() == 2
    with pytest.raises(ValueError):
        rows.concatenated(df, df.select("s", "k"))
