"""The stages one by one: what each keeps and that its decisions show."""

import random

import numpy as np
import pytest

import corpus_pipeline
from brindle.llm import mix, neardup, quality, queries


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r[0] for r in quality.scored(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "personal_data", "mix_sources", "bpe_encode"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before.columns
        if k == 0:
            assert {r[0] for r in docs.select("doc_id").collect()} == good
        if k == 2:
            assert docs.count() == before.count() and docs.where("text rlike '[a-z0-9.]+@mail'").count() == 0
        if k == 3:
            taken = mix.curriculum_mix(before).selectExpr("sum(if(size > 0, taken / size, 0))").first()[0]
            assert docs.count() == round(taken)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() == corpus_pipeline.run(spark, sf).count()
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, queries.bpe_digest(docs).collect()))


def jaccard_groups(texts, least=0.8):
    """The group of each text over all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b) > 0:
                group = [group[j] if g == group[i] else g for g in group]
    return group


@pytest.mark.parametrize("strays,tile", [(512, 2048), (3, 4)])
def test_near_copies_are_dropped(spark, monkeypatch, strays, tile):
    monkeypatch.setattr(neardup, "STRAYS", strays)
    monkeypatch.setattr(neardup, "TILE", tile)
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 8):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += ["One two", "ONE  two", "one", "", None, " ", "a b c d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    group = jaccard_groups(texts)
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    assert sorted(r[0] for r in corpus_pipeline.simhash_near_dedup(spark, df, "").select("doc_id").collect()) == sorted(first.values())


def test_near_dedup_searches_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(12)
    fps = [int(x) for x in rng.integers(-(2**63), 2**63, 40)]
    for d in (0, 1, 4, 6, 7, 9):
        for base in fps[:10]:
            flips = sum(1 << int(b) for b in rng.choice(63, d, replace=False))
            fps.append(base ^ flips)
    nodes = spark.createDataFrame(list(enumerate(fps)), "node long, fp long")
    root = list(range(len(fps)))
    for a, x in enumerate(fps):
        for b in range(a):
            if ((x ^ fps[b]) & (1 << 64) - 1).bit_count() <= neardup.RADIUS:
                root = [root[b] if r == root[a] else r for r in root]
    got = list(range(len(fps)))
    for r in neardup.simhash_candidates(nodes).collect():
        got = [got[r["b"]] if x == got[r["a"]] else x for x in got]
    tell = lambda label: sorted(sorted(i for i, x in enumerate(label) if x == y) for y in set(label))
    assert tell(got) == tell(root) and max(map(len, tell(got))) > 3
    asked = []
    real = neardup.edges
    monkeypatch.setattr(neardup, "edges", lambda df, *a: asked.append(a) or real(df, *a))
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60 + i % 2)), "en", "s", 1) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.simhash_near_dedup(spark, docs, "").count() == 1 and asked[0][0] == neardup.RADIUS


def test_linked_sets_are_those_of_all_pairs():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(12):
        x = np.unique(rng.integers(0, 2**63, 50, dtype="uint64"))
        for _ in range(8):
            sets.append(x)
            x = np.unique(np.where(rng.random(len(x)) < 0.08, rng.integers(0, 2**63, len(x), dtype="uint64"), x))
    near = np.array([[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets])
    want = np.arange(len(sets))
    while (new := np.where(near, want[None, :], len(sets)).min(axis=1)).tolist() != want.tolist():
        want = new
    got = neardup.linked(sets)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want)) > 12
    assert all(neardup.alike(a.tobytes(), b.tobytes()) == near[i, j] for i, a in enumerate(sets) for j, b in enumerate(sets))
    piece = np.where(want == want[0], want, np.arange(len(sets)))  # one group is known, the others are asked for
    got = neardup.linked(sets, piece, want != want[0])
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_null_and_repeated_ids_lose_no_text(spark):
    say = lambda k: " ".join(f"t{k}x{i}" for i in range(40))
    ids = [(None, 0), (3, 0), (3, 0), (3, 1), (9, 0), (None, 2), (None, 3), (2, 1), (3, 4), (5, 4)]
    df = spark.createDataFrame([(i, say(k), "s") for i, k in ids], "doc_id long, text string, source string")
    kept = corpus_pipeline.simhash_near_dedup(spark, df, "")
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(repr, [(3, say(0)), (2, say(1)), (None, say(2)), (None, say(3)), (3, say(4))]))
    mixed = corpus_pipeline.mix_sources(spark, kept, "")
    assert sorted(r["text"] for r in mixed.collect()) == sorted(say(k) for k in range(5)) and mixed.columns == df.columns
    empty = df.limit(0)
    assert corpus_pipeline.simhash_near_dedup(spark, empty, "").count() == 0 and corpus_pipeline.mix_sources(spark, empty, "").count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, _at int, _id int, position double, size int"


def strange(spark):
    """Null and repeated ids, null, empty, blank and long texts, repeated rows, null sources and clashing column names."""
    rng = random.Random(11)
    long = " ".join(f"w{rng.randrange(50_000)}" for _ in range(400_000))  # over 2 MB
    say = lambda k: " ".join(f"t{k}x{i}" for i in range(60)) + f" me{k}@mail.org 4111 1111 1111 1111"
    rows = [(1, say(1), "en", "a"), (1, say(2), "en", "a"), (1, say(1), "en", "a"), (None, say(3), None, None), (None, say(4), "de", "b"), (5, None, "en", "a"), (6, "", "en", None), (7, " \n ", "en", "b"), (8, long, "en", "a"), (9, say(5), "en", "b"), (10, say(5), "en", "b")]
    return spark.createDataFrame([(*r, 3, 1, 2, 3, 0.5, 4) for r in rows], SCHEMA).repartition(2), rows, long


def test_every_stage_on_strange_tables(spark, tmp_path):
    docs, rows, long = strange(spark)
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, 0), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    sf = str(tmp_path / "sf")
    labels.write.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted(repr((r["doc_id"], r["text"])) for r in df.select("doc_id", "text").collect())

    good = stages["quality_classifier"](spark, docs, sf)
    assert good.columns == docs.columns and set(texts(good)) <= set(texts(docs))
    scores = {r["text"]: r["score"] for r in docs.select("text").distinct().join(quality.scored(docs.withColumn("doc_id", docs["text"]), labels.withColumn("doc_id", labels["doc_id"].cast("string"))).withColumnRenamed("doc_id", "text"), "text").collect()}
    assert all(0 <= s <= 1 for s in scores.values())

    kept = stages["simhash_near_dedup"](spark, docs, sf)
    assert kept.columns == docs.columns
    assert texts(kept) == sorted(map(repr, [(1, rows[0][1]), (1, rows[1][1]), (None, rows[3][1]), (None, rows[4][1]), (5, None), (8, long), (9, rows[9][1])]))

    clean = stages["personal_data"](spark, docs, sf)
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in clean.collect()]
    assert clean.columns == docs.columns and len(got) == len(rows)
    assert all(n == (None if t is None else len(t)) for _, t, n in got) and not any("@mail" in (t or "") or "4111" in (t or "") for _, t, _ in got)
    assert sum(t is None for _, t, _ in got) == 1 and any(t == long for _, t, _ in got)

    mixed = stages["mix_sources"](spark, docs, sf)
    assert mixed.columns == docs.columns
    assert not any(not (r["text"] or "").split() for r in mixed.select("text").collect())

    encoded = stages["bpe_encode"](spark, docs, sf).collect()
    assert len(encoded) == len(rows) and sum(r["n_tokens"] == 0 for r in encoded) == 3


def test_every_stage_on_an_empty_table(spark, tmp_path):
    docs = strange(spark)[0].limit(0)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
