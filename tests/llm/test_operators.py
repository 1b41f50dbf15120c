"""Each operator against brute force or its library, with nulls, empty, long and repeated texts and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import brute_pii
from brindle.llm import bpe, langid, mix, nra, perplexity, pii, quality, queries, simhash, suffix, tokenbin

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, position double"
WORDS = "the of and ist der un la que río straße time word house stone water".split()


def texts():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", "s"]) for _ in range(n))
    shared = say(40)
    out = [say(rng.randint(1, 120)) for _ in range(50)]
    out += [out[0], out[1] + " end", say(10) + "\n" + shared + "\n" + say(10), shared + " " + say(30), say(5) + shared]
    out += [None, "", "  \n\t ", "One", "ONE two", "x" * 30_000, say(4000), "a\n" * 40, say(12) * 6, "日本 語 <|endoftext|> it's 4111 1111 1111 1111 a@b.co", "No 1.2.3.4 and +1 (499) 555-6503!"]
    return out


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    langs, sources = ["en", "de", None], ["s1", "s2", "s2", "s3", None]
    return spark.createDataFrame([(i, t, langs[i % 3], sources[i % 5], 1, 0.5, 7, None) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated ids and repeated rows."""
    t = "some words that are long enough to make up a passage of over fifty bytes here"
    return spark.createDataFrame([(None, t, None, None, 1, 0.5, 7, None), (3, t, "en", "s", 1, 0.5, 7, None), (3, t, "en", "s", 1, 0.5, 7, None), (3, "other", "en", "s", 1, 0.5, 7, None), (9, t, "de", None, 1, 0.5, 7, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, i % 2, 0) for i, _ in rows] + [(1, None, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, odd, empty, labels, rows):
    got = {r["doc_id"]: r for r in quality.scored(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert quality.scored(odd, labels).count() == 5 and quality.scored(empty, labels).count() == 0
    assert {r["score"] for r in quality.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.kept(odd, labels).columns == odd.columns


def test_quality_is_learned(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    both = quality.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in both]) > 0.95


def test_quality_cosines_are_exact():
    rng = np.random.default_rng(0)
    rows = np.abs(rng.normal(size=(60, quality.TERMS))).astype("float32")
    model = quality.fit(rows, rng.integers(0, 2, 60).astype(float), rank=8)
    z = model.latent(rows)
    near = np.argsort(-(z @ z.T), axis=1)[:, : quality.NEIGHBOURS]
    w = np.maximum(np.take_along_axis((z @ z.T).astype(float), near, 1), 0) + 1e-9
    assert np.allclose(model.score(rows), (w * model.labels[near]).sum(1) / w.sum(1), atol=1e-5)


def test_quality_query_equals_brute_force(spark, sf):
    """The whole result of op1 from terms, labels and cosines taken one by one in plain Python."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    known = sorted((r["doc_id"], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["doc_id"] in texts)
    model = quality.fit(np.array([quality.terms(texts[i]).astype("float16") for i, _ in known], "float32"), np.array([y for _, y in known], float))
    got = {r["doc_id"]: r for r in queries.op1_knn_quality(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        z = model.latent(quality.terms(t)[None, :])[0]
        near = sorted(((float(z @ v), y) for v, y in zip(model.vectors, model.labels)), reverse=True)[: quality.NEIGHBOURS]
        want = sum(max(c, 0) * y for c, y in near) / max(sum(max(c, 0) for c, _ in near), 1e-9)
        assert abs(got[i]["score"] - want) < 0.02 and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["predicted"] == (got[i]["score"] >= 0.7)


def test_words_are_terms():
    a, b, c = (quality.terms(t.encode())[quality.RUNS + quality.EXTRA :] for t in ("Stone house water", "water stone house house", "quite other words"))
    assert a @ b > 0.9 > 0.1 > a @ c


def test_base_counts_and_bands(docs, odd, empty, rows):
    for _, t in rows:
        assert perplexity.base_counts((t or "").encode()) == brute.base_counts(t)
    got = {r["doc_id"]: r for r in perplexity.judged(docs).collect()}
    assert len(got) == len(rows) and not got[rows[-1][0]]["kept"]
    assert all(not (r["kept"] and r["base_failed"]) for r in got.values())
    assert perplexity.judged(odd).count() == 5 and perplexity.judged(empty).count() == 0


def test_bands_reject_junk_and_keep_clean_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    both = perplexity.judged(docs).where("NOT base_failed").join(labels, "doc_id").where("crc32(cast(doc_id AS string)) % 4 <> 2").groupBy("quality")
    share = {r["quality"]: r["kept"] for r in both.agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share[0] < 0.6 and share[1] > 0.9


def test_counts_of_runs(docs, rows):
    want = Counter()
    for i, t in rows:
        if t:
            b = b"\x02" * 4 + t.encode()
            key = f"{['en', 'de', ''][i % 3]}/{brute.half(t.encode())}"
            for k in range(4, len(b)):
                want[key, int.from_bytes(b[k - 4 : k + 1], "big")] += 1
    counted = perplexity.counts(docs)
    assert {(r["key"], r["run"]): r["n"] for r in counted.collect()} == dict(want)
    slots = counted.select("key", "run", F.xxhash64("key", "run").bitwiseAND(F.lit((1 << perplexity.BITS) - 1)).alias("s")).collect()
    assert all(perplexity._slots(np.array([r["run"]]), r["key"])[0] == r["s"] for r in slots[:200])


def test_kneser_ney_equals_the_formulas(spark, rows):
    texts = [t.encode() for _, t in rows if t and brute.half(t.encode()) == 0]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    logp, met = brute.kneser_ney(texts)
    table = {r["code"]: r["value"] for r in perplexity.kneser_ney(perplexity.counts(df)).where("key = 'en/0'").collect()}
    code = lambda run: int.from_bytes(run, "big") + (len(run) << perplexity.SHIFT)
    assert max(abs(table[code(r)] - logp(r)) for r in met) < 1e-9
    assert {c for c in table if c >> perplexity.SHIFT == 5} == {code(r) for r in met}
    for context in [r[:-1] for r in sorted(met)[::200]]:  # what follows a context sums to one
        assert abs(sum(np.exp(logp(context + bytes([x]))) for x in range(256)) - 1) < 1e-9


def test_perplexity_query_equals_brute_force(spark, sf):
    """The whole result of op2: counts, base, perplexities by the other half's model, and bands, by plain Python."""
    docs = [(r["doc_id"], r["lang"] or "", (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    model = {(g, h): brute.kneser_ney([t for _, x, t in docs if x == g and brute.half(t) == h])[0] for g in {g for _, g, _ in docs} for h in (0, 1)}
    rows, base = [], {}
    for i, lang, t in docs:
        n = base[i] = brute.base_counts(t.decode())
        b, logp = b"\x02" * 4 + t, model[lang, 1 - brute.half(t)]
        score = -sum(logp(b[k : k + 5]) for k in range(len(t))) / len(t) if t else None
        rows.append((i, lang, len(t), n[0] < 20 or 100 * n[4] > 30 * n[0], score))
    kept = brute.bands(rows)
    got = {r["doc_id"]: r for r in queries.op2_kn_perplexity(spark, sf).collect()}
    assert got.keys() == kept.keys()
    for i, _, _, failed, score in rows:
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base[i] and r["base_failed"] == failed
        assert r["log_perplexity"] == pytest.approx(score, abs=1e-5) if score is not None else r["log_perplexity"] is None
    assert sum(got[i]["kept"] != k for i, k in kept.items()) <= 1  # a text at the very edge may fall to either side


def test_bands_have_two_sides(spark, sf):
    """Texts of one word over and over are too easy, texts of random bytes too hard: both are outside."""
    rng = random.Random(1)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' AND length(text) BETWEEN 800 AND 6000").select("doc_id", "text", "lang")
    easy = [" ".join(f"{rng.choice(('the', 'and', 'of'))} {rng.choice('abcdefghij')}" for _ in range(400)) for _ in range(3)]
    hard = [" ".join("".join(rng.choice("qxzjkvwQXZJ0123456789") for _ in range(6)) for _ in range(300)) for _ in range(3)]
    more = spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(easy + hard)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in perplexity.judged(docs.unionByName(more)).collect()}
    middle = np.median([r["log_perplexity"] for i, r in got.items() if i >= 0])
    assert all(got[-1 - i]["log_perplexity"] < middle and not got[-1 - i]["kept"] for i in range(3))
    assert all(got[-4 - i]["log_perplexity"] > middle and not got[-4 - i]["kept"] for i in range(3))
    assert np.mean([r["kept"] for i, r in got.items() if i >= 0 and not r["base_failed"]]) > 0.8


def test_entries_beyond_the_broadcast_give_the_same_scores(spark, sf, docs):
    many = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(perplexity.fit(many)[0]) == perplexity.kneser_ney(perplexity.counts(many)).count()
    whole, parted = perplexity.fit(docs), perplexity.fit(docs, 300)
    assert whole[2] is None and 0 < len(parted[0]) <= 300 and parted[2].count() == len(whole[0])
    other = docs.withColumn("text", F.concat(F.lit("quite unseen ~~~ "), F.col("doc_id")))
    for texts in (docs, other):
        want, got = ({r["doc_id"]: r["log_perplexity"] for r in perplexity.scored(texts, m).collect()} for m in (whole, parted))
        assert want.keys() == got.keys() and all(want[i] == pytest.approx(got[i], abs=1e-6) for i in want)


def test_simhash_groups(docs, odd, empty, rows, monkeypatch):
    want = brute.groups(rows)
    for tile, blocks in ((simhash.TILE, None), (8, 5)):
        monkeypatch.setattr(simhash, "TILE", tile)
        got = {r[0]: (r[1], r[2]) for r in simhash.components(docs, blocks=blocks).select("doc_id", simhash.hexadecimal(), "component_id").collect()}
        assert got == want
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == sorted({c for _, c in want.values()})
    clash = docs.withColumns({"_row": F.lit(1), "_id": F.lit(2), "__row": F.lit(3)})
    assert simhash.deduplicated(clash).columns == clash.columns
    assert {r["component_id"] for r in simhash.components(odd).collect()} == {3}
    assert sorted((r["doc_id"], r["text"][:5]) for r in simhash.deduplicated(odd).collect()) == [(3, "other"), (3, "some ")]
    assert simhash.components(empty).count() == 0 and simhash.deduplicated(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.components(docs, radius=4, blocks=4)


def test_groups_along_a_chain(spark, monkeypatch):
    """Numbers that rise along a chain take few rounds, and each group has one root."""
    monkeypatch.setattr(simhash, "PLAIN", 1)
    chain = spark.range(60).selectExpr("id AS a", "id + 1 AS b").where("a % 20 <> 19")
    got = simhash.contracted(chain).collect()
    assert len(got) == 60 and all(len({r["root"] for r in got if r["node"] // 20 == k}) == 1 for k in range(3)) and len({r["root"] for r in got}) == 3


def test_few_links_are_joined_in_few_jobs_and_many_in_rounds(spark, monkeypatch):
    """Each round costs the driver several jobs; both ways give the same groups."""
    chain = spark.range(60).selectExpr("id * 7 % 60 AS x").selectExpr("x AS a", "x + 1 AS b").where("a % 20 <> 19")
    jobs = lambda g: len(spark.sparkContext.statusTracker().getJobIdsForGroup(g))
    found = {}
    for few in (500_000, 10):
        monkeypatch.setattr(simhash, "FEW", few, raising=False)
        spark.sparkContext.setJobGroup(f"links-{few}", "")
        got = simhash.contracted(chain)
        found[few] = jobs(f"links-{few}")
        rows = got.collect()
        assert len(rows) == 60 and len({r["root"] for r in rows}) == 3 and all(len({r["root"] for r in rows if r["node"] // 20 == k}) == 1 for k in range(3))
    spark.sparkContext.setJobGroup("", "")
    assert found[500_000] <= 10 < found[10]
    assert simhash.contracted(chain.limit(0)).count() == 0


def test_the_driver_does_not_fit_the_quality_model(spark, sf, monkeypatch):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = sorted(map(tuple, quality.scored(docs, labels).collect()))
    monkeypatch.setattr(np.linalg, "svd", None)  # here, not in the tasks
    assert sorted(map(tuple, quality.scored(docs, labels).collect())) == want and quality.kept(docs, labels).count() > 0


def test_a_larger_store_of_words_learns_less_and_encodes_alike(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{''.join(rng.choices('rstuv', k=5))}" for _ in range(300)).encode() for _ in range(40)]
    met, got = {}, {}
    for words, letters in ((600, 300), (tokenbin.KEPT_WORDS, tokenbin.KEPT_LETTERS)):
        e = bpe.encoder(queries.word_bpe(), words, letters)
        learn, met[words] = e._learn, 0

        def counted(new, learn=learn, words=words):
            met[words] += len(new)
            learn(new)

        monkeypatch.setattr(e, "_learn", counted)
        got[words] = [x for t in texts for x in e.encode([t])]
    assert got[600] == got[tokenbin.KEPT_WORDS] and met[tokenbin.KEPT_WORDS] < 0.9 * met[600]


def test_trees_find_the_groups_of_all_pairs():
    rng = np.random.default_rng(1)
    key = rng.integers(0, 2**63, 12, dtype="uint64")[rng.integers(0, 12, 900)]
    for _ in range(5):
        key = np.where(rng.random(900) < 0.7, key ^ (np.uint64(1) << rng.integers(0, 64, 900).astype("uint64")), key)
    key = np.unique(key)
    shard = np.sort(rng.integers(0, 4, len(key)))
    got = simhash.Forest(shard, key).links(3)
    near = (np.bitwise_count(key[:, None] ^ key[None, :]) <= 3) & (shard[:, None] == shard[None, :])
    want = np.arange(len(key))
    while True:
        new = np.where(near, want[None, :], len(key)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_bpe_equals_the_library(docs, odd, empty, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_bpe())
    for r in bpe.decode(bpe.encode(docs, queries.word_bpe()), queries.word_bpe()).collect():
        ids = t.encode(rows[r["doc_id"]][1] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids) and r["decoded"] == t.decode(ids, skip_special_tokens=False)
    both = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert both(bpe.round_trip(docs, queries.word_bpe())) == both(bpe.decode(bpe.encode(docs, queries.word_bpe()), queries.word_bpe()))
    assert bpe.encode(odd, queries.word_bpe()).count() == 5 and queries.bpe_digest(empty).count() == 0


def test_chunks_are_reused_and_follow_content():
    rng = random.Random(2)
    body = " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(4000)).encode()
    chunks = bpe.ChunkEncoder(bpe.encoder(queries.word_bpe()))
    plain = bpe.WordEncoder(queries.word_bpe())
    both = [body, b"moved " + body, body[:9000] + b" X " + body[9000:]]
    assert chunks.encode(both) == plain.encode(both) and chunks.made < 0.6 * chunks.met
    for size in (4, 16, 64):
        cuts = bpe.cuts_of(body, size)
        assert cuts[-1] == len(body) and sorted(set(cuts)) == cuts


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 12)).round(2)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 12), (303, [float("inf")] * 12), (304, [0.5]), (305, []), (None, [1.0] * 12), (350, [0.25]), (400, [])]
    data += [(500, [float(x) for x in vectors[0]])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = [tuple(r) for r in nra.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in data if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert nra.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def read_through(q, qid, blocks, k):
    reader = nra.Reader(q, qid, k)
    for v, ids in blocks:
        reader.block(v, ids)
    return reader, {i: g[["score", "vec_id"]].to_numpy().tolist() for i, g in reader.rows().groupby("query_id")}


def test_bounds_stop_early_and_stay_exact():
    rng = np.random.default_rng(4)
    v = (rng.pareto(1.5, size=(900, 32)) * 20).astype("int64") * rng.choice([-1, 1], 32)
    q = (rng.pareto(1.0, size=(7, 32)) * 20).astype("int64") * rng.choice([-1, 1], 32)
    reader, got = read_through(q, np.arange(-7, 0), [(v[:400], np.arange(400)), (v[400:], np.arange(400, 900))], 5)
    for k in range(7):
        assert got[k - 7] == [[-s, i] for s, i in sorted((-int(x), i) for i, x in enumerate(v @ q[k]))[:5]]
    assert 0 < reader.read < 0.6 * reader.there


def test_lists_of_real_vectors_are_not_read_through(spark):
    """The share of list entries read at sf0.1 is well below 1, also where nothing is skewed."""
    rows = nra.quantised(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).limit(4096).collect()
    v, ids = np.array([r["v"] for r in rows], "int64"), np.array([r["vec_id"] for r in rows])
    ask = ids % 50 == 0
    reader, got = read_through(v[ask], ids[ask], [(v[a : a + 2048], ids[a : a + 2048]) for a in (0, 2048)], 5)
    assert reader.read < 0.9 * reader.there
    for i, q in zip(ids[ask], v[ask]):
        assert got[i] == [[-s, j] for s, j in sorted((-int(x), int(j)) for j, x in zip(ids, v @ q) if j != i)[:5]]


def test_scores_beyond_exact_floats():
    v = np.array([[1 << 29, 3], [1 << 29, 4], [1, 1]] * 20, "int64")
    _, got = read_through(v[:2], np.array([-1, -2]), [(v, np.arange(60))], 5)
    assert got[-2] == [[(1 << 58) + 16, i] for i in (1, 4, 7, 10, 13)]


def test_mix(docs, odd, empty, rows):
    got = {r["doc_id"]: r for r in mix.curriculum_mix(docs).collect()}
    sizes = {i: len(brute.WORD.findall(t or "")) for i, t in rows}
    sources = ["s1", "s2", "s2", "s3", None]
    total = Counter()
    for i, n in sizes.items():
        total[sources[i % 5]] += n
    order = ["s1", "s2", "s3", None]
    target, free = {}, {s: 1 + k % 3 for k, s in enumerate(order)}
    left = sum(total.values())
    while free:
        level = left / sum(free.values())
        full = [s for s, w in free.items() if w * level > 3 * total[s]]
        if not full:
            target |= {s: w * level for s, w in free.items()}
            break
        for s in full:
            target[s] = 3 * total[s]
            left -= target[s]
            del free[s]
    taken = Counter()
    for i, r in got.items():
        s = sources[i % 5]
        taken[s] += r["taken"]
        assert r["size"] == sizes[i] and r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6 * target[s] and r["taken"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
    assert all(abs(taken[s] - target[s]) <= 1.0 * max(sizes.values()) for s in order)
    again = {r["doc_id"]: (r["taken"], r["position"]) for r in mix.curriculum_mix(docs.repartition(5)).collect()}
    assert again == {i: (r["taken"], r["position"]) for i, r in got.items()}
    assert mix.curriculum_mix(odd).count() == 5 and mix.curriculum_mix(empty).count() == 0
    assert mix.training_order(docs, mix.curriculum_mix(docs)).columns == docs.columns
    clash = odd.withColumns({"_at": F.lit(1), "_row": F.lit(2)})
    assert mix.ordered(clash).columns == clash.columns and mix.ordered(clash).count() >= 4
    words = docs.select("doc_id", "source", F.col("text"))
    for r in mix.curriculum_mix(words).collect():
        assert len(r["positions"]) == (r["taken"] // r["size"] if r["size"] else 0) and r["positions"] == sorted(r["positions"])


def test_mix_query_equals_brute_force(spark, sf):
    """The whole result of op6: targets, what is taken and every training position."""
    rows = [(r["doc_id"], r["source"], len(brute.WORD.findall(r["text"] or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute.mixed(rows)
    got = {r["doc_id"]: r for r in mix.curriculum_mix(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got.keys() == want.keys() and {i: r["taken"] for i, r in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(got[i]["positions"] == pytest.approx(at, abs=1e-9) for i, (_, at) in want.items())
    ours = {r["doc_id"]: (r["taken"], r["position"]) for r in queries.op6_curriculum_mix(spark, sf).collect()}
    assert ours == {i: (r["taken"], r["position"]) for i, r in got.items()}


def test_schedules_invert():
    for schedule in (([0, 1], [0.5, 1.5]), ([0, 0.3, 1], [2, 0, 1]), ([0, 1], [1, 1])):
        u, w, area = mix.cumulative(schedule)
        share = np.linspace(0, 1, 41)
        t = mix.invert(schedule, share)
        back = np.array([np.trapezoid(np.interp(g := np.linspace(0, x, 4001), u, w), g) for x in t])
        assert np.allclose(back, share, atol=1e-5) and (np.diff(t) >= -1e-12).all()
    with pytest.raises(ValueError):
        mix.cumulative(([0, 1], [0, 0]))


def test_network_gradients():
    net = langid.Network.fresh(["a", "b", "c"], units=3)
    net.tables, net.recurrent = [x.astype("float64") for x in net.tables], [x.astype("float64") for x in net.recurrent]
    net.out, net.bias = net.out.astype("float64"), net.bias.astype("float64")
    rng = np.random.default_rng(1)
    data, target, mask = rng.integers(0, 256, (9, 5)).astype("uint8"), rng.integers(0, 3, 5), np.ones((9, 5))
    mask[6:, 1] = 0
    _, grads = net.gradients(data, target, mask)
    for p, g in zip(net.parameters(), grads):
        i = (rng.integers(0, p.shape[0]), data[3, 2] if p.shape[1] == 256 else rng.integers(0, p.shape[1]))
        p[i] += 1e-3
        up = net.gradients(data, target, mask)[0]
        p[i] -= 2e-3
        down = net.gradients(data, target, mask)[0]
        p[i] += 1e-3
        assert abs((up - down) / 2e-3 - g[i]) < 1e-4


def test_languages(spark, docs, odd, empty, rows):
    got = {r["doc_id"]: r for r in langid.identified(docs).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    for i, t in rows:
        assert (got[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")), (i, t)
    assert langid.identified(odd).count() == 5 and langid.identified(empty).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = langid.identified(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in both]) > 0.95


def test_all_languages_and_whole_texts_are_learned(spark, monkeypatch):
    taught = {}
    monkeypatch.setattr(langid, "train", lambda rows, languages: taught.update(rows=rows, languages=languages))
    docs = [(i, "".join(chr(97 + (i + k // 320) % 26) * 1 for k in range(3000)), f"l{i % 90:02d}") for i in range(270)]
    langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), sample=100_000)
    assert taught["languages"] == sorted({x for _, _, x in docs})
    use = [(i, t, x) for i, t, x in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    assert Counter(taught["rows"]) == Counter((x, t[k : k + 320].encode()) for _, t, x in use for k in range(0, 3000, 320))
    langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), sample=180)
    assert 90 < len(taught["rows"]) < 300


def test_language_query_equals_brute_force(spark, sf):
    """The whole result of op7 with the states stepped one byte and one document at a time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identified(docs, net).collect()}
    step = lambda x: np.clip(0.25 * x + 0.5, 0, 1)
    for r in docs.collect():
        data, h_n, total = (r["text"] or "").encode(), langid.UNITS, np.zeros(len(net.languages))
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        data = data[: 10 * langid.SEGMENT] if r["doc_id"] % 50 else data
        if len(data) < len((r["text"] or "").encode()):
            continue
        for a in range(0, len(data), langid.SEGMENT):
            part = data[a : a + langid.SEGMENT]
            both = []
            for side in range(2):
                h, states = np.zeros(h_n), []
                for x in part if side == 0 else part[::-1]:
                    g, t = net.recurrent[side] @ h, net.tables[side][:, x]
                    z, reset = step(t[:h_n] + g[:h_n]), step(t[h_n : 2 * h_n] + g[h_n : 2 * h_n])
                    h = h + z * (np.tanh(t[2 * h_n :] + reset * g[2 * h_n :]) - h)
                    states.append(h)
                both.append(states if side == 0 else states[::-1])
            for f, b in zip(*both):
                e = np.exp(net.out @ np.concatenate([f, b]) + net.bias[:, 0])
                total += e / e.sum()
        total /= len(data)
        assert abs(got[r["doc_id"]]["score"] - total.max()) < 1e-3 and total[net.languages.index(got[r["doc_id"]]["lang_pred"])] > total.max() - 1e-3


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, odd, empty, rows, tmp_path, encoding):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_bpe())
    path = tokenbin.write(docs, queries.word_bpe(), str(tmp_path / "x"), encoding=encoding, row_group_bytes=1 << 20)
    got = {r["doc_id"]: r for r in tokenbin.digest(tokenbin.read(spark, path)).collect()}
    start = 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert tokenbin.read(spark, path, ["doc_id", "n_tokens"]).columns == ["doc_id", "n_tokens"]
    import pyarrow.parquet as pq

    part = pq.ParquetFile(sorted((tmp_path / "x").glob("*.parquet"))[0]).metadata.row_group(0)
    ids = next(c for c in (part.column(i) for i in range(part.num_columns)) if c.path_in_schema.startswith("token_ids"))
    assert ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta") and any("DICTIONARY" in e for e in ids.encodings) == (encoding == "dictionary")
    assert ids.has_offset_index and ids.has_column_index
    assert tokenbin.read(spark, tokenbin.write(odd, queries.word_bpe(), str(tmp_path / "o"))).count() == 5
    assert tokenbin.read(spark, tokenbin.write(empty, queries.word_bpe(), str(tmp_path / "e"))).count() == 0


def test_row_groups_and_selective_reads(spark, tmp_path):
    """Sizes take effect, a small column is read alone, and some documents are found by their range of ids."""
    import pyarrow.parquet as pq

    rng = random.Random(8)
    df = spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=600))) for i in range(3000)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tokenbin.write(df, queries.word_bpe(), str(tmp_path / "small"), row_group_bytes=1 << 19, page_bytes=1 << 12)
        tokenbin.write(df, queries.word_bpe(), str(tmp_path / "large"), row_group_bytes=64 << 20, page_bytes=1 << 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    groups = {n: [g for p in (tmp_path / n).glob("*.parquet") for f in [pq.ParquetFile(p).metadata] for g in map(f.row_group, range(f.num_row_groups))] for n in ("small", "large")}
    assert len(groups["small"]) > 2 * len(groups["large"])
    ranges = sorted((g.column(0).statistics.min, g.column(0).statistics.max) for g in groups["small"])
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))  # a range of ids lies in few row groups
    some = tokenbin.read(spark, str(tmp_path / "small"), ["doc_id", "n_tokens"]).where("doc_id BETWEEN 100 AND 103")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in plan.split("ReadSchema")[1].split("\n")[0] and "PushedFilters" in plan and "GreaterThanOrEqual(doc_id,100)" in plan
    assert sorted(r["doc_id"] for r in some.collect()) == [100, 101, 102, 103]


def test_personal_data(spark, docs, odd, empty):
    rng = random.Random(7)
    tricky = ["a@b.c%d@e.f", None, "", "9" * 5000, "1.2.3.4.5.6.7.8 00255.1.1.1 256.1.1.1", "4111 1111 1111 1111 +1 (499) 555-6503) +49 30 1234567 8", "😀 a.b@c.de 😀 1.2.3.4", "a@" * 500 + "b.c"]
    tricky += ["".join(rng.choice("aB1 2.3@-+(9) 4\n_%5") for _ in range(rng.randint(5, 80))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    for r in pii.detect(df).collect():
        want = brute_pii.base(tricky[r["doc_id"]])
        assert {k: [(x["start"], x["end"]) for x in r["_" + k]] for k in want} == want
        assert set(map(tuple, r["_base"])) <= set(map(tuple, r["_spans"]))
    row = pii.summarise(pii.detect(df.where("doc_id = 5"))).first()
    assert row["n_card"] == 1 and row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for _, _, k, a, b in sorted((a, pii.KINDS.index(k), k, a, b) for k, v in brute_pii.base(tricky[5]).items() for a, b in v)).encode()).hexdigest()
    assert pii.redact(spark.createDataFrame([(1, "me@x.org, 1.2.3.4!", 1)], "doc_id long, text string, score int")).first()["text"] == "[EMAIL], [IP]!"
    assert pii.summarise(pii.detect(odd)).count() == 5 and pii.summarise(pii.detect(empty)).count() == 0 and pii.redact(docs).columns == docs.columns


def test_reliabilities_are_learned():
    votes = {"phone:++++0": 60, "phone:+0++0": 20, "phone:0---0": 70, "phone:00-+0": 15}
    model = pii.estimate(votes)
    assert model.posterior["phone:++++0"] > 0.95 > 0.05 > model.posterior["phone:0---0"]
    assert model.reliability["phone", "shape"]["+"][0] > 0.6 > 0.2 > model.reliability["phone", "shape"]["+"][1]


def test_a_failed_check_is_not_outvoted():
    """Counts as they are in real tables, where most numbers look right: no mode in which everything is personal data."""
    votes = {"card:++0++": 165, "card:+00+-": 103, "card:++0+-": 55, "card:+00++": 12, "card:+0-+-": 1, "ip:+00++": 178}
    post = pii.estimate(votes).posterior
    assert min(post["card:++0++"], post["card:+00++"]) > 0.9 and max(post[p] for p in votes if p.startswith("card") and p.endswith("-")) < 0.2


def test_spans_of_many_matches_are_whole(spark):
    """Offsets over many parts, and candidates beside base spans, as in plain Python."""
    text = " ".join(f"u{i}@mail.org né {i}" for i in range(3000)) + " tel (030) 555-1234 or (040) 555-9876"
    row = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(x["start"], x["end"]) for x in row["_email"]] == brute_pii.base(text)["email"]
    spans = [(x["start"], x["end"]) for x in row["_spans"]]
    assert spans == sorted(spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_personal_data_query_equals_brute_force(spark, sf):
    """The whole base part of op9, and its added spans by the trained weights in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = pii.fit(docs)
    found = pii.with_candidates(pii.with_base(docs)).select("doc_id", "_cand").collect()
    cands = {r["doc_id"]: [(x["start"], x["end"], x["kind"], model.bias[x["kind"]] + sum(model.weight.get(f, 0) for f in x["features"])) for x in r["_cand"]] for r in found}
    got = {r["doc_id"]: r for r in queries.op9_weak_pii(spark, sf).collect()}
    for r in docs.collect():
        base = [(a, pii.KINDS.index(k), b, k) for k, v in brute_pii.base(r["text"]).items() for a, b in v]
        more = [(a, pii.KINDS.index(k), b, k) for a, b, k, s in cands[r["doc_id"]] if s >= np.log(0.98 / 0.02) and not any(x < b and a < y for x, _, y, _ in base)]
        say = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert got[r["doc_id"]]["spans"] == say(base + more) and got[r["doc_id"]]["base_sha256"] == hashlib.sha256(say(base).encode()).hexdigest()
        assert [got[r["doc_id"]][f"n_{k}"] for k in pii.KINDS] == [sum(x[3] == k for x in base) for k in pii.KINDS]


@pytest.mark.parametrize("block,hot", [(2 << 20, 4096), (3000, 1)])
def test_repeats(spark, docs, odd, empty, rows, monkeypatch, block, hot):
    monkeypatch.setattr(suffix, "BLOCK", block)
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(9)
    passage = "Shared passage that is more than fifty bytes long, indeed é."
    more = [(1000 + k, "".join(rng.choice("ab") for _ in range(rng.randint(0, 300)))) for k in range(30)] + [(2000, "x" * 900), (2001, "x" * 60), (2002, "yx" * 90), (2003, "z" * 49), (2004, "z" * 50), (2005, "z" * 50)]
    more += [(3000 + k, "".join(rng.choice("cdefgh ") for _ in range(80)) + passage + "".join(rng.choice("cdefgh ") for _ in range(80))) for k in range(40)]
    more += [(None, rows[0][1]), (3, rows[5][1]), (3, rows[0][1])]
    everything = rows + more
    df = spark.createDataFrame(everything, "doc_id long, text string").repartition(4)
    got = {}
    for r in suffix.deduplicated(df).collect():
        got.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()))
    assert {k: sorted(v) for k, v in got.items()} == brute.repeats(everything)
    assert suffix.deduplicated(odd).count() == 5 and suffix.deduplicated(empty).count() == 0
