"""Quality rules: counts on the text, then bands of n-gram perplexity by language.

The model is a modified Kneser-Ney model over runs of ``ORDER`` bytes, two for each language: texts are dealt into two
halves by their hash, and each text is scored by the model of the half that it (and every copy of it) is not in, so that
junk does not vouch for itself.  Spark counts the runs of all documents; continuation counts, the three discounts and the
interpolation of each order are joins and aggregations of those counts.  Scoring needs the probability of each run that
was met, of every order, and the weight of each context for going down an order; it looks for the whole run and goes down
until a run is found.  All of this grows with the runs of the corpus.  Up to ``MOST`` of the most frequent entries are
broadcast as sorted arrays of hashes (``BITS`` bits, so that entries do not share one) and logarithms; where there are
more, all are kept as a table too, and what the broadcast does not know is joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import batches_of, parts_for, ready, staged
from .bpe import texts_of

ORDER, BITS = 5, 63
#: An entry's code: the run or context in the low bits, its order above them, and a mark where it is a context's weight.
SHIFT, WEIGHT = 8 * ORDER, 1 << 8 * ORDER + 4
#: Entries that are broadcast, of 12 bytes each.
MOST = 1 << 22
#: Distinct runs that a task holds before it passes their counts on.
HELD = 2_000_000
#: Half width of a band in interquartile ranges of texts of that length; texts that a class of lengths needs to be measured.
WIDE, MEASURED = 2.0, 16
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0
    b = np.frombuffer(text, np.uint8)
    chars = int(((b & 0xC0) != 0x80).sum()) - int(SPACE[b].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > 8:
        h = np.fromiter(map(hash, words), "int64", n).view("uint64")
        with np.errstate(over="ignore"):
            for width in (1, 2, 4):
                h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + (h[width:] ^ (h[width:] >> np.uint64(31)))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            hit = np.zeros(n + 1, "int64")
            twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            at = order[twice]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + 8, -1)
            repeated = int((np.cumsum(hit[:-1]) > 0).sum())
    return n, chars, int(SYMBOL[b].sum()), len(lines) - len(set(lines)), repeated


def _runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The run that ends at each byte of the texts, as a number, and each text's bytes; texts begin with a mark."""
    size = np.array([len(t) for t in texts], "int64")
    data = np.frombuffer(b"".join(b"\x02" * (ORDER - 1) + t for t in texts), np.uint8).astype("int64")
    if not size.sum():
        return np.zeros(0, "int64"), size
    run = data[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        run |= data[ORDER - 1 - k : len(data) - k] << (8 * k)
    own = np.ones(len(data), bool)
    start = np.cumsum(size + ORDER - 1) - size - (ORDER - 1)
    for k in range(ORDER - 1):
        own[start + k] = False
    return run[own[ORDER - 1 :]], size


def _slots(code: np.ndarray, key: str) -> np.ndarray:
    """Spark's xxhash64(key, code), cut to BITS bits."""
    seed = xxhash.xxh64_intdigest(key.encode(), 42)
    p1, p2, p3, p4, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
    u = np.uint64
    with np.errstate(over="ignore"):
        x = code.view("uint64") * u(p2)
        x = (x << u(31) | x >> u(33)) * u(p1)
        x ^= u((seed + p5 + 8) & ((1 << 64) - 1))
        x = (x << u(27) | x >> u(37)) * u(p1) + u(p4)
        x ^= x >> u(33)
        x *= u(p2)
        x ^= x >> u(29)
        x *= u(p3)
        x ^= x >> u(32)
    return (x & u((1 << BITS) - 1)).astype("int64")


def key_of(other: bool = False) -> Column:
    """The language ('' for null) and the half of a text; with ``other`` the other half."""
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == (1 if other else 0)
    return F.concat(F.coalesce("lang", F.lit("")), F.when(half, F.lit("/0")).otherwise(F.lit("/1")))


def counts(docs: DataFrame) -> DataFrame:
    """key, run, n: how often each run of bytes stands in the texts of each language and half.

    A task passes on sorted runs and counts by hash bucket, packed; the counts of a bucket are added up by Spark's groups.
    """
    spark = ready(docs.sparkSession)
    batches_of(spark, 512)
    buckets = parts_for(docs, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(back, weights=np.concatenate([p[1] for p in parts])).astype("int64")

        def out() -> Iterator[pa.RecordBatch]:
            pack = zstandard.ZstdCompressor(level=1)
            for key, parts in held.items():
                keys, n = folded(parts)
                bucket = (keys.view("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype("int64") % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(cuts))
                split = [order[cuts[i] : cuts[i + 1]] for i in full]
                runs = [pack.compress(np.diff(keys[k], prepend=0).tobytes()) for k in split]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(full), pa.string()), pa.array(full.astype("int32")), pa.array(runs, pa.binary()), pa.array([pack.compress(n[k].tobytes()) for k in split], pa.binary())], ["key", "bucket", "runs", "n"])
            held.clear()

        for b in batches:
            texts, owners = texts_of(b.column(1)), b.column(0).to_pylist()
            for key in set(owners):
                found, n = np.unique(_runs([t for t, x in zip(texts, owners) if x == key])[0], return_counts=True)
                parts = held.setdefault(key, [])
                parts.append((found, n))
                if len(parts) > 16:
                    held[key] = [folded(parts)]
            if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                yield from out()
        yield from out()

    def add(f: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        runs = np.concatenate([np.cumsum(np.frombuffer(unpack.decompress(x), "int64")) for x in f["runs"]])
        n = np.concatenate([np.frombuffer(unpack.decompress(x), "int64") for x in f["n"]])
        keys, back = np.unique(runs, return_inverse=True)
        total = np.zeros(len(keys), "int64")
        np.add.at(total, back, n)
        return pd.DataFrame({"key": f["key"].iloc[0], "run": keys, "n": total})

    sent = docs.select(key_of().alias("key"), "text").mapInArrow(run, "key string, bucket int, runs binary, n binary")
    return sent.groupBy("key", "bucket").applyInPandas(add, "key string, run long, n long")


def kneser_ney(counted: DataFrame) -> DataFrame:
    """key, code, n, value of modified Kneser-Ney from ``counts``: the log probability of each run of each order, and the log
    weight of each context for the order below (the lowest order goes down to one in 256)."""
    orders = [staged(counted, "runs")]
    for k in range(ORDER - 1, 0, -1):  # below the highest order, distinct left extensions are counted
        orders.append(orders[-1].groupBy("key", F.col("run").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("run")).agg(F.count(F.lit(1)).alias("n")))
    below: DataFrame | None = None
    out: list[DataFrame] = []
    for order, t in enumerate(reversed(orders), 1):
        of = [F.sum((F.col("n") == i).cast("double")).alias(f"t{i}") for i in (1, 2, 3, 4)]
        y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
        ratio = lambda i, y=y: F.coalesce(F.least(F.greatest(i - (i + 1) * y * F.col(f"t{i + 1}") / F.when(F.col(f"t{i}") > 0, F.col(f"t{i}")), F.lit(0.05)), F.lit(i - 0.05)), F.lit(0.5))
        d = t.groupBy("key").agg(*of).select("key", *[ratio(i).alias(f"d{i}") for i in (1, 2, 3)])
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        # One row for each language and half; a language may hold most rows, so they are not dealt out by it.
        with_d = t.join(F.broadcast(d), "key").select("key", "run", F.shiftright("run", 8).alias("ctx"), "n", cut.alias("cut"))
        ctx = with_d.groupBy("key", "ctx").agg(F.sum("n").alias("total"), F.sum("cut").alias("mass"))
        ctx = staged(ctx.select("key", "ctx", "total", (F.col("mass") / F.col("total")).alias("weight")), "contexts")
        p = with_d.join(ctx, ["key", "ctx"])
        own = F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / F.col("total")
        if below is None:
            p = p.select("key", "run", "n", (own + F.col("weight") / 256).alias("p"))
        else:
            low = below.select("key", F.col("run").alias("_low"), F.col("p").alias("_p"))
            p = p.withColumn("_low", F.col("run").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1))).join(low, ["key", "_low"])
            p = p.select("key", "run", "n", (own + F.col("weight") * F.col("_p")).alias("p"))
        below = staged(p, "order")
        out.append(below.select("key", (F.col("run") + F.lit(order << SHIFT)).alias("code"), "n", F.log("p").alias("value")))
        out.append(ctx.select("key", (F.col("ctx") + F.lit(WEIGHT + (order << SHIFT))).alias("code"), F.col("total").alias("n"), F.log("weight").alias("value")))
    return reduce(DataFrame.unionByName, out)


Model = tuple[np.ndarray, np.ndarray, DataFrame | None]


def fit(docs: DataFrame, most: int | None = None) -> Model:
    """Sorted hashes of the ``most`` most frequent entries and their values, and, if there are more, a table of all (key, code, value)."""
    most = MOST if most is None else most
    model = staged(kneser_ney(counts(docs)).select("key", "code", F.floor(8 * F.log2("n")).alias("size"), F.col("value").cast("float").alias("value")), "model")
    cut, held = 0, 0
    for r in sorted(model.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        held += r["n"]
        if held > most:
            cut = r["size"] + 1
            break
    rows = model.where(F.col("size") >= cut).select(F.xxhash64("key", "code").bitwiseAND(F.lit((1 << BITS) - 1)).alias("slot"), "value").toArrow()
    slots, value = rows.column("slot").to_numpy(), rows.column("value").to_numpy()
    order = np.argsort(slots)
    return slots[order], value[order], model.drop("size") if held > most else None


class Lookup:
    """Places in sorted hashes: the top bits say where to begin."""

    def __init__(self, slots: np.ndarray) -> None:
        bits = max(1, len(slots).bit_length() - 1)
        self.slots = np.append(slots, np.iinfo("int64").max)
        self.shift = BITS - bits
        self.first = np.searchsorted(slots, np.arange(1 << bits, dtype="int64") << self.shift).astype("int32")

    def __call__(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each wanted hash, and whether it is there."""
        at = self.first[want >> self.shift]
        left = np.flatnonzero(self.slots[at] < want)
        while len(left):
            at[left] += 1
            left = left[self.slots[at[left]] < want[left]]
        return at, self.slots[at] == want


def _down(run: np.ndarray, key: str, lookup: Lookup, value: np.ndarray) -> np.ndarray:
    """Log probabilities of runs that are not met whole: weights of the contexts passed, then the longest run that is met."""
    total, left = np.zeros(len(run)), np.arange(len(run))
    for order in range(ORDER, 0, -1):
        own = run[left] & ((1 << (8 * order)) - 1)
        if order < ORDER:
            at, known = lookup(_slots(own + (order << SHIFT), key))
            total[left[known]] += value[at[known]]
            left, own = left[~known], own[~known]
        if not len(left):
            return total
        at, known = lookup(_slots((own >> 8) + (WEIGHT + (order << SHIFT)), key))
        total[left[known]] += value[at[known]]
    total[left] -= np.log(256)
    return total


def _joined_down(rest: DataFrame, every: DataFrame) -> DataFrame:
    """_row, _more: the same for (_row, key, run) of runs that the broadcast does not know, by joins to all entries."""
    at = rest.withColumn("_sum", F.lit(0.0))
    done: list[DataFrame] = []
    for order in range(ORDER, 0, -1):
        own = F.col("run").bitwiseAND(F.lit((1 << (8 * order)) - 1))
        met = every.select("key", F.col("code").alias("_code"), F.col("value").alias("_p"))
        at = at.withColumn("_code", own + F.lit(order << SHIFT)).join(met, ["key", "_code"], "left")
        at = staged(at.withColumn("_code", F.shiftright(own, 8) + F.lit(WEIGHT + (order << SHIFT))), "down")
        done.append(at.where("_p IS NOT NULL").select("_row", (F.col("_sum") + F.col("_p")).alias("_sum")))
        weight = every.select("key", F.col("code").alias("_code"), F.col("value").alias("_w"))
        at = at.where("_p IS NULL").drop("_p").join(weight, ["key", "_code"], "left").select("_row", "key", "run", (F.col("_sum") + F.coalesce("_w", F.lit(0.0))).alias("_sum"))
    done.append(at.select("_row", (F.col("_sum") - F.log(F.lit(256.0))).alias("_sum")))
    return reduce(DataFrame.union, done).groupBy("_row").agg(F.sum("_sum").alias("_more"))


def scored(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, lang ('' for null), the base counts, n_bytes and log_perplexity (per byte; null for empty texts)."""
    spark = ready(docs.sparkSession)
    batches_of(spark, 512)
    slots, value, every = model or fit(docs)
    shared = spark.sparkContext.broadcast((slots, value))
    kind = dict(docs.dtypes)["doc_id"]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    split = every is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, value = shared.value
        lookup, value = Lookup(slots), np.append(value, np.float32(0))
        for b in batches:
            texts, keys = texts_of(b.column(3)), b.column(2).to_pylist()
            sums, rest = np.zeros(len(texts)), [None] * len(texts)
            for key in set(keys):
                own = [i for i, x in enumerate(keys) if x == key]
                got, size = _runs([texts[i] for i in own])
                at, known = lookup(_slots(got + (ORDER << SHIFT), key))
                each = np.where(known, value[np.where(known, at, -1)], np.float32(0))
                if not split:
                    each[~known] = _down(got[~known], key, lookup, value)
                total = np.concatenate([[0.0], np.cumsum(each, dtype="float64")])
                ends = np.cumsum(size)
                sums[own] = total[ends] - total[ends - size]
                for i, e, n in zip(own, ends.tolist(), size.tolist()) if split else ():
                    rest[i] = got[e - n : e][~known[e - n : e]]
            base = np.array([base_counts(t) for t in texts], "int64").reshape(-1, 5)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(c) for c in np.ascontiguousarray(base.T)), sizes, pa.array(sums), pa.array(rest, pa.list_(pa.int64()))], ["doc_id", "lang", "key", *names, "n_bytes", "_total", "_rest"])

    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), key_of(other=True).alias("key"), "text")
    out = rows.mapInArrow(run, f"doc_id {kind}, lang string, key string, {', '.join(n + ' long' for n in names)}, n_bytes long, _total double, _rest array<long>")
    if split:  # the runs that are not broadcast are rare, so none has many rows
        out = staged(out.withColumn("_row", F.monotonically_increasing_id()), "partly")
        more = _joined_down(out.select("_row", "key", F.explode("_rest").alias("run")), every)
        out = out.join(more, "_row", "left").withColumn("_total", F.col("_total") + F.coalesce("_more", F.lit(0.0)))
    return out.select("doc_id", "lang", *names, "n_bytes", F.when(F.col("n_bytes") > 0, -F.col("_total") / F.col("n_bytes")).alias("log_perplexity"))


def ranges_by_length(rows: DataFrame) -> DataFrame:
    """lang, a, b: the squared interquartile range of log perplexities at n bytes is about a + b / n, neither below 0.

    Ranges are measured in classes of lengths that double; a least-squares line goes through those of a language.
    """
    quarter = [F.percentile_approx("log_perplexity", q, 10000).alias(f"q{i}") for i, q in ((1, 0.25), (3, 0.75))]
    classes = rows.groupBy("lang", F.floor(F.log2("n_bytes")).alias("class")).agg(*quarter, F.avg(1 / F.col("n_bytes")).alias("x"), F.count(F.lit(1)).alias("n"))
    x, y, w = F.col("x"), (F.col("q3") - F.col("q1")) ** 2, F.col("n") / F.col("x")
    line = classes.where(F.col("n") >= MEASURED).groupBy("lang").agg(*[F.sum(v).alias(k) for k, v in {"w": w, "wx": w * x, "wy": w * y, "wxx": w * x * x, "wxy": w * x * y}.items()])
    c = {k: F.col(k) for k in ("w", "wx", "wy", "wxx", "wxy")}
    spread = c["w"] * c["wxx"] - c["wx"] * c["wx"]
    slope = F.when(spread > 1e-9 * c["w"] * c["wxx"], (c["w"] * c["wxy"] - c["wx"] * c["wy"]) / F.when(spread > 0, spread)).otherwise(F.lit(0.0))
    fitted = line.withColumn("b", slope).withColumn("a", (c["wy"] - F.col("b") * c["wx"]) / c["w"])
    a = F.when(F.col("b") < 0, c["wy"] / c["w"]).when(F.col("a") < 0, F.lit(0.0)).otherwise(F.col("a"))
    b = F.when(F.col("b") < 0, F.lit(0.0)).when(F.col("a") < 0, c["wxy"] / c["wxx"]).otherwise(F.col("b"))
    return fitted.select("lang", a.alias("a"), b.alias("b"))


def judged(docs: DataFrame, wide: float = WIDE) -> DataFrame:
    """doc_id, base counts, base_failed, log_perplexity and kept of every whole text.

    A band is the median of a language's log perplexities, give or take ``wide`` interquartile ranges.  As short texts
    vary more, the range is that of texts of such a length; languages with too few texts to tell have one for all lengths.
    Bands are taken from the texts that pass the base.  Null and empty texts have no word and fail the
    base; a null language is a language of its own; ids may be null and rows may repeat; an empty table gives an empty
    table.  Counts cover all documents, however many times a text is repeated.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = staged(scored(docs), "scored")
    fair = rows.where(~failed)
    quarter = [F.percentile_approx("log_perplexity", q, 10000).alias(f"_q{i}") for i, q in enumerate((0.25, 0.5, 0.75))]
    bands = fair.groupBy("lang").agg(*quarter).join(ranges_by_length(fair), "lang", "left").withColumnsRenamed({"lang": "_lang", "a": "_a", "b": "_b"})
    # One row a language; a language may hold most rows, so they are not dealt out by it.
    banded = rows.join(F.broadcast(bands), F.col("lang") == F.col("_lang"), "left")
    spread = F.coalesce(F.sqrt(F.col("_a") + F.col("_b") / F.greatest("n_bytes", F.lit(1))), F.col("_q2") - F.col("_q0"))
    half = F.lit(wide) * F.greatest(spread, F.lit(0.005))
    low, high = F.col("_q1") - half, F.col("_q1") + half
    inside = F.coalesce(F.col("log_perplexity").between(low, high), F.lit(True))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return banded.select("doc_id", *names, failed.alias("base_failed"), (~failed & inside).alias("kept"), "log_perplexity")
