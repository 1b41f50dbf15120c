"""Language identification by a bidirectional gated recurrent network over bytes.

The network is written and trained in numpy by backpropagation through time: two layers of gated units read a segment of
bytes from either end, a softmax labels every position, and a document's probabilities are the mean over all of its
positions.  Texts are read whole, as segments that many documents share a batch of.  Training texts are cut into pieces
from end to end, and a bounded sample of all pieces is drawn, balanced over languages, so that every part of every text
can be learned from; the network is a few thousand numbers and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches_of, held_out, ready
from .bpe import texts_of

#: Pieces to learn from (about, and one for each language at least), characters of each, units a direction, steps, rows a step.
SAMPLE, PIECE, UNITS, STEPS, ROWS = 4800, 320, 8, 320, 256
#: Bytes of a segment when predicting and training, segments at once.
SEGMENT, LESSON, AT_ONCE = 128, 64, 2048


@dataclass
class Network:
    """Per direction: input table (3H, 256) of update, reset and candidate gates, recurrent weights (3H, H); then the softmax."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], units: int = UNITS, seed: int = 0) -> "Network":
        rng = np.random.default_rng(seed)
        f = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        tables, recurrent = [f(3 * units, 256) for _ in range(2)], [f(3 * units, units) for _ in range(2)]
        return cls(languages, tables, recurrent, f(len(languages), 2 * units), np.zeros((len(languages), 1), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, self.out, self.bias]

    def states(self, data: np.ndarray, keep: bool = False, mask: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """Hidden states (T, 2H, B) for bytes (T, B); with ``keep`` what the way back needs.

        Where ``mask`` is 0 (after the end of a short segment) the state is 0, so that the way from the right begins afresh
        at the last byte, whatever other segments of the batch are as long as.
        """
        t_n, b_n = data.shape
        h_n = self.recurrent[0].shape[1]
        out, kept = np.empty((t_n, 2 * h_n, b_n), np.float32), [[], []]
        for side in range(2):
            table, u = self.tables[side], self.recurrent[side]
            h = np.zeros((h_n, b_n), np.float32)
            for t in range(t_n) if side == 0 else range(t_n - 1, -1, -1):
                x = np.take(table, data[t], axis=1)
                g = u @ h
                x[: 2 * h_n] += g[: 2 * h_n]
                gates = x[: 2 * h_n]
                gates *= np.float32(0.25)
                gates += np.float32(0.5)
                np.clip(gates, 0, 1, out=gates)
                z, r, m = gates[:h_n], gates[h_n:], g[2 * h_n :]
                n = x[2 * h_n :] + r * m
                np.tanh(n, out=n)
                new = out[t, side * h_n : (side + 1) * h_n]
                np.subtract(n, h, out=new)
                new *= z
                new += h
                if mask is not None:
                    new *= mask[t]
                if keep:
                    kept[side].append((t, h, z, r, m, n))
                h = new
        return out, kept

    def probabilities(self, data: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Softmax at every position: (T, languages, B)."""
        logits = np.matmul(self.out, self.states(data, mask=mask)[0]) + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, data: np.ndarray, target: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the positions that count, and its gradients in the order of ``parameters``."""
        states, kept = self.states(data, keep=True, mask=mask)
        logits = np.matmul(self.out, states) + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        p = logits / logits.sum(axis=1, keepdims=True)
        t_n, b_n = data.shape
        h_n, total = self.recurrent[0].shape[1], max(1.0, float(mask.sum()))
        picked = p[:, target, np.arange(b_n)]
        loss = float(-(np.log(picked + 1e-12) * mask).sum() / total)
        d = p
        d[:, target, np.arange(b_n)] -= 1
        d *= (mask / total)[:, None, :]
        d_out = np.matmul(d, states.transpose(0, 2, 1)).sum(axis=0)
        d_bias = d.sum(axis=(0, 2))[:, None]
        d_states = np.matmul(self.out.T, d)
        d_tables, d_recurrent = [], []
        for side in range(2):
            u = self.recurrent[side]
            carry = np.zeros((h_n, b_n), np.float32)
            d_u, d_x = np.zeros_like(u), np.empty((t_n, 3 * h_n, b_n), np.float32)
            for t, h, z, r, m, n in reversed(kept[side]):
                dh = (d_states[t, side * h_n : (side + 1) * h_n] + carry) * mask[t]
                dn = dh * z * (1 - n * n)
                d_x[t, :h_n] = dh * (n - h) * ((z > 0) & (z < 1)) * np.float32(0.25)
                d_x[t, h_n : 2 * h_n] = dn * m * ((r > 0) & (r < 1)) * np.float32(0.25)
                d_x[t, 2 * h_n :] = dn
                dg = np.concatenate([d_x[t, : 2 * h_n], dn * r])
                d_u += dg @ h.T
                carry = dh * (1 - z) + u.T @ dg
            flat = d_x.transpose(1, 0, 2).reshape(3 * h_n, -1)
            where = data.ravel()
            d_tables.append(np.stack([np.bincount(where, weights=row, minlength=256) for row in flat]).astype(np.float32))
            d_recurrent.append(d_u)
        return loss, [*d_tables, *d_recurrent, d_out, d_bias]

    def document_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (documents, languages) over all positions; uniform for empty texts."""
        totals = np.zeros((len(texts), len(self.languages)))
        size = np.array([len(t) for t in texts], dtype="int64")
        parts = -(-size // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        length = np.minimum(size[owner] - nth * SEGMENT, SEGMENT)
        whole = np.frombuffer(b"".join(texts) + bytes(SEGMENT), np.uint8)
        start = (np.cumsum(size) - size)[owner] + nth * SEGMENT
        order = np.argsort(-length, kind="stable")
        for a in range(0, len(order), AT_ONCE):
            k = order[a : a + AT_ONCE]
            n = length[k]
            at = np.arange(int(n.max()))[:, None]
            mask = at < n[None, :]
            data = np.where(mask, whole[start[k][None, :] + np.minimum(at, n[None, :] - 1)], 0)
            whole_rows, ones = mask.all(), mask.astype(np.float32)
            p = self.probabilities(data, None if whole_rows else ones)
            pooled = p.sum(axis=0) if whole_rows else np.einsum("tcb,tb->cb", p, ones)
            for c in range(len(self.languages)):
                totals[:, c] += np.bincount(owner[k], weights=pooled[c], minlength=len(texts))
        return np.where(size[:, None] > 0, totals / np.maximum(size[:, None], 1), 1.0 / max(1, len(self.languages)))


def train(rows: list[tuple[str, bytes]], languages: list[str], steps: int = STEPS, seed: int = 0) -> Network:
    """Adam over random pieces of the sample's texts; every position of a piece has its document's language."""
    net, rng = Network.fresh(languages, seed=seed), np.random.default_rng(seed)
    if not rows or len(languages) < 2:
        return net
    code = {x: i for i, x in enumerate(languages)}
    groups = [[t for x, t in rows if x == lang and t] for lang in languages]
    groups_at = [i for i, g in enumerate(groups) if g]
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, steps + 1):
        data, mask = np.zeros((LESSON, ROWS), np.uint8), np.zeros((LESSON, ROWS), np.float32)
        target = rng.choice(groups_at, ROWS)
        for j, c in enumerate(target):
            text = groups[c][rng.integers(len(groups[c]))]
            a = int(rng.integers(max(1, len(text) - LESSON + 1)))
            piece = np.frombuffer(text[a : a + LESSON], np.uint8)
            data[: len(piece), j], mask[: len(piece), j] = piece, 1
        _, grads = net.gradients(data, target, mask)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parameters(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    assert set(code) == set(languages)
    return net


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """Train on about ``sample`` pieces of the texts that are not held out and have a language and a letter.

    All languages are learned.  A language with fewer pieces than its share gives all of them.
    """
    ready(docs.sparkSession)
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    last = F.floor((F.length("text") - 1) / PIECE)
    counts = known.groupBy("lang").agg(F.sum(last + 1).alias("n")).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Network.fresh([])
    each = max(1, sample // len(languages))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["n"])) for r in counts], "_lang string, share double")
    draw = lambda i: F.pmod(F.xxhash64(F.col("doc_id"), i, F.lit(11)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    drawn = known.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).withColumn("_at", F.filter(F.sequence(F.lit(0).cast("long"), last), draw)).where(F.size("_at") > 0)
    pieces = drawn.select("lang", F.explode(F.transform("_at", lambda i: F.substring("text", (i * PIECE + 1).cast("int"), F.lit(PIECE)))).alias("piece"))
    return train(sorted((r["lang"], r["piece"].encode()) for r in pieces.collect()), languages)


def identified(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the pooled probability) of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text where nothing could be learned;
    with one learned language that one has score 1.  Null ids are never held out; repeated rows are predicted row by
    row; ties go to the first language in order; an empty table gives an empty table.  Language and source are not read
    for a prediction, nor are other columns.
    """
    spark = ready(docs.sparkSession)
    batches_of(spark, 512)
    shared = spark.sparkContext.broadcast(net or fit(docs))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            lettered = b.column(2).to_pylist()
            texts = [t if x else b"" for t, x in zip(texts_of(b.column(1)), lettered)]
            if net.languages:
                p = net.document_probabilities(texts)
                best = p.argmax(axis=1)
                lang = [net.languages[i] if x else "und" for i, x in zip(best, lettered)]
                score = np.where(lettered, np.clip(p[np.arange(len(p)), best], 0, 1), 0.0)
            else:
                lang, score = ["und"] * len(texts), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
