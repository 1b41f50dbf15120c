"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Only the first ``DEPTH`` bytes of a suffix matter, so suffixes are ordered by most-significant-digit passes down to
that depth; the groups that are then equal are exactly the repeated windows.  A pass drops what can no longer repeat:

1. Digit one is the smallest hashed run of ``RUN`` bytes in the window, the same for equal windows wherever they
   stand.  Neighbouring windows mostly share it and travel together, one number for all of them.  Numbers seen once in
   the corpus go no further.
2. What is left is sorted by the remaining digits, eight bytes at a time, first within its block, where stretches whose
   windows all repeat an earlier document's are settled and go no further, and then in the bucket of its number.

Texts are packed into blocks of bounded size.  As a block settles its own repeats, a passage that a third of all documents
share reaches a bucket once for each block at most; numbers that many blocks share are dealt out by whole windows, over
all buckets.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches_of, parts_for, ready

DEPTH, RUN = 50, 24
#: Bytes of a block, blocks that share a number before it is dealt out by windows.
BLOCK, HOT = 2 << 20, 4096
_M = 0x9E3779B97F4A7C15
_PASSES = (0, 8, 16, 24, 32, 40, DEPTH - 8)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A mixed hash of every run of ``size`` bytes."""
    power, width = data.astype(np.uint64) + np.uint64(1), 1
    made: np.ndarray | None = None
    done = 0
    with np.errstate(over="ignore"):
        while True:
            if size & width:
                made = power.copy() if made is None else power[: len(power) - done] * np.uint64(pow(_M, done, 1 << 64)) + made[width:]
                done += width
            width *= 2
            if width > size:
                break
            power = power[: -width // 2] * np.uint64(pow(_M, width // 2, 1 << 64)) + power[width // 2 :]
        made = made[: len(data) - size + 1]
        made ^= made >> np.uint64(29)
        made *= np.uint64(0xBF58476D1CE4E5B9)
        made ^= made >> np.uint64(32)
    return made


def _keys(mixed: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high and a number in the low 32 bits."""
    return ((mixed >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | mixed & np.uint64(0xFFFFFFFF)


def stretches(data: np.ndarray, size: np.ndarray, live: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, key and document of every stretch of windows with one key."""
    n = len(data) - DEPTH + 1
    empty = np.zeros(0, "int64")
    if n <= 0:
        return empty, empty, empty.astype("uint64"), empty
    low = _hashes(data, RUN)
    span, width = DEPTH - RUN + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    low = low[:n]
    start = np.cumsum(size) - size
    last = np.where(live & (size >= DEPTH), start + size - DEPTH, -1)
    change = np.concatenate([[True], low[1:] != low[:-1]])
    change[start[start < n]] = True
    at = np.flatnonzero(change)
    doc = np.searchsorted(start, at, side="right") - 1
    ends = np.append(at[1:], n)
    count = np.minimum(ends, last[doc] + 1) - at
    keep = count > 0
    return at[keep], count[keep], _keys(low[at[keep]], buckets), doc[keep]


def _blocks(docs: DataFrame) -> DataFrame:
    """Texts packed to blocks: block, ids, known (whether an id is not null), sizes, data."""
    spark = ready(docs.sparkSession)
    batches_of(spark, 512)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[bytes] = []
        held, pack = 0, zstandard.ZstdCompressor(level=6)

        def out() -> pa.RecordBatch:
            row = [uuid.uuid4().int >> 65, np.array([x or 0 for x in ids], "int64").tobytes(), np.array([x is not None for x in ids], "uint8").tobytes(), np.array(list(map(len, texts)), "int64").tobytes(), pack.compress(b"".join(texts))]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], ["block", "ids", "known", "sizes", "data"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                t = t or b""
                if held + len(t) > BLOCK and texts:
                    yield out()
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(t)
                held += len(t)
        if texts:
            yield out()

    path = f"{spark.sparkContext.getCheckpointDir()}/blocks-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "block long, ids binary, known binary, sizes binary, data binary")
    rows.write.option("parquet.block.size", 8 << 20).option("compression", "none").parquet(path)
    return spark.read.parquet(path)


def _opened(row: dict) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, int(np.frombuffer(row["sizes"], "int64").sum())))
    return data, np.frombuffer(row["sizes"], "int64"), np.frombuffer(row["ids"], "int64"), np.frombuffer(row["known"], "uint8").astype(bool)


def _by_bucket(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of sorted keys, bucket by bucket."""
    bucket = (keys >> np.uint64(32)).astype("int64")
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, int)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
        yield int(bucket[a]), slice(a, b)


def _met(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and whether a key is in two documents of the block."""
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(k) else np.zeros(0, bool)
    return k[first], many


def _first_pass(blocks: DataFrame, buckets: int) -> DataFrame:
    """block, bucket, codes: for each of the block's numbers 0 (unique), 1 (repeats) or 2 (repeats in many blocks)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                data, size, _, known = _opened(row)
                _, _, keys, doc = stretches(np.frombuffer(data, np.uint8), size, known, buckets)
                keys, many = _met(doc, keys)
                parts = [(bucket, keys[s].astype("<u4").tobytes(), np.packbits(many[s]).tobytes()) for bucket, s in _by_bucket(keys)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([row["block"]] * len(parts), pa.int64()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], ["bucket", "block", "numbers", "many"])

    def judge(f: pd.DataFrame) -> pd.DataFrame:
        numbers = [np.frombuffer(x, "<u4") for x in f["numbers"]]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, "uint8"), count=len(x)) for m, x in zip(f["many"], numbers)])
        _, back, count = np.unique(np.concatenate(numbers), return_inverse=True, return_counts=True)
        repeats = (count >= 2) | (np.bincount(back, weights=many) > 0)
        code = np.where(count > HOT, 2, repeats.astype("int64")).astype("uint8")[back]
        cuts = np.cumsum([len(x) for x in numbers])[:-1]
        pack = zstandard.ZstdCompressor(level=1)
        return pd.DataFrame({"block": f["block"], "bucket": f["bucket"], "codes": [pack.compress(c.tobytes()) for c in np.split(code, cuts)]})

    sent = blocks.select("block", "ids", "known", "sizes", "data").mapInArrow(send, "bucket int, block long, numbers binary, many binary")
    return sent.groupBy("bucket").applyInPandas(judge, "block long, bucket int, codes binary")


def _fresh(*keys: np.ndarray) -> np.ndarray:
    """Where rows sorted by the keys begin a new group."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _equal_stretches(data: np.ndarray, at: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A group for each stretch: digit one and the length, then passes of eight bytes over what is not alone yet."""
    order = np.lexsort((size, number))
    group = np.empty(len(at), "int64")
    group[order] = np.cumsum(_fresh(number[order], size[order])) - 1
    live = np.flatnonzero(np.bincount(group)[group] > 1)
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    skip, last = 0, int(group.max(initial=0))
    while len(live):
        d = eight[at[live] + np.minimum(skip, size[live] - 8)].view(">u8")[:, 0]
        order = np.lexsort((d, group[live]))
        live, d = live[order], d[order]
        split = np.cumsum(_fresh(group[live], d))
        group[live] = last + split
        last += int(split[-1])
        skip += 8
        live = live[(np.bincount(split)[split] > 1) & (size[live] > skip)]
    return group


def _sorted_windows(contents: list[bytes], doc: np.ndarray, number: np.ndarray) -> list[tuple[int, int, int]]:
    """(content, first, last + 1) of windows that also start in a smaller document.  ``doc``: the owner of each content.

    Stretches whose number (digit one) is not alone are sorted as wholes first, then the windows of one stretch of each
    group, that of the smallest document; the windows that are equal to the last digit are those that repeat.
    """
    _, back, count = np.unique(number, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(count[back] > 1)
    if not len(chosen):
        return []
    data = np.frombuffer(b"".join([contents[i] for i in chosen.tolist()]) + bytes(8), np.uint8)
    size = np.array([len(contents[i]) for i in chosen.tolist()], "int64")
    place, doc, back = np.cumsum(size) - size, doc[chosen], back[chosen]
    group = _equal_stretches(data, place, size, back)
    order = np.lexsort((doc, group))
    first = np.flatnonzero(_fresh(group[order]))
    least = np.empty(len(chosen), "int64")
    least[order] = np.repeat(doc[order[first]], np.diff(np.append(first, len(order))))
    windows = size - DEPTH + 1
    out = [(i, 0, n) for i, n in zip(chosen[doc > least].tolist(), windows[doc > least].tolist())]
    heads = order[first]
    heads = heads[np.bincount(back[heads])[back[heads]] > 1]  # a number that one group alone has is settled
    if not len(heads):
        return out
    same = np.flatnonzero(doc == least)
    same = same[np.argsort(group[same], kind="stable")]
    owner = np.repeat(heads, windows[heads])
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows[heads]) - windows[heads], windows[heads])
    at, of = place[owner] + offset, doc[owner]
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    live, part = np.arange(len(owner)), back[owner]
    for skip in _PASSES:
        d = eight[at[live] + skip].view(">u8")[:, 0]
        order = np.lexsort((d, part))
        live, part, d = live[order], part[order], d[order]
        fresh = _fresh(part, d)
        first = np.flatnonzero(fresh)
        mixed = np.minimum.reduceat(of[live], first) < np.maximum.reduceat(of[live], first)
        part = np.cumsum(fresh) - 1
        keep = mixed[part]
        live, part = live[keep], part[keep]
        if not len(live):
            return out
    first = np.flatnonzero(_fresh(part))
    smallest = np.repeat(np.minimum.reduceat(of[live], first), np.diff(np.append(first, len(live))))
    hit = np.sort(live[of[live] > smallest])
    if not len(hit):
        return out
    cut = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])]))
    begin, end = hit[cut], hit[np.append(cut[1:], len(hit)) - 1]
    low, high = (np.searchsorted(group[same], group[owner[begin]], side) for side in ("left", "right"))
    for x, y, p, q in zip(low.tolist(), high.tolist(), offset[begin].tolist(), (offset[end] + 1).tolist()):
        out.extend((i, p, q) for i in chosen[same[x:y]].tolist())
    return out


def _second_pass(blocks: DataFrame, codes: DataFrame, buckets: int) -> DataFrame:
    """block, ranges: windows (as first and last + 1 in the block) that also start in a smaller document."""
    by_block = codes.groupBy("block").agg(F.collect_list(F.struct("bucket", "codes")).alias("codes"))
    # An outer join as in the last step, so that both read one exchange of the blocks.
    joined = blocks.join(by_block.withColumnRenamed("block", "_block"), F.col("block") == F.col("_block"), "left")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=4), zstandard.ZstdDecompressor()
        for b in batches:
            for row in b.to_pylist():
                data, size, ids, known = _opened(row)
                at, count, keys, doc = stretches(np.frombuffer(data, np.uint8), size, known, buckets)
                distinct, _ = _met(doc, keys)
                code = np.zeros(len(distinct), "uint8")
                got = {c["bucket"]: c["codes"] for c in row["codes"] or []}
                for bucket, s in _by_bucket(distinct):
                    code[s] = np.frombuffer(unpack.decompress(got[bucket], max_output_size=s.stop - s.start), "uint8")
                own = code[np.searchsorted(distinct, keys)] if len(keys) else code
                cold, hot = own == 1, own == 2
                each = np.repeat(np.flatnonzero(hot), count[hot])
                step = np.arange(len(each)) - np.repeat(np.cumsum(count[hot]) - count[hot], count[hot])
                alone = at[each] + step
                start = np.concatenate([at[cold], alone])
                stop = np.concatenate([at[cold] + count[cold] + DEPTH - 1, alone + DEPTH])
                docs = np.concatenate([ids[doc[cold]], ids[doc[each]]])
                texts = [data[a:z] for a, z in zip(start.tolist(), stop.tolist())]
                whole = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in texts[int(cold.sum()) :]]
                key = np.concatenate([keys[cold], _keys(np.array(whole, np.uint64), buckets)])
                hits = _sorted_windows(texts, docs, key)
                ranges = np.array([(start[i] + a, start[i] + z) for i, a, z in hits], "<i8")
                later = np.zeros(len(texts), bool)
                later[[i for i, a, z in hits if a == 0 and z == stop[i] - start[i] - DEPTH + 1]] = True
                rows = [(0, 1, pack.compress(ranges.tobytes()))] if len(ranges) else []
                mine = np.flatnonzero(~later)
                mine = mine[np.argsort(key[mine], kind="stable")]
                for bucket, s in _by_bucket(key[mine]):
                    k = mine[s]
                    part = [texts[i] for i in k.tolist()]
                    blob = b"".join([start[k].astype("<i8").tobytes(), docs[k].astype("<i8").tobytes(), (stop[k] - start[k]).astype("<i8").tobytes(), key[k].astype("<u4").tobytes(), *part])
                    rows.append((bucket, 0, len(k).to_bytes(8, "little") + pack.compress(blob)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] if not r[1] else row["block"] % buckets for r in rows], pa.int32()), pa.array([row["block"]] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "block", "done", "blob"])

    def judge(f: pd.DataFrame) -> pd.DataFrame:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        out, texts, blocks = [], [], []
        starts, owners, numbers = [], [], []
        for r in f.itertuples(index=False):
            if r.done:
                out.append((r.block, r.blob))
                continue
            n = int.from_bytes(r.blob[:8], "little")
            raw = unpack.decompressobj().decompress(r.blob[8:])
            start, docs, size = (np.frombuffer(raw, "<i8", n, 8 * n * i) for i in range(3))
            cuts = (28 * n + np.concatenate([[0], np.cumsum(size)])).tolist()
            texts += [raw[a:z] for a, z in zip(cuts, cuts[1:])]
            blocks += [r.block] * n
            starts.append(start)
            owners.append(docs)
            numbers.append(np.frombuffer(raw, "<u4", n, 24 * n))
        if texts:
            start = np.concatenate(starts).tolist()
            found: dict[int, list[tuple[int, int]]] = {}
            for i, a, z in _sorted_windows(texts, np.concatenate(owners), np.concatenate(numbers)):
                found.setdefault(blocks[i], []).append((start[i] + a, start[i] + z))
            out += [(block, pack.compress(np.array(x, "<i8").tobytes())) for block, x in found.items()]
        return pd.DataFrame(out, columns=["block", "ranges"]).astype({"block": "int64"})

    sent = joined.select("block", "ids", "known", "sizes", "data", "codes").mapInArrow(send, "bucket int, block long, done int, blob binary")
    return sent.groupBy("bucket").applyInPandas(judge, "block long, ranges binary")


def _kept(data: bytes, size: np.ndarray, ranges: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
    """What is left of each document, the bytes removed and the removed runs."""
    step = np.zeros(len(data) + 1, "int64")
    np.add.at(step, ranges[:, 0], 1)
    np.add.at(step, ranges[:, 1] + DEPTH - 1, -1)
    gone = np.cumsum(step[:-1]) > 0
    raw, a = np.frombuffer(data, np.uint8), 0
    for n in size.tolist():
        g = gone[a : a + n]
        removed = int(g.sum())
        if removed:
            yield raw[a : a + n][~g].tobytes(), removed, int(g[0]) + int((g[1:] & ~g[:-1]).sum())
        else:
            yield data[a : a + n], 0, 0
        a += n


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every document.

    A byte goes if a window of DEPTH bytes that covers it also starts in a document with a smaller id.  Matches never
    cross documents and are judged on the input.  Null and empty texts have no bytes; rows with a null id keep all of
    theirs and take nothing from others; rows with the same id take nothing from each other; an empty table gives an
    empty table.  Other columns are ignored.
    """
    ready(docs.sparkSession)
    buckets = parts_for(docs, 4)
    blocks = _blocks(docs)
    ranges = _second_pass(blocks, _first_pass(blocks, buckets), buckets)
    by_block = ranges.groupBy("block").agg(F.collect_list("ranges").alias("ranges"))
    joined = blocks.join(by_block.withColumnRenamed("block", "_block"), F.col("block") == F.col("_block"), "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for row in b.to_pylist():
                data, size, ids, known = _opened(row)
                own = [np.frombuffer(unpack.decompressobj().decompress(x), "<i8").reshape(-1, 2) for x in row["ranges"] or []]
                rows = list(_kept(data, size, np.concatenate(own) if own else np.zeros((0, 2), "int64")))
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(size), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("block", "ids", "known", "sizes", "data", "ranges").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
