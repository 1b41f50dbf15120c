"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes cuts a text where the hash says so, so that passages which documents share give
the same chunks wherever they stand.  A chunk met before is not encoded again.  A chunk may begin or end inside a
word, so only what lies between its first and last ASCII white space is kept with it; the two loose ends are joined
with those of the neighbours and encoded again, over as many chunks as it takes to reach white space.  ASCII white
space always ends a pre-token of the supported tokenizers (``checked`` refuses others), so the result is exactly
the library's for the whole text.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import batches_of, ready

#: Words, their lower-case letters and bytes of chunks that a worker keeps.
KEPT_WORDS, KEPT_LETTERS, KEPT_BYTES = 400_000, 200_000, 32 << 20
#: Chunks have this many bytes on average, and a quarter of it at least.
CHUNK = 1024
SPAN = 12
#: Words of these letters are normalised the same way letter by letter; a run of marks after them is a pre-token.
LETTERS = r"([A-Za-zÀ-ÖØ-öø-įĲ-ɏ]+)([!-&(-/:-@\[-`{-~]*)"
#: Letters and marks of every line of a text; both are empty for a line that is something else.
LINES = re.compile(rf"^(?:{LETTERS}|.+)$", re.M)
NEVER = np.int64(1) << np.int64(40)
_ENCODERS: dict[tuple[str, int, int], "WordEncoder"] = {}


def checked(path: str) -> None:
    """Refuse a tokenizer for which words between white space could not be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    splits = [x for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
    loose = any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    drops = any(x["behavior"] == "Removed" and x["invert"] and r"[^\s\p{L}\p{N}]+" in x["pattern"].get("Regex", "") for x in splits)
    if loose or not drops or set(kinds) - {"NFC", "Replace", "Lowercase"} or spec["post_processor"] or spec["decoder"]:
        raise ValueError(f"{path}: white space must end a pre-token, and nothing may be added or stripped")


class Merger:
    """Byte-pair merges of many lower-case words at once: in each round every word takes its best merge, the leftmost of
    equals, as the library does word by word."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in visible)}
        self.inner = np.array([vocab.get(letter[b], -1) for b in range(256)], dtype="int64")
        self.last = np.array([vocab.get(letter[b] + end, -1) for b in range(256)], dtype="int64")
        keys = np.array([vocab[x] << 32 | vocab[y] for x, y in pairs], dtype="int64")
        self.made = np.array([vocab[x + y] for x, y in pairs], dtype="int64")
        #: Hash tables of pairs and ranks; what finds its place taken goes to the next, smaller one.
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        left, bits = np.arange(len(keys)), max(4, len(keys).bit_length() + 2)
        while len(left):
            at = self._place(keys[left], bits)
            _, first = np.unique(at, return_index=True)
            held, ranks = np.full(1 << bits, -1, "int64"), np.full(1 << bits, NEVER)
            held[at[first]], ranks[at[first]] = keys[left[first]], left[first]
            self.tables.append((bits, held, ranks))
            left, bits = np.delete(left, first), max(4, bits - 2)

    @staticmethod
    def _place(key: np.ndarray, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.view("uint64") * np.uint64(0x9E3779B97F4A7C15 + 2 * bits) >> np.uint64(64 - bits)).view("int64")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = self._place(key, self.tables[0][0])
        out = np.where(self.tables[0][1][at] == key, self.tables[0][2][at], NEVER)
        for bits, held, ranks in self.tables[1:]:
            miss = np.flatnonzero(out == NEVER)
            at = self._place(key[miss], bits)
            hit = held[at] == key[miss]
            out[miss[hit]] = ranks[at[hit]]
        return out

    def encode(self, words: list[bytes]) -> list[bytes]:
        size = np.fromiter(map(len, words), "int64", len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), size)
        symbol = self.inner[raw]
        ends = np.cumsum(size) - 1
        symbol[ends] = self.last[raw[ends]]
        if (symbol < 0).any():
            raise ValueError("a byte has no token")
        rank = np.full(len(symbol), NEVER)
        rank[:-1] = self.rank(symbol[:-1], symbol[1:])
        rank[ends] = NEVER
        ids, owners = [], []
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(symbol)))
            live = np.repeat(best < NEVER, length)
            if not live.all():
                ids.append(symbol[~live])
                owners.append(word[~live])
                symbol, word, rank = symbol[live], word[live], rank[live]
                length, best = length[best < NEVER], best[best < NEVER]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(best, length))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            for left in (at, at - 1):
                left = left[left >= 0]
                right = np.minimum(left + 1, len(symbol) - 1)
                rank[left] = np.where((word[left] == word[right]) & (right > left), self.rank(symbol[left], symbol[right]), NEVER)
        owner = np.concatenate(owners) if owners else np.zeros(0, "int64")
        order = np.argsort(owner, kind="stable")
        flat = (np.concatenate(ids)[order] if ids else owner).astype("<u4").tobytes()
        cuts = (np.cumsum(np.bincount(owner, minlength=len(words))) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]


class WordEncoder:
    """Encodes texts (bytes of UTF-8) to ids (bytes of little-endian unsigned 32-bit integers), word by word."""

    def __init__(self, path: str, most_words: int = KEPT_WORDS, most_letters: int = KEPT_LETTERS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most_words, self.most_letters = most_words, most_letters
        self.words: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.merger = Merger(path)
        self.marks: dict[str, bytes] = {"": b""}
        mark = self.tokenizer.encode(" \x00 ", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(n)]

    def _learn(self, words: Iterable[bytes]) -> None:
        """Encode new words: plain letters by merging many at once, all others by the library."""
        new = list(words)
        parts = LINES.findall(b"\n".join(new).decode())  # a word has no line end
        plain = [i for i, (x, _) in enumerate(parts) if x]
        lower = "\n".join([parts[i][0] for i in plain]).lower().split("\n") if plain else []
        after = [parts[i][1] for i in plain]
        known, marks = self.words, self.marks
        if len(self.letters) > self.most_letters:
            self.letters = dict(islice(self.letters.items(), self.most_letters // 2))
        letters = self.letters
        fresh = list(set(lower).difference(letters))
        letters.update(zip(fresh, self.merger.encode([x.encode() for x in fresh])))
        for mark, ids in self._many(list(set(after).difference(marks))):
            marks[mark] = ids
        known.update(zip([new[i] for i in plain], [letters[x] + marks[m] if m else letters[x] for x, m in zip(lower, after)]))
        others = {new[i].decode(): new[i] for i, (x, _) in enumerate(parts) if not x}
        for text, ids in self._many(list(others)):
            known[others[text]] = ids
        if len(marks) > 10_000:
            self.marks = {"": b""}

    def _many(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words and their ids, many in one call: between two marks lies one word."""
        alone = [w for w in words if self.mark is None or "\x00" in w]
        plain = [w for w in words if "\x00" not in w] if alone else words
        for k in range(0, len(plain) if self.mark is not None else 0, 500):
            block = plain[k : k + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" \x00 ".join(block)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(block) - 1:
                alone += block
                continue
            raw, a = ids.tobytes(), 0
            for w, b in zip(block, [*(cuts * 4).tolist(), len(raw)]):
                yield w, raw[a:b]
                a = b + 4
        for w in alone:
            yield w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.split() for t in texts]
        known = self.words
        if len(known) > self.most_words:  # the words met first are the frequent ones
            self.words = known = dict(islice(known.items(), self.most_words // 2))
        new: set[bytes] = set()
        for words in split:
            new.update(words)
        if new := new.difference(known):
            self._learn(new)
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        got = np.frombuffer(ids, dtype="<u4").tolist()
        return b" ".join(map(self.tokens.__getitem__, got)).decode()


def encoder(path: str, most_words: int = KEPT_WORDS, most_letters: int = KEPT_LETTERS) -> WordEncoder:
    """One encoder for each Python worker, file and size of its store."""
    key = path, most_words, most_letters
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(*key)
    return _ENCODERS[key]


def cuts_of(data: bytes, size: int = CHUNK) -> list[int]:
    """Where a text is cut: ends of chunks, the last one the end of the text."""
    n = len(data)
    if n <= size:
        return [n]
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    b *= np.uint32(0x9E3779B1)
    b ^= b >> np.uint32(15)
    h = b[SPAN - 1 :].copy()
    for k in range(1, SPAN):
        h += b[SPAN - 1 - k : n - k] * np.uint32(pow(0x85EBCA6B, k, 1 << 32))
    h ^= h >> np.uint32(16)
    found = np.flatnonzero(h % np.uint32(size) == 0) + SPAN
    out, last = [], 0
    for c in found.tolist():
        if c - last >= size // 4 and n - c > 0:
            out.append(c)
            last = c
    return [*out, n]


def loose_ends(chunk: bytes) -> tuple[bytes, bytes | None, bytes]:
    """What precedes the first white space, what lies between (None: there is no white space) and what follows the last."""
    bare = chunk.split(None, 1)
    head = b"" if chunk[:1].isspace() else bare[0] if bare else b""
    if len(head) == len(chunk):
        return head, None, b""
    tail = b"" if chunk[-1:].isspace() else chunk.rsplit(None, 1)[-1]
    return head, chunk[len(head) : len(chunk) - len(tail)], tail


class ChunkEncoder:
    """Encodes texts through a store of chunks that holds a bounded number of bytes."""

    def __init__(self, words: WordEncoder) -> None:
        self.words, self.store, self.held, self.met, self.made = words, {}, 0, 0, 0

    def encode(self, texts: list[bytes]) -> list[bytes]:
        pieces: list[list[bytes]] = []
        for t in texts:
            a, own = 0, []
            for b in cuts_of(t):
                own.append(t[a:b])
                a = b
            pieces.append(own)
        if self.held > KEPT_BYTES:
            self.store, self.held = {}, 0
        store = self.store
        new = list(dict.fromkeys(c for own in pieces for c in own if c not in store))
        ends = [loose_ends(c) for c in new]
        for c, (head, core, tail), ids in zip(new, ends, self.words.encode([core or b"" for _, core, _ in ends])):
            store[c] = head, None if core is None else ids, tail
            self.held += 2 * len(c) + len(ids)
        self.met += sum(map(len, pieces))
        self.made += len(new)
        seams: list[bytes] = []
        laid: list[list[bytes | int]] = []
        for own in pieces:
            out: list[bytes | int] = []
            open_end: list[bytes] = []
            for c in own:
                head, ids, tail = store[c]
                open_end.append(head)
                if ids is None:
                    continue
                out.append(len(seams))
                seams.append(b"".join(open_end))
                out.append(ids)
                open_end = [tail]
            out.append(len(seams))
            seams.append(b"".join(open_end))
            laid.append(out)
        repaired = self.words.encode(seams)
        return [b"".join(repaired[x] if isinstance(x, int) else x for x in out) for out in laid]


def texts_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers, no special token added) of every whole text.

    Null and empty texts have no ids; null ids of documents, repeated rows and rows that tie are encoded row by row;
    strings of special tokens in a text become their ids, as the library does by default; an empty table gives an
    empty table.  Other columns are ignored.  A worker holds a bounded store of words and chunks; nothing is shuffled.
    """
    spark = ready(docs.sparkSession)
    batches_of(spark, 512)
    checked(path)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkEncoder(encoder(path))
        for b in batches:
            got = chunks.encode(texts_of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array(got, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with ``decoded``, the library's text for the ids (tokens joined by a space)."""
    spark = ready(encoded.sparkSession)
    batches_of(spark, 512)
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for b in batches:
            text = pa.array([words.decode(x or b"") for x in b.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, text], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``decode`` of ``encode``, in one pass: a task needs one worker and moves the ids once."""
    spark = ready(docs.sparkSession)
    batches_of(spark, 512)
    checked(path)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        chunks = ChunkEncoder(words)
        for b in batches:
            ids = chunks.encode(texts_of(b.column(1)))
            text = pa.array([words.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), text], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")
