"""Plain Python for what the operators return."""

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(rows, depth=50):
    """{doc_id: sorted (n_bytes, n_removed, n_spans, kept_sha256)}"""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - depth + 1) if i is not None else ():
            w = b[p : p + depth]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1) if i is not None else ():
            if first[b[p : p + depth]] < i:
                gone[p : p + depth] = b"\x01" * depth
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.setdefault(i, []).append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, radius=3):
    """{doc_id: (fingerprint, component)} for distinct ids."""
    prints = [(i, fingerprint(t)) for i, t in rows]
    label = {i: i for i, _ in prints}
    moved = True
    while moved:
        moved = False
        for i, f in prints:
            least = min(label[j] for j, g in prints if (f ^ g).bit_count() <= radius)
            if least < label[i]:
                label[i], moved = least, True
    return {i: (format(f, "016x"), label[i]) for i, f in prints}


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def kneser_ney(texts, order=5):
    """A function from a run to its log probability by modified Kneser-Ney over byte runs, and the runs that were met."""
    top = Counter()
    for t in texts:
        b = b"\x02" * (order - 1) + t
        top.update(b[i : i + order] for i in range(len(b) - order + 1))
    counts = {order: top}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(run[1:] for run in counts[k + 1])

    def discounts(c):
        t = [sum(1 for n in c.values() if n == i) for i in range(5)]
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else None
        out = []
        for i in (1, 2, 3):
            d = i - (i + 1) * y * t[i + 1] / t[i] if y is not None and t[i] else None
            out.append(0.5 if d is None else min(max(d, 0.05), i - 0.05))
        return out

    cut = {k: discounts(c) for k, c in counts.items()}
    total, mass = defaultdict(int), defaultdict(float)
    for k, c in counts.items():
        for run, n in c.items():
            total[run[:-1], k] += n
            mass[run[:-1], k] += cut[k][min(n, 3) - 1]

    def p(run):
        k = len(run)
        n = counts[k][run]
        below = p(run[1:]) if k > 1 else 1 / 256
        if not total[run[:-1], k]:
            return below
        own = (max(n - cut[k][min(n, 3) - 1], 0) if n else 0) / total[run[:-1], k]
        return own + mass[run[:-1], k] / total[run[:-1], k] * below

    return lambda run: math.log(p(run)), set(top)


def half(text):
    """The half of a text for cross-scoring: Spark's xxhash64 of it, modulo 2."""
    return xxhash.xxh64_intdigest(text, 42) % 2


def bands(rows, wide=2.0, measured=16):
    """{key: kept} for rows (key, lang, n_bytes, failed, log perplexity): the language's median, give or take ``wide``
    ranges of texts of that length."""
    quantile = lambda v, q: sorted(v)[max(0, math.ceil(q * len(v)) - 1)]
    out = {}
    for lang in {r[1] for r in rows}:
        fair = [(n, x) for _, g, n, failed, x in rows if g == lang and not failed]
        if not fair:
            out |= {r[0]: False for r in rows if r[1] == lang}
            continue
        q1, q2, q3 = (quantile([x for _, x in fair], q) for q in (0.25, 0.5, 0.75))
        classes = defaultdict(list)
        for n, x in fair:
            classes[math.floor(math.log2(n))].append((n, x))
        points = []
        for c in classes.values():
            if len(c) >= measured:
                x = sum(1 / n for n, _ in c) / len(c)
                y = (quantile([v for _, v in c], 0.75) - quantile([v for _, v in c], 0.25)) ** 2
                points.append((x, y, len(c) / x))
        a = b = None
        if points:
            w, wx, wy, wxx, wxy = (sum(f) for f in zip(*[(w, w * x, w * y, w * x * x, w * x * y) for x, y, w in points]))
            spread = w * wxx - wx * wx
            b = (w * wxy - wx * wy) / spread if spread > 1e-9 * w * wxx else 0.0
            a = (wy - b * wx) / w
            if b < 0:
                a, b = wy / w, 0.0
            elif a < 0:
                a, b = 0.0, wxy / wxx
        for key, g, n, failed, x in rows:
            if g == lang:
                half = wide * max(math.sqrt(a + b / max(n, 1)) if points else q3 - q1, 0.005)
                out[key] = not failed and (x is None or q2 - half <= x <= q2 + half)
    return out


def hash_of_long(x):
    """xxhash64 of a long as Spark takes it."""
    v = xxhash.xxh64_intdigest(struct.pack("<q", x), 42)
    return v - (1 << 64) if v >> 63 else v


def mixed(rows, weights=(1, 2, 3), cap=3):
    """{doc_id: (taken, [positions])} of rows (doc_id, source, size), each id once: targets by filling, passes in hashed order."""
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in total)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, dict(weight), sum(total.values())
    while free:
        level = left / sum(free.values())
        full = [s for s, w in free.items() if w * level > cap * total[s]]
        for s in full:
            target[s] = cap * total[s]
            left -= target[s]
            del free[s]
        if not full:
            target |= {s: w * level for s, w in free.items()}
            break
    out = {}
    for s in order:
        run = 0
        whole = max(total[s], 1)
        passes = min(math.floor(target[s] / whole + 1e-9), cap)
        for i, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (hash_of_long(r[0]), r[0])):
            middle = run + n / 2
            run += n
            turns = 0 if not n else passes + (middle <= target[s] - passes * whole and passes < cap)
            slope = (weight[s] - 2) * 0.5
            at = []
            for t in range(turns):
                share = min((t * whole + middle) / target[s], 1.0)
                low, high = 0.0, 1.0  # the integral of the schedule from 0 to u is u (1 - slope) + slope u^2
                for _ in range(60):
                    u = (low + high) / 2
                    low, high = (u, high) if u * (1 - slope) + slope * u * u < share else (low, u)
                at.append(low)
            out[i] = (turns * n, at)
    return out
