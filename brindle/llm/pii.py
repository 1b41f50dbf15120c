"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base spans are regular expressions with checks.  Besides them, wide candidates are judged: regex, gazetteer, context,
shape and checksum labelers vote for, against or not at all; expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is for each kind; the resulting posteriors are soft labels from which a final span
classifier (naive Bayes over span features) is trained.  Candidates that it scores high enough are added to the base
spans.  What the driver sees is one row per vote pattern and per feature value, both bounded by construction
(4 kinds x 3**5 patterns; the feature values listed below); the arithmetic on them is plain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Possessive forms of the base patterns: each class excludes what must follow it, so they match the same and never
# retry; \G lets a match begin where the last one ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: A text without these has no match; cheaper than the pattern.
HINTS = {"email": "instr({t}, '@') > 0", "ip": r"{t} rlike r'[0-9]\.[0-9]'", "card": "{t} rlike '[0-9][ -]?[0-9]'", "phone": r"{t} rlike r'\+[0-9]'"}

# What the labelers know.
CANDIDATES = {
    "mail": r"(?<![^\s@<>(),;:\x22])[^\s@<>(),;:\x22]{1,64}(?:@|\x20?[\[(]at[\])]\x20?)[^\s@<>(),;:\x22]{1,255}",
    "number": r"(?<![0-9.+])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}(?![0-9])",
}
CANDIDATE_HINTS = {"mail": r"{t} rlike r'@|[\[(]at[\])]'", "number": r"{t} rlike r'[0-9](?:[ ().-]{0,2}[0-9]){6}'"}
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
CUES = {"email": "e-?mail|contact|write to|courriel|correo", "ip": r"\bip\b|host|server|address|adresse", "card": "card|visa|amex|iban|tarjeta|carte|karte", "phone": r"phone|tel|call|fax|mobile|m[oó]vil|handy"}
DENIALS = r"version|isbn|section|page|order|invoice|number|nr\.|no\.|id[:=]|token|=\s*$"
VOTES = ("regex", "gazetteer", "context", "shape", "checksum")
SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` for a value that is taken once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _spans(text: str, pattern: str, hint: str) -> Column:
    """The leftmost non-overlapping matches with code point offsets, up to 32 characters since the match before, and the
    character after.

    Gaps between matches come from a split by the same pattern; offsets are running sums of both lengths.  They are summed
    in parts of about the root of the number of matches, and the parts' totals then again, because appending to an array
    copies it: a text with n matches takes n ** 1.5 steps.
    """
    p = "r'" + pattern + "'"
    cells = "transform(ms, (v, i) -> named_struct('v', v, 'g', gs[i], 'r', substring(gs[i + 1], 1, 1)))"
    part = f"""aggregate(c, named_struct('at', 0, 'out', CAST(array() AS {SPAN})), (a, x) -> named_struct('at', a.at + length(x.g) + length(x.v), 'out', array_append(a.out,
        named_struct('start', a.at + length(x.g), 'end', a.at + length(x.g) + length(x.v), 'value', x.v, 'left', right(x.g, 32), 'right', x.r))))"""
    step = "cast(ceil(sqrt(size(m))) AS int)"
    parts = f"transform(sequence(1, size(m), {step}), i -> {_let('c', f'slice(m, i, {step})', part)})"
    starts = "aggregate(ps, array(0), (s, q) -> array_append(s, s[size(s) - 1] + q.at))"
    moved = "flatten(transform(ps, (q, i) -> transform(q.out, x -> named_struct('start', x.start + st[i], 'end', x.end + st[i], 'value', x.value, 'left', x.left, 'right', x.right))))"
    none = f"CAST(array() AS {SPAN})"
    some = _let("ms", f"regexp_extract_all({text}, {p}, 0)", f"IF(size(ms) = 0, {none}, {_let('gs', f'split({text}, {p}, -1)', _let('m', cells, _let('ps', parts, _let('st', starts, moved))))})")
    return F.expr(f"CASE WHEN {hint.replace('{t}', text)} THEN {some} ELSE {none} END")


#: Candidates that share no character with a base span: one pass by rising start drops those that begin inside a base
#: span, one by falling start those in which one begins.
CLEAR = """IF(size(_cand) = 0, _cand, transform(aggregate(
    array_sort(concat(transform(_base, b -> named_struct('at', -b.start, 'cand', false, 'end', b.end, 'i', -1)), aggregate(
        array_sort(concat(transform(_base, b -> named_struct('at', b.start, 'cand', false, 'end', b.end, 'i', -1)), transform(_cand, (x, i) -> named_struct('at', x.start, 'cand', true, 'end', x.end, 'i', i)))),
        named_struct('till', 0, 'out', CAST(array() AS array<struct<at:int,cand:boolean,end:int,i:int>>)),
        (a, x) -> CASE WHEN NOT x.cand THEN named_struct('till', greatest(a.till, x.end), 'out', a.out) WHEN a.till > x.at THEN a
            ELSE named_struct('till', a.till, 'out', array_append(a.out, named_struct('at', -x.at, 'cand', true, 'end', x.end, 'i', x.i))) END,
        a -> a.out))),
    named_struct('from', 2147483647, 'out', CAST(array() AS array<int>)),
    (a, x) -> CASE WHEN NOT x.cand THEN named_struct('from', -x.at, 'out', a.out) WHEN a.from < x.end THEN a ELSE named_struct('from', a.from, 'out', array_append(a.out, x.i)) END,
    a -> a.out), i -> _cand[i]))"""


VALID = {
    "email": "true",
    "ip": rf"x.value rlike r'^{OCTET}(?:\.{OCTET}){{3}}$'",
    "card": "length(translate(x.value, ' -', '')) BETWEEN 14 AND 19 AND luhn_check(translate(x.value, ' -', ''))",
    "phone": "length(regexp_replace(x.value, '[^0-9]', '')) BETWEEN 10 AND 15",
}


def with_base(docs: DataFrame) -> DataFrame:
    """Adds _t (the text, null as empty) and one array of base spans for each kind."""
    out = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    out = out.withColumns({f"_{k}": _spans("_t", PATTERNS[k], HINTS[k]) for k in KINDS})
    return out.withColumns({f"_{k}": F.expr(f"filter(_{k}, x -> {VALID[k]})") for k in KINDS if VALID[k] != "true"})


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds _cand: candidates with their kind, votes and features.  Needs the columns of ``with_base``."""
    out = docs.withColumns({f"_c_{k}": _spans("_t", CANDIDATES[k], CANDIDATE_HINTS[k]) for k in CANDIDATES})
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    kind = rf"CASE WHEN x.value rlike r'@|[\[(]at[\])]' THEN 'email' WHEN x.value rlike r'^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$' THEN 'ip' WHEN length({digits}) >= 13 AND x.value not like '+%' THEN 'card' ELSE 'phone' END"
    out = out.withColumn("_cand", F.expr(f"""transform(concat(_c_mail, _c_number), x -> named_struct(
        'start', x.start, 'end', x.end, 'value', x.value, 'kind', {kind}, 'digits', {digits},
        'left', lower(x.left), 'right', x.right))"""))
    vote = lambda yes, no: f"CASE WHEN {yes} THEN '+' WHEN {no} THEN '-' ELSE '0' END"
    by_kind = lambda forms: "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {forms[k]}" for k in KINDS) + " END"
    tops = ",".join(f"'{d}'" for d in TOP_DOMAINS)
    top = r"lower(regexp_extract(x.value, r'([A-Za-z]+)[^A-Za-z]*$', 1))"
    octets = VALID["ip"]
    yes = lambda test: vote(test, "false")  # noqa: E731  says nothing where it does not know
    votes = {
        "regex": by_kind({k: yes(f"x.value rlike r'^(?:{PATTERNS[k]})$'") for k in KINDS}),
        "gazetteer": by_kind({"email": yes(f"{top} IN ({tops})"), "ip": vote("false", "x.digits like '0%' OR x.digits like '255%'"), "card": yes("x.digits rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6)'"), "phone": vote("x.value rlike r'^\\+[1-9]'", "x.digits like '0000%'")}),
        "context": by_kind({k: vote(f"x.left rlike r'(?:{CUES[k]})'", f"x.left rlike r'(?:{DENIALS})'") for k in KINDS}),
        "shape": by_kind({"email": vote(r"x.value rlike r'@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]$'", r"x.value not like '%.%'"), "ip": vote(r"x.value rlike r'^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$'", "true"), "card": yes(r"x.value rlike r'^(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}[ -][0-9]{1,7})$'"), "phone": vote(r"x.value rlike r'^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$'", "x.value rlike '^[0-9]+$'")}),
        "checksum": by_kind({"email": "'0'", "ip": vote(octets, "true"), "card": vote("length(x.digits) BETWEEN 14 AND 19 AND luhn_check(x.digits)", "true"), "phone": vote("length(x.digits) BETWEEN 10 AND 15", "true")}),
    }
    # The classifier sees the span, not the votes, but for what a check says: features of few values each.
    features = {
        "size": "least(floor(length(x.value) / 4), 12)",
        "digits": "least(length(x.digits), 20)",
        "begins": "CASE WHEN x.value like '+%' THEN 'plus' WHEN x.value like '(%' THEN 'bracket' WHEN x.value rlike '^[0-9]' THEN 'digit' ELSE 'letter' END",
        "marks": r"CASE WHEN x.value rlike r'^[0-9]+$' THEN 'none' WHEN x.value rlike r'^[0-9.]+$' THEN 'dots' WHEN x.value like '%@%.%' THEN 'at' WHEN x.value like '%@%' THEN 'bare at' WHEN x.value like '%(%' THEN 'brackets' ELSE 'other' END",
        "check": votes["checksum"],
        "right": r"CASE WHEN x.right = '' THEN 'end' WHEN x.right rlike r'\s' THEN 'space' WHEN x.right rlike r'[\w]' THEN 'word' ELSE 'mark' END",
        "left": r"CASE WHEN x.left = '' THEN 'end' WHEN x.left rlike r'\s$' THEN 'space' WHEN x.left rlike r'\w$' THEN 'word' ELSE 'mark' END",
    }
    return out.withColumn("_cand", F.expr(f"""transform(_cand, x -> named_struct(
        'start', x.start, 'end', x.end, 'kind', x.kind,
        'votes', concat(x.kind, ':', {", ".join(votes[v] for v in VOTES)}),
        'features', array({", ".join(f"concat(x.kind, ':{n}=', CAST({f} AS string))" for n, f in features.items())})))"""))


@dataclass
class Model:
    """prior and reliabilities (votes '+' and '-' given personal data or not) by kind; scores by feature value."""

    prior: dict[str, float] = field(default_factory=dict)
    reliability: dict[tuple[str, str], dict[str, tuple[float, float]]] = field(default_factory=dict)
    posterior: dict[str, float] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)
    weight: dict[str, float] = field(default_factory=dict)


#: What is believed of a labeler at first: its votes on personal data and on other candidates.
BELIEF = {"+": (0.5, 0.1), "-": (0.05, 0.3), "0": (0.45, 0.6)}
#: What a check says is known, so its reliability is given: one that fails is near to proof.
KNOWN = {"checksum": {"+": (0.9, 0.1), "-": (0.01, 0.89), "0": (0.09, 0.01)}}


def estimate(patterns: dict[str, int], rounds: int = 30, trust: float = 0.5) -> Model:
    """Expectation-maximisation over counts of 'kind:votes'.

    Left alone the likelihood of a few labelers has maxima that call everything personal data.  So beliefs count as
    ``trust`` times as many candidates as there are, what a check is worth is given, and a vote for (against) is never more
    usual where the truth is no (yes).
    """
    model = Model()
    for kind in KINDS:
        own = {p.split(":", 1)[1]: n for p, n in patterns.items() if p.startswith(kind + ":")}
        prior, rel = 0.5, [dict(KNOWN.get(name, BELIEF)) for name in VOTES]
        post: dict[str, float] = {}
        all_n = sum(own.values())
        for _ in range(rounds):
            for p in own:
                yes = math.log(prior) + sum(math.log(rel[j][v][0]) for j, v in enumerate(p) if v != "0")
                no = math.log(1 - prior) + sum(math.log(rel[j][v][1]) for j, v in enumerate(p) if v != "0")
                post[p] = 1 / (1 + math.exp(max(-700.0, min(700.0, no - yes))))
            yes = sum(n * post[p] for p, n in own.items())
            weight = max(20.0, trust * all_n)
            prior = (yes + weight / 2) / (all_n + weight)
            for j in (j for j, name in enumerate(VOTES) if name not in KNOWN):
                for v in "+-0":
                    a = sum(n * post[p] for p, n in own.items() if p[j] == v)
                    b = sum(n * (1 - post[p]) for p, n in own.items() if p[j] == v)
                    start = BELIEF[v]
                    a, b = (a + weight * start[0]) / (yes + weight), (b + weight * start[1]) / (all_n - yes + weight)
                    wrong = (v == "+" and a < b) or (v == "-" and a > b)
                    rel[j][v] = ((a + b) / 2, (a + b) / 2) if wrong else (a, b)
        model.prior[kind] = prior
        model.reliability |= {(kind, name): rel[j] for j, name in enumerate(VOTES)}
        model.posterior |= {f"{kind}:{p}": x for p, x in post.items()}
    return model


def _lookup(values: dict[str, float], key: str) -> str:
    """SQL that finds a key's value, 0 where there is none."""
    if not values:
        return "0D"
    pairs = ", ".join(f"'{k}', {v!r}D" for k, v in sorted(values.items()))
    return f"coalesce(element_at(map({pairs}), {key}), 0D)"


def fit(docs: DataFrame) -> Model:
    """Two small aggregations over the candidates of all documents: vote patterns, then features by soft label."""
    found = with_candidates(with_base(docs.select("text"))).where("size(_cand) > 0").selectExpr("explode(_cand) AS x").select("x.votes", "x.features")
    rows = found.groupBy("votes", "features").count().checkpoint()
    patterns = {r["votes"]: r["n"] for r in rows.groupBy("votes").agg(F.sum("count").alias("n")).collect()}
    model = estimate(patterns)
    soft = rows.withColumn("p", F.expr(_lookup(model.posterior, "votes"))).selectExpr("explode(features) AS f", "count * p AS yes", "count * (1 - p) AS no")
    counts = {r["f"]: (r["yes"], r["no"]) for r in soft.groupBy("f").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()}
    for kind in KINDS:
        own = [(n * model.posterior[p], n * (1 - model.posterior[p])) for p, n in patterns.items() if p.startswith(kind + ":")]
        yes, no = sum(a for a, _ in own), sum(b for _, b in own)
        model.bias[kind] = math.log((yes + 1) / (no + 1))
        for f, (a, b) in counts.items():
            if f.startswith(kind + ":"):
                model.weight[f] = math.log((a + 1) / (yes + 20)) - math.log((b + 1) / (no + 20))
    return model


def detect(docs: DataFrame, model: Model | None = None, threshold: float = 0.98) -> DataFrame:
    """The rows of ``docs`` with _t, _email, _ip, _card, _phone (base spans) and _spans (all, by start and kind).

    Added spans have a classifier score of at least ``threshold`` and no character in common with a base span.  Null and empty texts have no span; every row counts for itself, repeated or not; no id is used; an empty table
    gives an empty table.  Input columns stay as they are (names that begin with an underscore are this operator's own).
    """
    if docs.sparkSession.sparkContext.getCheckpointDir() is None:
        from ._common import ready

        ready(docs.sparkSession)
    model = model or fit(docs)
    logit = math.log(threshold / (1 - threshold))
    based = with_base(docs)
    order = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    base = ", ".join(f"transform(_{k}, x -> named_struct('start', x.start, 'rank', {i}, 'end', x.end, 'kind', '{k}'))" for i, k in enumerate(KINDS))
    out = with_candidates(based).withColumn("_base", F.expr(f"array_sort(concat({base}))"))
    score = f"{_lookup(model.bias, 'x.kind')} + aggregate(x.features, 0D, (s, f) -> s + {_lookup(model.weight, 'f')})"
    added = f"""transform(filter({CLEAR}, x -> {score} >= {logit!r}D),
        x -> named_struct('start', x.start, 'rank', CASE x.kind {order} END, 'end', x.end, 'kind', x.kind))"""
    out = out.withColumn("_spans", F.expr(f"array_sort(concat(_base, {added}))"))
    return out.drop("_c_mail", "_c_number", "_cand")


def joined(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def summarise(found: DataFrame) -> DataFrame:
    """doc_id, counts and digests of what ``detect`` found."""
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_spans").alias("spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one; null texts stay null."""
    found = detect(docs, model)
    masked = F.expr("""aggregate(_spans, named_struct('at', 0, 'out', ''),
        (a, x) -> IF(x.start < a.at, named_struct('at', greatest(a.at, x.end), 'out', a.out),
            named_struct('at', x.end, 'out', concat(a.out, substring(_t, a.at + 1, x.start - a.at), '[', upper(x.kind), ']'))),
        a -> concat(a.out, substring(_t, a.at + 1, length(_t))))""")
    text = F.when(F.size("_spans") > 0, masked).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)
