"""Personal data: base patterns, and candidates selected by gradient-boosted trees. DataFrame functions only.

Base spans (email, ip, card, phone) are leftmost, non-overlapping matches of the fixed patterns that
pass their test. Generators of high recall propose further spans: any run of digits and separators
with seven digits or more (``number``), anything around an @ or a spelled-out one (``address``), four or
more dotted or coloned groups (``groups``), and runs of 16 or more letters, digits and joining marks that
mix letters and digits (``secret``); their spans may overlap.

Examples are positive and unlabelled. Positive is a candidate that holds a base span, one that reads as
a base kind once its writing is undone (spelled-out @ and dots, bracketed dots, digits grouped by other
marks, 00 or a bracketed area code for +), and a secret that its text assigns to a credential. Features
are its format and its context, never the tests; the words that make a secret positive are hidden from
its features, so that the same format counts elsewhere too. Boosted depth-two trees are fitted to the
counts of all candidates by feature cell, and thresholds are calibrated for each generator on the half of
the candidates that took no part in fitting: the lowest score from which at least ``PRECISION`` are
positive. Candidates at or above it that hold no base span are added, the higher score first where two
overlap; none overlaps a base span.

How it runs: positions come from splitting a text at the matches and adding up lengths, inside the
row. One scan writes spans and candidate features (no texts); fitting reads counts by cell, of which
there are at most ``CELLS`` whatever the input; trees become one column expression. No shuffle but
that of the cell counts. Patterns are written so that a character is looked at a bounded number of
times (possessive repeats, a look-behind for the start of a run), so long runs do not turn quadratic.

Defined results: null and empty texts have no spans. Repeated and null ids are rows like others. An
empty table gives an empty result. Without candidates nothing is added. Other columns are not looked
at; ``redact`` keeps them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import free, table
from eventloom.session import cut

# Kinds in order, and their patterns. A match starts where the last one ended or at the
# first character of a run, and repeats give nothing back; both find what the plain pattern finds.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.|$)){4}$"

WORD, LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++"
AT, DOT = (rf"\x20?+[\[({{<]\x20?(?i:{w})\x20?[\])}}>]\x20?+" for w in ("at", "dot"))  # in brackets
BARE_AT, BARE_DOT = (rf"\x20(?i:{w})\x20" for w in ("at", "dot"))
GENERATORS = {
    "number": r"(?:[+(]\x20?)?[0-9](?:[\x20().+/-]*+[0-9]){6,}+",
    "address": rf"(?:(?<![^\s@])|\G)[^\s@]*+@\S*+|{WORD}{AT}{LABEL}(?:(?:\.|{DOT}|{BARE_DOT}){LABEL})*+|{WORD}{BARE_AT}{LABEL}(?:(?:{DOT}|{BARE_DOT}){LABEL})++",
    "groups": r"[0-9A-Fa-f]{1,4}+(?:\[?[.:]\]?[0-9A-Fa-f]{1,4}+){3,}+",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{16,}+",
}
SECRET = list(GENERATORS).index("secret")
# what a credential is assigned with, at the end of the text before it
ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|key|bearer|credentials?|auth)[A-Za-z_]{0,8}[\"']?(?:\s{0,3}(?:[:=]|=>|:=)\s{0,3}|\s)[\"']?$"
GROUPED = r"^[0-9]{4}(?:[^0-9]{1,2}[0-9]{2,7})+$"  # digits of a card in groups
CONTEXTS = {  # words before a candidate
    1: r"(?i)(?:mail|contact|write|e-mail)\W*$",
    2: r"(?i)(?:tel|phone|call|fax|mobile|cell|whatsapp)\W*$",
    3: r"(?i)(?:card|visa|credit|iban|account|ssn)\W*$",
    4: r"(?i)(?:ip|host|server|address)\W*$",
    5: r"(?i)(?:version|license|isbn|id|no|nr|page|section|key|token|password)\W*$",
}
#: feature -> number of its values; their product bounds the cells.
FEATURES = {"generator": 4, "digits": 9, "letters": 3, "parts": 6, "marks": 8, "first": 4, "context": 6, "edges": 2, "switches": 3}
CELLS = math.prod(FEATURES.values())

PRECISION = 0.95
ROUNDS = 30
RATE = 0.3
BLOCK = 128


def _running(lengths: Column) -> Column:
    """Exclusive running totals of an array of ints, in blocks so that long arrays stay linear."""

    def plain(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(a, start, step, lambda acc: acc["out"])

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK)
    )
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda x, y: x + y))
    wide = F.flatten(F.zip_with(blocks, plain(totals), lambda b, first: F.transform(plain(b), lambda x: x + first)))
    return F.when(F.size(lengths) <= BLOCK, plain(lengths)).otherwise(wide)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + worth(i))
    return F.length(digits).between(14, 19) & (F.when(F.length(digits).between(14, 19), total) % 10 == 0)


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return _luhn(value)
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)


def _any_of(kind: str, value: Column) -> Column:
    return F.exists(F.regexp_extract_all(value, F.lit(PATTERNS[kind]), F.lit(0)), lambda v: _passes(kind, v))


def _holds(value: Column) -> Column:
    """Whether a candidate holds a base span."""
    mail, ip, card, phone = (_any_of(k, value) for k in KINDS)
    return mail | ip | card | phone


def _reads(generator: int, value: Column, before: Column) -> Column:
    """Whether a candidate without a base span reads as personal data once its writing is undone."""
    name = list(GENERATORS)[generator]
    if name == "address":
        return _any_of("email", F.regexp_replace(F.regexp_replace(value, f"{AT}|{BARE_AT}", "@"), f"{DOT}|{BARE_DOT}", "."))
    if name == "groups":
        return _any_of("ip", F.regexp_replace(value, r"[\[\]]", ""))
    if name == "secret":
        return before.rlike(ASSIGNED)
    written = F.regexp_replace(F.regexp_replace(value, r"^00(?=[1-9])", "+"), r"^\((?=[0-9]{3}\)[^0-9]*[0-9]{3}[^0-9]*[0-9]{4}$)", "+1 (")
    return _any_of("phone", written) | (value.rlike(GROUPED) & _luhn(value))


def _count(value: Column, characters: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, characters, ""))


def _features(generator: int, value: Column, before: Column, after: Column) -> Column:
    digits, letters = _count(value, "[0-9]"), _count(value, "[A-Za-z]")
    bin_ = F.lit(0)
    for i, low in enumerate((1, 7, 9, 10, 12, 14, 17, 20), 1):
        bin_ = F.when(digits >= low, i).otherwise(bin_)
    context = F.lit(0)
    words = F.when(before.rlike(ASSIGNED), "").otherwise(before) if generator == SECRET else before
    for code, cue in reversed(CONTEXTS.items()):
        context = F.when(words.rlike(cue), code).otherwise(context)
    marks = sum((F.when(value.rlike(c), b).otherwise(0) for b, c in ((1, r"\."), (2, "-"), (4, "[()]"))), F.lit(0))
    switches = _count(value, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")  # changes between digits and letters
    first = F.when(value.startswith("+"), 3).when(value.startswith("("), 2).when(value.rlike("^[0-9]"), 1).otherwise(0)
    return F.struct(
        F.lit(generator).alias("generator"),
        bin_.alias("digits"),
        F.when(letters == 0, 0).when(letters > digits, 2).otherwise(1).alias("letters"),
        F.greatest(F.least(F.size(F.regexp_extract_all(value, F.lit("[A-Za-z0-9]+"), F.lit(0))) - 1, F.lit(5)), F.lit(0)).alias("parts"),
        marks.alias("marks"),
        first.alias("first"),
        context.alias("context"),
        F.when(before.rlike(r"[A-Za-z0-9]$") | after.rlike("^[A-Za-z0-9]"), 1).otherwise(0).alias("edges"),
        F.when(switches >= 4, 2).when(switches >= 2, 1).otherwise(0).alias("switches"),
    )


def _matches(text: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Adds g_<name> (texts between matches) and m_<name> (matches) for each pattern."""
    t = F.col("body")
    seen = {"number": t.rlike("[0-9]"), "at": t.contains("@"), "spelled": t.rlike(rf"{AT}|{BARE_DOT}"), "plus": t.contains("+"), "colon": t.contains(":")}
    text = text.select("row", "body", *[c.alias(n) for n, c in seen.items()])
    number, at, spelled, plus, colon = map(F.col, seen)
    gate = {"email": at, "address": at | spelled, "phone": plus, "ip": number, "card": number, "number": number, "groups": number | colon, "secret": number}
    columns = []
    for name, pattern in patterns.items():
        body = F.when(gate[name], t)
        found = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
        columns += [F.split(body, pattern, -1).alias(f"g_{name}"), found.alias(f"m_{name}")]
    return text.select("row", *columns)


def _starts(name: str) -> Column:
    gaps, found = F.col(f"g_{name}"), F.col(f"m_{name}")
    both = F.transform(found, lambda v, i: F.length(F.get(gaps, i)) + F.length(v))
    return F.when(F.size(found) > 0, _running(both)).alias(f"p_{name}")


SPAN = "array<struct<start:int,kind_no:int,end:int>>"
CANDIDATE = "array<struct<start:int,end:int,label:boolean,held:boolean,half:int,f:struct<" + ",".join(f"{f}:int" for f in FEATURES) + ">>>"


def scan(docs: DataFrame, row: Column, text: Column) -> DataFrame:
    """row, base (array of spans) and candidates (array with features) of each text; no text is kept."""
    body = docs.select(row.alias("row"), F.coalesce(text, F.lit("")).alias("body"))
    all_ = {**PATTERNS, **GENERATORS}
    found = _matches(body, all_)
    placed = found.select("*", *[_starts(n) for n in all_])

    def start(n: str, i: Column) -> Column:
        return F.get(F.col(f"p_{n}"), i) + F.length(F.get(F.col(f"g_{n}"), i))

    def base(k: str) -> Column:
        each = F.transform(
            F.col(f"m_{k}"),
            lambda v, i: F.struct(
                start(k, i).alias("start"), F.lit(KINDS.index(k)).alias("kind_no"), (start(k, i) + F.length(v)).alias("end"), v.alias("value")
            ),
        )
        passing = F.filter(each, lambda s: _passes(k, s["value"]))
        return F.coalesce(F.transform(passing, lambda s: F.struct(s["start"], s["kind_no"], s["end"])), F.array()).cast(SPAN)

    def proposed(n: str) -> Column:
        gaps, code = F.col(f"g_{n}"), list(GENERATORS).index(n)
        each = F.transform(
            F.col(f"m_{n}"),
            lambda v, i: F.struct(
                start(n, i).alias("start"),
                (start(n, i) + F.length(v)).alias("end"),
                (_holds(v) | _reads(code, v, F.right(F.get(gaps, i), F.lit(24)))).alias("label"),
                _holds(v).alias("held"),
                (F.crc32(v.cast("binary")) % 2).cast("int").alias("half"),  # equal candidates are in one half
                _features(code, v, F.right(F.get(gaps, i), F.lit(24)), F.left(F.get(gaps, i + 1), F.lit(4))).alias("f"),
            ),
        )
        return F.coalesce(each, F.array()).cast(CANDIDATE)

    return placed.select(
        "row",
        F.array_sort(F.concat(*[base(k) for k in KINDS])).alias("base"),
        F.concat(*[proposed(n) for n in GENERATORS]).alias("candidates"),
    )


@dataclass
class Model:
    """Boosted trees (feature, bin, left, right; a leaf is a number) and a threshold per generator."""

    bias: float
    trees: list
    thresholds: list[float]

    def score(self, f: Column) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, most, left, right = node
            return F.when(f[feature] <= most, value(left)).otherwise(value(right))

        return sum((value(t) for t in self.trees), F.lit(self.bias))


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """Best split of the cells by gain, then of both sides; leaves are Newton steps."""
    best, names = (1e-9, None), list(FEATURES)
    if depth:
        whole = g.sum() ** 2 / (h.sum() + 1)
        for j in range(len(names)):
            at_g, at_h = (np.bincount(x[:, j], w, FEATURES[names[j]]).cumsum()[:-1] for w in (g, h))
            gain = at_g**2 / (at_h + 1) + (g.sum() - at_g) ** 2 / (h.sum() - at_h + 1) - whole
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), (j, int(gain.argmax())))
    if best[1] is None:
        return RATE * g.sum() / (h.sum() + 1)
    j, most = best[1]
    low = x[:, j] <= most
    return (names[j], most, _tree(x[low], g[low], h[low], depth - 1), _tree(x[~low], g[~low], h[~low], depth - 1))


def _apply(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    feature, most, left, right = node
    return np.where(x[:, list(FEATURES).index(feature)] <= most, _apply(left, x), _apply(right, x))


def fit(scanned: DataFrame) -> Model:
    """Fit and calibrate on the counts of all candidates by feature cell (at most 2 x ``CELLS`` rows)."""
    each = scanned.select(F.explode("candidates").alias("c")).select("c.f.*", "c.label", "c.half")
    cells = each.groupBy(*FEATURES, "half").agg(F.count("*"), F.sum(F.col("label").cast("int"))).collect()
    data = np.array([tuple(c) for c in cells], np.int64).reshape(-1, len(FEATURES) + 3)
    x, half, n, positive = data[:, :-3], data[:, -3], data[:, -2].astype(float), data[:, -1].astype(float)
    use = half == 0
    if positive[use].sum() == 0:
        return Model(0.0, [], [math.inf] * len(GENERATORS))
    share = (positive[use].sum() + 1) / (n[use].sum() + 2)
    bias, trees = math.log(share / (1 - share)), []
    scores = np.full(len(x), bias)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-scores))
        tree = _tree(x[use], (positive - n * p)[use], (n * p * (1 - p))[use], 2)
        trees.append(tree)
        scores += _apply(tree, x)
    thresholds = []
    for k in range(len(GENERATORS)):
        of = ~use & (x[:, 0] == k)
        order = np.argsort(-scores[of], kind="stable")
        s, good, all_ = scores[of][order], positive[of][order].cumsum(), n[of][order].cumsum()
        last = np.r_[s[1:] != s[:-1], True] if len(s) else np.zeros(0, bool)  # equal scores stand or fall together
        fine = last & (good / np.maximum(all_, 1) >= PRECISION)
        thresholds.append(float(s[fine].min()) - 1e-9 if fine.any() else math.inf)
    return Model(bias, trees, thresholds)


def select(scanned: DataFrame, model: Model) -> DataFrame:
    """row, base and added: candidates at or above their generator's threshold and apart from base spans,
    the best of overlapping ones. Spans of one generator never overlap, so only the others are compared."""
    scored = F.transform(
        F.filter("candidates", lambda c: ~c["held"]),
        lambda c: F.struct(model.score(c["f"]).alias("score"), c["start"].alias("start"), c["end"].alias("end"), c["f"]["generator"].alias("g")),
    )
    limits = F.array(*[F.lit(float(t)) for t in model.thresholds])
    accepted = F.filter(scored, lambda c: c["score"] >= F.get(limits, c["g"]))
    better = lambda o, c: (o["score"] > c["score"]) | ((o["score"] == c["score"]) & ((o["start"] < c["start"]) | ((o["start"] == c["start"]) & (o["g"] < c["g"]))))
    overlap = lambda o, c: (o["start"] < c["end"]) & (c["start"] < o["end"])
    clear = F.filter("accepted", lambda c: ~F.exists("base", lambda o: overlap(o, c)))
    with_clear = scanned.select("row", "base", accepted.alias("accepted")).select(
        "row", "base", F.when(F.size("accepted") > 0, clear).otherwise(F.col("accepted")).alias("clear")
    )
    codes = range(len(GENERATORS))

    def of(k: int) -> Column:
        return F.filter("clear", lambda c: c["g"] == k).alias(f"of_{k}")

    by_code = with_clear.select("row", "base", *map(of, codes))

    def alone(k: int) -> Column:
        others = F.concat(*[F.col(f"of_{j}") for j in codes if j != k])
        return F.filter(f"of_{k}", lambda c: ~F.exists(others, lambda o: overlap(o, c) & better(o, c)))

    kept = F.concat(*[alone(k) for k in codes])
    named = F.transform(kept, lambda c: F.struct(c["start"], F.lit(len(KINDS)) + c["g"], c["end"])).cast(SPAN)
    return by_code.select("row", "base", named.alias("added"))


def _name(kind_no: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in (*KINDS, *GENERATORS)]), kind_no)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _name(s["kind_no"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (start, kind_no, end) in code points, for every row."""
    scanned = cut(scan(docs, docs[doc_id], docs[text]))
    return select(scanned, fit(scanned)).withColumnRenamed("row", "doc_id")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; null texts stay null."""
    whole = free(docs, "whole_row")
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(whole))
    scanned = cut(scan(packed, F.col(whole), F.col(whole)[text]))
    chosen = select(scanned, fit(scanned))
    body = F.col("row")[text]

    def step(acc: Column, s: Column) -> Column:
        piece = F.array(F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(_name(s["kind_no"])), F.lit("]")))
        return F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    finish = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.length(body)))
    spans = chosen.select("row", F.array_sort(F.concat("base", "added")).alias("spans"))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, finish)).otherwise(body)
    return spans.select(*[clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind_no"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
