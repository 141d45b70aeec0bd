"""Language, toxicity and quality models: held-out accuracy on generated texts, edge cases, exact sums."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventloom.llm import kneser_ney, language, quality, toxicity
from eventloom.llm.common import Memo, fold

SYLLABLES = {"xx": "ba be bi bo bu da de di".split(), "yy": "kra kre kri kro stu sta ste".split(), "zz": "lo la li mo ma mi no".split()}


def sentence(draw, syllables, n):
    return " ".join("".join(draw.choices(syllables, k=draw.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    draw = random.Random(1)
    rows = []
    for i in range(240):
        lang = draw.choice(list(SYLLABLES))
        rows.append((i, sentence(draw, SYLLABLES[lang], draw.randrange(5, 60)), lang if i % 9 else None, lang, "s"))
    rows += [(900, None, "xx", "und", "s"), (901, "", "xx", "und", "s"), (902, "12 + 3 ...", "xx", "und", "s"), (None, "kra stu", "yy", "yy", "s"), (3, rows[3][1], rows[3][2], rows[3][3], "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, score string")


def test_language(spoken):
    identifier = language.Identifier(spoken, fold(F.col("doc_id"), 4) != 2)
    rows = spoken.select("doc_id", "text", "truth", identifier.classify(F.col("text")).alias("c")).collect()
    assert len(rows) == spoken.count()
    assert all(r.c.lang_pred == r.truth and 0 <= r.c.score <= 1 for r in rows)
    assert all(r.c.rejected and r.c.score == 0 for r in rows if r.truth == "und")
    assert not any(r.c.rejected for r in rows if r.truth != "und")
    junk = spoken.limit(1).select(identifier.classify(F.lit("qqqzzz wwwvvv jjjxxx qqqq ßßß")).alias("c")).first().c
    assert junk.rejected


def test_language_without_examples(spoken):
    for docs in (spoken.limit(0), spoken.filter("doc_id > 899")):
        kept = language.keep_identified(docs)
        assert kept.count() == 0 and kept.columns == spoken.columns


def plain_kneser_ney(classes, order, shared):
    """Textbook recursion over dictionaries, for the words of each class: log-probability of a word under a class."""
    counts = [{n: {} for n in range(1, order + 1)} for _ in classes]
    for words, grams in zip(classes, counts):
        for w in words:
            m = f"<{w}>"
            for n in grams:
                for i in range(max(n - 1, 1), len(m)):
                    g = m[i - n + 1 : i + 1]
                    grams[n][g] = grams[n].get(g, 0) + 1
    used = []
    for grams in counts:
        of = {order: dict(grams[order])}
        for n in range(1, order):
            left = {}
            for g in grams[n + 1]:
                left[g[1:]] = left.get(g[1:], 0) + 1
            of[n] = {g: left.get(g) or 1 for g in grams[n]}
        used.append(of)
    for n in range(1, shared + 1):
        pooled = {}
        for of in used:
            for g, k in of[n].items():
                pooled[g] = pooled.get(g, 0) + k
        for of in used:
            of[n] = pooled
    alphabet = {g for grams in counts for g in grams[1]}
    size = len(alphabet) + 1

    def p(of, context, c):
        n = len(context) + 1
        if n == 1:
            return (of[1].get(c, 0) + 1) / (sum(of[1].values()) + size) if c in alphabet else 1 / (size * 4)
        after = {g: k for g, k in of[n].items() if g[:-1] == context}
        lower = p(of, context[1:], c)
        if not after:
            return lower
        total, seen = sum(after.values()), after.get(context + c, 0)
        return max(seen - kneser_ney.DISCOUNT, 0) / total + kneser_ney.DISCOUNT * len(after) / total * lower

    def of_word(c, w):
        m = f"<{w}>"
        return sum(math.log(p(used[c], m[max(0, i - order + 1) : i], m[i])) for i in range(1, len(m)))

    return of_word


CORPUS = [("banana bandana nab ban abba", 0), ("nana na <b b>n <<", 0), ("zzz nanz bazn \U0001d4b7an", 1), ("", 1), (None, 0), ("banana", 1)]
TRIED = ["banana", "nabba", "b", "abandon", "zzzzz", "qqq", "b<n", "ba\u00e9n", "\U0001d4b7", "<", ">"]


@pytest.mark.parametrize("order, shared", [(1, 0), (3, 0), (4, 2), (5, 2), (3, 3)])
def test_kneser_ney_equals_the_recursion(spark, order, shared):
    frame = spark.createDataFrame(CORPUS, "text string, cls int").repartition(3)
    model = kneser_ney.fit(frame, 2, order, 64, shared)
    plain = plain_kneser_ney([[w for t, k in CORPUS if k == c for w in (t or "").split()] for c in (0, 1)], order, shared)
    for w, row in zip(TRIED, model.score(TRIED)):
        assert [row[0], row[1]] == pytest.approx([plain(0, w), plain(1, w)], abs=1e-9)
        assert row[2] == len(w) + 1


def test_models_of_many_files_that_cannot_be_mapped(spark, monkeypatch):
    frame = spark.createDataFrame(CORPUS, "text string, cls int")
    one = kneser_ney.fit(frame, 2, 4, 64, 2)
    monkeypatch.setattr(kneser_ney, "FILES_HELD", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = kneser_ney.fit(frame.repartition(4), 2, 4, 64, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    many.mapped = False
    assert sum(map(len, many.files.values())) > sum(map(len, one.files.values()))
    assert np.allclose(one.score(TRIED * 3), many.score(TRIED * 3), atol=1e-12)
    assert len(many._open) <= 2


def test_models_without_texts(spark):
    empty = kneser_ney.fit(spark.createDataFrame([], "text string, cls int"), 2, 3, 64)
    row = empty.score(["ab"])[0]
    assert row[0] == row[1] < 0 and row[2] == 3


def test_memo_is_bounded_and_exact():
    memo = Memo(lambda words: np.array([[len(w)] for w in words]), most=3)
    for words in (["a", "bb", "a"], ["ccc", "dddd", "a"], ["eeeee", "bb"]):
        assert memo.rows(words)[:, 0].tolist() == [len(w) for w in words]
    assert len(memo) <= 5


@pytest.fixture(scope="module")
def judged(spark):
    """Toxic texts hold one of a family of words; bad ones repeat themselves and shout."""
    draw = random.Random(6)
    docs, labels = [], []
    for i in range(700):
        words = sentence(draw, SYLLABLES["xx"] + SYLLABLES["yy"], draw.randrange(20, 120)).split()
        toxic, good = int(i % 6 == 0), int(i % 5 != 0)
        if toxic:
            for _ in range(max(1, len(words) // 25)):
                words[draw.randrange(len(words))] = "gruz" + draw.choice(["nak", "ol", "emi", "ark"])
        if not good:
            words = [w.upper() + "!!" for w in words[:6]] * 8
        docs.append((i, " ".join(words), "s"))
        if i % 10:
            labels.append((i, good, toxic))
    docs += [(800, None, "s"), (801, "", "s"), (None, "gruznak", "s"), (5, docs[5][1], "s")]
    labels += [(5, 0, 0), (800, 1, 0), (None, 1, 1), (9999, 1, 1), (6, None, None)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, quality string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


@pytest.mark.parametrize("kind, limit", [(toxicity, 0.5), (quality, 0.3)])
def test_held_out(judged, kind, limit):
    docs, labels = judged
    scored = docs.select("doc_id", "text", (fold(F.col("doc_id"), 5) == 0).alias("held"), kind.Scorer(docs, labels).score(F.col("text")).alias("s")).collect()
    assert len(scored) == docs.count() and all(0 <= r.s <= 1 for r in scored)
    truth = (lambda i: i % 6 == 0) if kind is toxicity else (lambda i: i % 5 != 0)
    held = [r for r in scored if r.held and r.doc_id is not None and r.doc_id < 700]
    assert len(held) > 60 and sum((r.s >= limit) == truth(r.doc_id) for r in held) >= 0.95 * len(held)


@pytest.mark.parametrize("kind", [toxicity, quality])
def test_one_class_or_none(judged, kind):
    docs, labels = judged
    label = kind.__name__.rsplit(".", 1)[-1].replace("toxicity", "toxic")
    ones = labels.filter(f"{label} = 1 and doc_id < 700")
    for some, want in ((ones, 1.0), (labels.limit(0), 0.0)):
        assert {r.s for r in docs.select(kind.Scorer(docs, some).score(F.col("text")).alias("s")).collect()} == {want}
    assert docs.limit(0).select(kind.Scorer(docs.limit(0), labels).score(F.col("text"))).count() == 0


def test_labels_do_not_need_a_broadcast(judged, monkeypatch):
    from eventloom.llm import common

    docs, labels = judged
    one = common.labelled(docs, labels, "quality", fold(docs["doc_id"], 5)).collect()
    monkeypatch.setattr(common, "LABELS_BROADCAST", 0)
    other = common.labelled(docs, labels, "quality", fold(docs["doc_id"], 5)).collect()
    assert sorted(map(str, one)) == sorted(map(str, other))


def test_isotonic_is_monotone_and_close():
    x = np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5, 0.6])
    knots, values = quality.isotonic(x, np.array([0, 0, 1, 0, 1, 1, 1.0]))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) > 0).all()
    assert values[0] < 0.5 < values[-1]


def test_equations_equal_one_fit(spark):
    draw = np.random.default_rng(1)
    x = draw.standard_normal((300, len(quality.STATISTICS)))
    y = (x[:, 0] > 0).astype(int)
    features = quality.Features(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    rows = spark.createDataFrame([(int(b), 1, a.tolist()) for a, b in zip(x, y)], "y int, fold long, x array<double>").repartition(5)
    z = features(x)
    gram = z.T @ z
    want = np.linalg.solve(gram + quality.RIDGE * gram[-1, -1] * np.eye(len(gram)) / quality.WIDTH, z.T @ y)
    assert np.allclose(quality.Scorer._solve(rows, features), want)


def test_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf).cache()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.columns == [*docs.columns, "token_ids", "n_tokens"]
    assert 0.7 * docs.count() < out.count() <= docs.count()
    assert out.filter("size(token_ids) <> n_tokens or n_tokens = 0").count() == 0
    from eventloom.llm import decontaminate, simhash

    assert simhash.deduplicate(docs).join(out, "doc_id", "left_semi").count() == out.count()
    bad = decontaminate.overlaps(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert out.join(bad, "doc_id").count() == 0
    assert out.filter(F.col("text").rlike(r"[a-z0-9.]+@[a-z0-9]+\.example\.com")).count() == 0
