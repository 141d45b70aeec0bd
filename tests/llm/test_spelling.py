"""Spelling variants against a plain reading of their definition."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from eventloom.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_variants(n):
    """By the words that one edit can make: each with one place left out or wild."""
    places = {}
    for w in n:
        for i in range(len(w)):
            places.setdefault((w[:i], "?", w[i + 1 :]), []).append(w)
    near = {w: set() for w in n}
    for held in places.values():
        for a in held:
            near[a] |= {b for b in held if b != a}
    for w in n:
        for i in range(len(w)):
            shorter = w[:i] + w[i + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(rows)


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in frame.collect())


def edited(draw, word, letters):
    i = draw.randrange(len(word))
    return draw.choice([word[:i] + word[i + 1 :], word[:i] + draw.choice(letters) + word[i:], word[:i] + draw.choice(letters) + word[i + 1 :]])


def made_words(seed, count, letters="abcdeéßÀ×", longest=9):
    draw = random.Random(seed)
    n = {}
    while len(n) < count:
        w = "".join(draw.choices(letters, k=draw.randrange(5, longest)))
        for _ in range(draw.randrange(1, 6)):
            if len(w) >= 5:
                n[w] = draw.choice([3, 3, 4, 6, 7, 12, 24, 100])
            w = edited(draw, w, letters)
            if len(w) < 5:
                break
    return n


@pytest.fixture(params=[16_384, 40])
def cell(request, monkeypatch):
    """Cells as in production, and cells so small that upper trees, blocks and slices all occur."""
    monkeypatch.setattr(spelling, "CELL", request.param)
    if request.param == 40:
        monkeypatch.setattr(spelling, "SAMPLE", 300)
    return request.param


def test_variants_of_words(spark, cell):
    n = made_words(1, 1_500) | {"a" * 300: 5, "a" * 301: 3, "a" * 150 + "b" + "a" * 149: 9, "q" * 70_000: 3, "q" * 70_001: 8}
    anagrams = random.Random(2)
    n |= {"".join(anagrams.sample("abcdefg", 7)): anagrams.choice([3, 5, 10]) for _ in range(600)}
    frame = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    want = plain_variants(n)
    assert rows_of(spelling.variants(frame)) == want
    assert sum(r[2] for r in want) > 500 and any(r[3] and r[5] != r[3] for r in want)


def test_words_of_documents(spark):
    draw = random.Random(4)
    words = ["".join(draw.choices("abcABCéÉ×", k=draw.randrange(3, 8))) for _ in range(120)]
    texts = [None, "", "1 2 3 _", "a" * 50_000, "Über-über,ÜBER ẞharp Ωmega náive"] + [
        draw.choice([" ", "-", "3", "_"]).join(draw.choices(words, k=draw.randrange(0, 400))) for _ in range(80)
    ]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7]), (None, texts[9])]
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    n = plain_words(docs)
    assert {r.word: r.n for r in spelling.noisy_words(frame).collect()} == n and len(n) > 60
    assert rows_of(spelling.variants(spelling.noisy_words(frame))) == plain_variants(n)


def test_empty_tables(spark):
    assert rows_of(spelling.variants(spelling.noisy_words(spark.createDataFrame([], "doc_id long, text string")))) == []
    assert rows_of(spelling.variants(spark.createDataFrame([], "word string, n long"))) == []


@pytest.mark.parametrize("open_boxes", [True, False])
def test_tree_loses_nothing(open_boxes):
    draw = np.random.default_rng(3)
    points = draw.integers(0, 4, (700, 12)).astype(np.int8)
    tree = spelling.Tree(points, 9, open_boxes)
    asked = draw.integers(0, 4, (50, 12)).astype(np.int8)
    got = {(int(q), int(p)) for query, leaf in tree.leaves(asked, 5) for q, x in zip(query, leaf) for p in tree.order[tree.first[x] : tree.last[x]]}
    close = {(q, p) for q in range(50) for p in range(700) if np.abs(asked[q] - points[p]).sum() <= 5}
    assert close <= got and len(got) < 50 * 700
    home = tree.home(points)
    assert all(p in tree.order[tree.first[x] : tree.last[x]] for p, x in enumerate(home))


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = spelling.query(spark, sf)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert rows_of(got) == plain_variants(plain_words(docs))
