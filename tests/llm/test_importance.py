"""Importance resampling against a plain reading of its definition; edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from eventloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text):
    words = WORD.findall((text or "").translate(LOWER))
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + pairs]


def plain(docs, target):
    """(doc_id, n_features, weight, score, rank) by the definition."""
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_features(text)[1])
    for text in target:
        t.update(plain_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)}
    rows = []
    for doc_id, text in docs:
        n, buckets = plain_features(text)
        weight = sum(gain[b] for b in buckets) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(buckets), weight, score, None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for at, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = at
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def made(n=300):
    draw = random.Random(9)
    words = ["".join(draw.choices("abcdeéß9", k=draw.randrange(1, 7))) for _ in range(400)]
    gaps = [" ", " ", " ", ", ", "\n", "-", ". ", " ", "_", "/"]
    return ["".join(draw.choice(words).upper() + draw.choice(gaps) if i % 9 == 0 else draw.choice(words) + draw.choice(gaps)
                    for i in range(draw.choice([0, 1, 5, 19, 20, 21, 60, 300]))) for _ in range(n)]


EDGES = [None, "", " .,-\t\n", "one", "one two", "A B", "\u0085x y 的人 \U0001f600q", "a" * 100_000, "x " * 50_000, "É é ÀB", "\x7f\x00z"]


@pytest.fixture(scope="module")
def frames(spark):
    texts = made() + EDGES
    docs = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (4, texts[4]), (None, texts[7]), (None, None), (5, texts[6])]
    target = made(40)[5:] + [None, "", "one two one two"]
    return docs, target


def test_equals_definition(spark, frames):
    docs, target = frames
    left = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, rank string, n_words int").repartition(3)
    right = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.drawn(importance.scored(left, right)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(docs, target)
    chosen = importance.resample(left, right)
    assert chosen.columns == left.columns
    ids = {r[0] for r in plain(docs, target) if r[4] is not None}
    assert sorted((r.doc_id for r in chosen.collect()), key=repr) == sorted((d for d, _ in docs if d in ids), key=repr)


def test_empty_tables(spark, frames):
    docs, target = frames
    right = spark.createDataFrame([(t,) for t in target], "text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.drawn(importance.scored(none, right)).collect() == []
    left = spark.createDataFrame(docs[:50], "doc_id long, text string")
    got = importance.drawn(importance.scored(left, right.limit(0))).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs[:50], [])


def test_forgetting_changes_nothing(monkeypatch):
    texts = [t or "" for t in made(30)]
    want = [plain_features(t) for t in texts]
    monkeypatch.setattr(importance, "MEMO", 3)
    words = importance.Words()
    for t, (n, buckets) in zip(texts, want):
        counts, found = words.features([t])
        assert counts.tolist() == [n] and sorted(found[0].tolist()) == sorted(buckets)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = importance.query(spark, sf)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, target)
