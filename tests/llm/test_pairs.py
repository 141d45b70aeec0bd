"""SimHash, decontamination, vector links and components against brute force on small fixtures."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, hnsw, simhash
from eventloom.llm.common import components


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(3, 3), (9, 5), (5, 7), (-4, 9)]])
def test_components(spark, links):
    frame = spark.createDataFrame(links, "a long, b long") if links else spark.createDataFrame([], "a long, b long")
    got = {r.node: r.root for r in components(frame).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == smallest_reachable({n for x in real for n in x}, real)


def plain_simhash(text):
    words = []
    for w in (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split():
        words.append(w)
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts_with_copies(draw, n=120):
    words = ["".join(draw.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = [" ".join(draw.choices(words, k=draw.choice([0, 1, 2, 3, 40, 200]))) for _ in range(n)]
    for _ in range(n):
        t = draw.choice(texts).split(" ")
        t[draw.randrange(len(t))] = draw.choice(words)
        texts.append(" ".join(t))
    return texts + [None, "", " \t\n\v\f\r", "É é", "A B c"]


@pytest.fixture(scope="module")
def copies(spark):
    draw = random.Random(11)
    texts = texts_with_copies(draw)
    rows = [(i, t, "f", "c") for i, t in enumerate(texts)] + [(3, texts[3], "f", "c"), (None, texts[5], "f", "c"), (4, "another text", "f", "c")]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id string")


def test_simhash(copies):
    rows = [(r.doc_id, plain_simhash(r.text)) for r in copies.collect()]
    prints = sorted({p for _, p in rows})
    links = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 2]
    root = smallest_reachable(prints, links)
    first = {}
    for d, p in rows:
        if d is not None:
            first[root[p]] = min(d, first.get(root[p], d))
    want = sorted(((d, f"{p:016x}", first.get(root[p])) for d, p in rows), key=str)
    got = simhash.near_duplicates(copies).collect()
    assert sorted((tuple(r) for r in got), key=str) == want and links


def test_deduplicate(copies):
    kept = simhash.deduplicate(copies)
    assert kept.columns == copies.columns
    rows = [(r.doc_id, plain_simhash(r.text)) for r in copies.collect()]
    prints = sorted({p for _, p in rows})
    root = smallest_reachable(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    first = {root[p]: min(d for d, q in rows if d is not None and root[q] == root[p]) for _, p in rows}
    assert sorted((root[plain_simhash(r.text)], r.doc_id) for r in kept.collect()) == sorted(first.items())
    assert simhash.deduplicate(copies.limit(0)).count() == 0
    assert simhash.near_duplicates(copies.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 1000])
def test_trie_links(spark, block, monkeypatch):
    """Dense and sparse fingerprints, also with sub-tries cut into blocks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    draw = random.Random(2)
    prints = {draw.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for p in list(prints)[:20]:
        for _ in range(8):
            prints.add(p ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(1, 5))))
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    links = simhash.linked(spark.createDataFrame([(s,) for s in signed.values()], "print long")).collect()
    listed = sorted(prints)
    want = [(signed[a], signed[b]) for i, a in enumerate(listed) for b in listed[i + 1 :] if (a ^ b).bit_count() <= 2]
    nodes = set(signed.values())
    assert smallest_reachable(nodes, [tuple(x) for x in links]) == smallest_reachable(nodes, want)


def test_trie_pairs_equal_all_pairs():
    draw = np.random.default_rng(4)
    prints = np.unique(draw.integers(0, 1 << 12, 900, dtype=np.uint64))  # agree above bit 12
    a, b = simhash.trie_pairs(np.zeros(len(prints), np.int64), prints, 52, 2)
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(close, 1)))}
    assert {(min(x, y), max(x, y)) for x, y in zip(a, b)} == want and len(a) == len(want)


def tokens(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            word += c
        else:
            out, word = out + [word] * bool(word), ""
    return out


def overlap(doc, item):
    """Best aligned share over all shifts."""
    d, m, best = tokens(doc), tokens(item), 0.0
    width = min(len(m), decontaminate.WINDOW)
    for shift in range(-len(m), len(d) + 1):
        same = [0 <= j + shift < len(d) and d[j + shift] == w for j, w in enumerate(m)]
        for at in range(len(m) - width + 1):
            best = max(best, sum(same[at : at + width]) / width)
    return best


@pytest.fixture(scope="module")
def leaks(spark):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdefghijk", k=5)) for _ in range(2000)]
    items = [" ".join(draw.choices(words, k=k)) for k in (15, 20, 30, 60, 4, 3, 13)] + ["", None]
    docs = [" ".join(draw.choices(words, k=120)) for _ in range(40)]
    for i, item in enumerate(items[:5]):
        for share in (0.0, 0.1, 0.15):  # substituted words
            passage = [w if draw.random() >= share else "other" for w in item.split()]
            before = " ".join(draw.choices(words, k=draw.randrange(0, 30)))
            docs.append(f"{before} {', '.join(passage).upper()}. {draw.choice(words)}")
    docs += [items[5], items[0][: len(items[0]) // 2], "", None, docs[0]]
    frame = [(i, t, 1, "x") for i, t in enumerate(docs)] + [(7, docs[41], 1, "x"), (None, items[2], 1, "x")]
    return (
        spark.createDataFrame(frame, "doc_id long, text string, item_id int, words string"),
        spark.createDataFrame(list(enumerate(items)) + [(0, items[0])], "item_id long, text string"),
    )


def test_overlaps(leaks):
    docs, items = leaks
    found = {(r.doc_id, r.item_id): r.overlap for r in decontaminate.overlaps(docs, items).collect()}
    want, texts = {}, {r.item_id: r.text for r in items.collect()}
    for r in docs.collect():
        for i, item in texts.items():
            short = len(tokens(item)) < decontaminate.NARROWEST  # short items are compared whole
            share = float(tokens(r.text) == tokens(item)) if short and tokens(item) else overlap(r.text, item) if tokens(item) else 0
            if share >= decontaminate.SHARE:
                want[(r.doc_id, i)] = max(share, want.get((r.doc_id, i), 0))
    assert found == pytest.approx(want) and len(want) > 12


def test_decontaminate(leaks, monkeypatch):
    docs, items = leaks
    bad = {(r.doc_id) for r in decontaminate.overlaps(docs, items).collect()}
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == {r.doc_id for r in docs.collect()} - bad | {7}  # one row of id 7 is clean
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, items).collect()) == sorted(ids)
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == docs.count()


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((600, 24))
    near = np.repeat(x[:5], 60, axis=0) + 0.06 * draw.standard_normal((300, 24))
    line = x[7] + np.outer(np.linspace(0, 3, 40), x[8])
    rows = [(i, v.tolist(), "r") for i, v in enumerate(np.concatenate([x, near, line]).astype(np.float32))]
    rows += [(2000 + i, rows[3][1], "r") for i in range(200)] + [(3000, [2 * c for c in rows[3][1]], "r")]
    rows += [(4000, None, "r"), (4001, [0.0] * 24, "r"), (4002, [float("nan")] * 24, "r"), (4003, [1.0] * 23 + [None], "r"), (4004, [], "r"), (4005, [1.0, 2.0], "r"), (4006, [2.0, 4.0], "r"), (4007, [float("inf")] * 24, "r"), (None, rows[3][1], "r")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string")


def test_vector_links(vectors):
    rows = [r for r in vectors.collect() if r.vec_id is not None]
    usable = [r for r in rows if r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    links, degree = [], {r.vec_id: 0 for r in rows}
    for size in {len(r.embedding) for r in usable}:
        of = [r for r in usable if len(r.embedding) == size]
        u = hnsw.unit(np.array([r.embedding for r in of]))
        close = u @ u.T >= hnsw.THRESHOLD
        for i, j in zip(*np.nonzero(close)):
            if i != j:
                links.append((of[i].vec_id, of[j].vec_id))
                degree[of[i].vec_id] += 1
    root = smallest_reachable(degree, links)
    got = {r.vec_id: r for r in hnsw.near_duplicates(vectors).collect()}
    none = got.pop(None)
    assert tuple(none) == (None, 0, None, False)
    found = sum(r.n_links for r in got.values())
    assert found <= len(links) and found >= 0.98 * len(links)
    assert all(r.n_links <= degree[i] for i, r in got.items())
    assert {i: r.component_id for i, r in got.items()} == root
    assert all(r.kept == (i == root[i]) for i, r in got.items())


def test_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.01]), (3, [1.0, 0.01]), (4, [-1.0, 0.0]), (2, [0.0, 1.01])]
    got = hnsw.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted([(1, 1, True), (2, 1, True), (2, 1, False), (1, 1, False), (0, 4, True), (2, 1, False)])
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_recall():
    draw = np.random.default_rng(0)
    x = hnsw.unit(np.concatenate([draw.standard_normal((1500, 16)), np.repeat(draw.standard_normal((1, 16)), 500, 0) + 0.05 * draw.standard_normal((500, 16))]))
    found = [h for _, hits in hnsw.search(hnsw.Graph(x.astype(np.float32)), x, x) for h in hits]
    truth = x @ x.T >= hnsw.THRESHOLD
    assert sum(map(len, found)) >= 0.98 * truth.sum()
    assert all(truth[i, h].all() for i, h in enumerate(found))


def test_fingerprint_column(spark):
    frame = spark.createDataFrame([("a b c d",), (None,)], "text string")
    got = [r[0] for r in frame.select(simhash.hexed(simhash.fingerprints(frame))).collect()]
    assert got == [f"{plain_simhash('a b c d'):016x}", "0" * 16]
    assert frame.select(F.lit(1)).count() == 2
