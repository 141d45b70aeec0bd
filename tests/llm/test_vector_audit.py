"""Vector links that the search used to miss or to miscount."""

import numpy as np
import pandas as pd

from eventloom.llm import hnsw
from eventloom.session import cut


class Narrow:
    """Finds a query itself and a large group at any beam, pairs only from ``needs`` on."""

    def __init__(self, x, needs, group):
        self.x, self.needs, self.group = x, needs, group

    def within(self, q, limit, beam):
        hits = [np.flatnonzero(row) for row in q @ self.x.T >= limit]
        return [h if len(h) > 2 or beam >= self.needs else h[:0] for h in hits]


def pairs_and_group():
    draw = np.random.default_rng(1)
    lone = draw.standard_normal((2000, 24))
    pairs = np.repeat(draw.standard_normal((60, 24)), 2, 0) + 0.01 * draw.standard_normal((120, 24))
    group = draw.standard_normal((1, 24)) + 0.01 * draw.standard_normal((900, 24))
    return hnsw.unit(np.concatenate([lone, pairs, group]))


def test_audit_sees_pairs_beside_a_large_group():
    x = pairs_and_group()
    for needs in (64, 10**9):
        found = [h for _, some in hnsw.search(Narrow(x.astype(np.float32), needs, 900), x, x, np.arange(len(x))) for h in some]
        assert [len(h) for h in found[2000:2120]] == [1] * 120
        assert all(i not in h for i, h in enumerate(found))


def test_audit_draws_until_partners_are_met():
    x = pairs_and_group()[:2120]
    found = [h for _, some in hnsw.search(Narrow(x.astype(np.float32), 10**9, 0), x, x, np.arange(len(x))) for h in some]
    assert sum(map(len, found)) == 120


def test_self_hits_are_no_links():
    rows = pd.DataFrame(
        {"vec": ["aa", "bb", "cc"], "rep": [1, 2, 3], "copies": [5000, 2, 1], "embedding": [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]]}
    )
    rows["embedding"] = rows["embedding"].map(np.array)
    got = hnsw._answer((0, 0), rows[["vec", "rep", "embedding"]], hnsw._index((0,), rows))
    assert {r.vec: r.links for r in got.itertuples() if r.vec is not None} == {"aa": 2, "bb": 5000}


def test_an_index_is_a_file_that_workers_map(tmp_path):
    x = pairs_and_group()[2000:2200]
    rows = pd.DataFrame({"vec": [f"{i:04d}" for i in range(len(x))], "rep": range(len(x)), "copies": 1, "embedding": list(x)})
    made = hnsw._index((7,), rows)
    filed = hnsw._filed(made, f"file://{tmp_path}/shards")
    assert list(filed.columns) == ["shard", "name", "listed"] and filed["shard"].tolist() == [7]
    raw = hnsw._raw(f"file://{tmp_path}/shards/{filed['name'].iloc[0]}")
    assert isinstance(raw, np.memmap)
    asked = pd.DataFrame({**rows[["vec", "rep", "embedding"]], "vec": [*rows["vec"][:-1], "none"]})
    held = hnsw._answer((7, 0), asked, made)
    pd.testing.assert_frame_equal(hnsw._answers(asked, hnsw._unpacked(raw, filed["listed"].iloc[0])), held)
    assert held["links"].notna().sum() == len(x)


def test_links_of_a_large_group_are_taken_in_parts(monkeypatch):
    monkeypatch.setattr(hnsw, "LINKS", 1000)
    x = pairs_and_group()[2100:]
    graph = hnsw.Graph(x.astype(np.float32))
    parts = list(hnsw.search(graph, x, x, np.arange(len(x)), 32))
    assert max(sum(map(len, found)) for _, found in parts) < 1000 + len(x)
    assert [at for at, _ in parts] == np.cumsum([0, *[len(found) for _, found in parts[:-1]]]).tolist()
    assert sum(len(found) for _, found in parts) == len(x)
    assert np.median([len(h) for _, found in parts for h in found]) > 880


def test_no_index_goes_through_rows(spark, monkeypatch):
    """Executors failed by memory when an index of 50,000 vectors was a row for each block of queries."""
    seen = []
    monkeypatch.setattr(hnsw, "cut", lambda df: seen.append([t for _, t in df.dtypes]) or cut(df))
    x = np.round(np.random.default_rng(3).standard_normal((300, 8)), 6)
    x[1] = x[0] * 1.0001
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(df).collect()}
    assert got[0] == got[1] == (1, 0) and sum(n for n, _ in got.values()) == 2
    assert seen and not any("binary" in types for types in seen)
