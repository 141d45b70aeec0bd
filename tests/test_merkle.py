"""Snapshots with a hash tree: same changes as a full comparison, few buckets read."""

import random

import pytest

from eventloom.session import fresh_dir
from eventloom.sources import merkle

SCHEMA = "node_id string, name string, weight double, attributes map<string,string>"


def _rows(n):
    return [(f"n{i}", f"name {i}", i / 7, {"a": str(i), "b": "x"}) for i in range(n)]


def _snap(spark, rows, depth=None):
    path = fresh_dir(spark, "snapshot")
    merkle.write_snapshot(spark.createDataFrame(rows, SCHEMA), "node_id", path, depth)
    return path


def _changes(spark, a, b):
    return {(r["node_id"], r["change"]) for r in merkle.changes(spark, a, b, "node_id").collect()}


@pytest.fixture(scope="module")
def first(spark):
    return _snap(spark, _rows(3000), 3)


def test_equal_in_any_order(spark, first):
    rows = [(i, n, w, dict(reversed(list(m.items())))) for i, n, w, m in _rows(3000)]
    random.Random(1).shuffle(rows)
    second = _snap(spark, rows, 3)
    assert merkle.root(spark, first) == merkle.root(spark, second)
    assert merkle.differing(spark, first, second)[0].count() == 0
    assert _changes(spark, first, second) == set()


@pytest.mark.parametrize("depth", [2, 3, 4])
def test_changes(spark, first, depth):
    rows = _rows(3000)
    rows[5] = ("n5", None, rows[5][2], rows[5][3])
    rows[6] = ("n6", rows[6][1], rows[6][2], {"a": "6"})
    rows = [r for r in rows if r[0] != "n7"] + [("new", "n", 0.0, None), (None, "null key", 1.0, None), rows[9]]
    second = _snap(spark, rows, depth)
    want = {("n5", "changed"), ("n6", "changed"), ("n7", "removed"), ("new", "added"), (None, "added"), ("n9", "changed")}
    assert _changes(spark, first, second) == want
    assert merkle.differing(spark, first, second)[0].count() <= 6
    back = {"added": "removed", "removed": "added", "changed": "changed"}
    assert _changes(spark, second, first) == {(k, back[c]) for k, c in want}


def test_empty(spark, first):
    none = _snap(spark, [])
    assert merkle.root(spark, none) == (0, 0, 0)
    assert _changes(spark, none, none) == set()
    assert len(_changes(spark, none, first)) == 3000 and {c for _, c in _changes(spark, first, none)} == {"removed"}
