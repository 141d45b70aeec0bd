"""The stored metric index gives what a full scan gives, and reads less."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators.vectors import search, similar_to_item
from eventloom.session import fresh_dir
from eventloom.sources.vector_index import LOOSE, VectorIndex

SCHEMA = "item_id long, item_type string, embedding array<float>"


@pytest.fixture(scope="module")
def clustered(spark):
    draw = np.random.default_rng(4)
    centres = draw.standard_normal((40, 8)) * 6
    x = (centres[draw.integers(0, 40, 4000)] + 0.3 * draw.standard_normal((4000, 8))).astype(np.float32)
    x[100:140] = x[100]  # ties
    rows = [(i, f"t{i % 3}", [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(5000, "t0", None), (5001, "t0", []), (5002, "t0", [float("nan")] * 8), (5003, None, rows[0][2]), (5004, "t1", [1.0, 2.0]),
           (5005, "t0", [None, *rows[0][2][1:]]), (5006, "t0", [float("inf")] * 8)]
    vectors = spark.createDataFrame(rows + odd, SCHEMA)
    index = VectorIndex.create(vectors.where("item_id < 2000"), fresh_dir(spark, "index"), pivots=32)
    index.add(vectors.where("item_id >= 2000"))
    return vectors, index, x


def _rows(df):
    return [(r["item_id"], r["distance"]) for r in df.orderBy("distance", "item_id").collect()]


@pytest.mark.parametrize("item_type", [None, "t1", "absent"])
def test_equals_scan(clustered, item_type):
    vectors, index, x = clustered
    far = [50.0] * 8
    for q in ([float(c) for c in x[7]], [float(c) for c in x[100]], [0.0] * 8, far, [1.0, 2.5], [1.0] * 5):
        for limit in (1, 10):
            assert _rows(index.search(q, limit, item_type)) == _rows(search(vectors, q, limit, item_type))


def test_limit_beyond_the_table(clustered):
    vectors, index, x = clustered
    q = [float(c) for c in x[3]]
    got, want = index.search(q, 10_000).collect(), search(vectors, q, 10_000).collect()
    assert {r["item_id"] for r in got} == {r["item_id"] for r in want}


def test_similar_item(clustered):
    vectors, index, _ = clustered
    for item in (7, 120, 5003):
        assert _rows(index.similar_to_item(item, 5)) == _rows(similar_to_item(vectors, item, 5))
    assert index.similar_to_item(99_999, 5).count() == 0 and index.similar_to_item(5000, 5).count() == 0


def test_cells_are_skipped(clustered):
    _, index, x = clustered
    rows = index.candidates([float(c) for c in x[7]], 10)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "GreaterThanOrEqual(to_pivot" in plan
    read = {r["cell"] for r in rows.select("cell").distinct().collect()} - {LOOSE}
    assert 0 < len(read) <= 3
    assert rows.count() < 400  # of 4,007


def test_empty(spark):
    index = VectorIndex.create(spark.createDataFrame([], SCHEMA), fresh_dir(spark, "index"))
    index.add(spark.createDataFrame([(1, "a", [1.0, 0.0])], SCHEMA))
    assert _rows(index.search([1.0, 0.0], 3)) == [(1, 0.0)]
    assert index.cells().select(F.sum("items")).first()[0] == 1
