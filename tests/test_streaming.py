import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventloom.catalog import QUERIES
from eventloom.operators import events as ev
from eventloom.operators import ingest as ing
from eventloom.streaming import jobs


def land(spark, rows, ddl, folder):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)


def read(spark, folder, ddl):
    return spark.readStream.schema(ddl).parquet(folder)


def run_twice(spark, tmp_path, ddl, first, second, job):
    """Two landings, two runs over one checkpoint."""
    src, out, cursor = (str(tmp_path / n) for n in ("in", "out", "cursor"))
    for rows in (first, second):
        land(spark, rows, ddl, src)
        job(read(spark, src, ddl), out, cursor).awaitTermination()
    return src, out


def test_url_copies_within_overlap(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1, 10)
    ddl = "url string, collected_at timestamp"
    first = [("a", t0), ("a", t0 + dt.timedelta(minutes=5)), ("b", t0)]
    second = [("b", t0 + dt.timedelta(minutes=30)), ("c", t0 + dt.timedelta(minutes=40))]
    _, out = run_twice(spark, tmp_path, ddl, first, second, jobs.collect_stream)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_store_once(spark, tmp_path):
    ddl = "doc_id string, content string"
    _, out = run_twice(spark, tmp_path, ddl, [("1", "x"), ("1", "y"), ("2", "x")], [("2", "z"), ("3", "x")], jobs.store_stream)
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]


def test_history_equals_batch(spark, tmp_path):
    day = lambda d: dt.datetime(2025, 1, d, 7)
    ddl = "published timestamp"
    src, out = run_twice(spark, tmp_path, ddl, [(day(1),), (day(2),), (None,)], [(day(2),), (day(3),)], jobs.history_stream)
    got = {r.day: r.n for r in jobs.read_history(spark, out).collect()}
    assert got == {r.day: r.n for r in ing.daily_history(spark.read.schema(ddl).parquet(src)).collect()}
    assert got[dt.date(2025, 1, 2)] == 2


def test_weights_equal_batch(spark, tmp_path):
    ddl = "actor string, action string, date_raw string, location string, source_name string, source_bias string"
    a = ("Bob", "arrested", "2025-01-01", "NY")
    first = [(*a, "S", "left"), (*a, "T", "right"), ("Eve", "fired", "2025-01-01", "LA", "S", None)]
    second = [(*a, "S", "left"), ("bob", "detained", "January 1, 2025", "ny", "U", "center")]
    src, out = run_twice(spark, tmp_path, ddl, first, second, jobs.weight_stream)
    batch = ev.event_weights(ev.with_signature(spark.read.schema(ddl).parquet(src)), ["signature"])
    row = lambda r: (r.signature, r.source_count, round(r.weight, 9), r.temporal_consistency, r.unique_sources)
    assert sorted(map(row, jobs.read_weights(spark, out).collect())) == sorted(map(row, batch.collect()))


def test_vector_sync_only_new_nodes(spark, tmp_path):
    @F.pandas_udf("array<float>")
    def embedding(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [float(len(s))])

    ddl = "node_id string, type string, name string, attributes map<string,string>"
    first, second = [("n1", "a", "x", {}), ("n1", "a", "x", {})], [("n1", "a", "x", {}), ("n2", "a", "longer", {"k": "v"})]
    _, out = run_twice(spark, tmp_path, ddl, first, second, lambda s, o, c: jobs.vector_stream(s, o, c, embedding))
    got = {r.item_id: r.embedding for r in spark.read.parquet(out).collect()}
    assert got == {"n1": [len("Type: a Name: x")], "n2": [len("Type: a Name: longer k: v")]}


@pytest.mark.parametrize("name, table", [
    ("stream_daily_history", "documents"), ("stream_fresh_articles", "pages"), ("stream_store", "documents")
])
def test_tables_of_several_files(spark, sf, tmp_path, name, table):
    rows = spark.read.parquet(f"{sf}/{table}.parquet")
    rows.repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    one, several = ([tuple(r) for r in QUERIES[name](spark, d).collect()] for d in (sf, str(tmp_path)))
    assert several and sorted(several) == sorted(one)
