"""Weights from keyed state over several micro-batches equal the batch weights."""

import datetime as dt
import re

from pyspark.sql import functions as F

from eventloom.operators import events as ev
from eventloom.streaming import weights as sw

DDL = "actor string, action string, date_raw string, location string, source_name string, source_bias string, seen_at timestamp"


def at(hour):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=hour)


def row(actor, source, bias, hour, day="2025-01-01"):
    return (actor, "signed", day, "Rome", source, bias, at(hour))


LANDINGS = [
    [row("A", "s1", "left", 0), row("A", "s1", "left", 0), row("B", None, None, 0), row("C", "s1", "", 0, None)],
    [row("A", "s2", "right", 1), row("B", "s3", "left", 1), row("B", None, "left", 1)],
    [row("A", "s1", "center", 2), row("D", "s1", "left", 2), row("C", "s1", "left", 2, None)] + [row("A", "s9", "left", 2)] * 50,
]


def weigh(spark, tmp_path, landings, **how):
    """A run for each landing, over one checkpoint."""
    src, out, cursor = (str(tmp_path / n) for n in ("in", "out", "cursor"))
    for rows in landings:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(src)
        sw.stateful_weight_stream(spark.readStream.schema(DDL).parquet(src), out, cursor, **how).awaitTermination()
    return src, out


def rows_of(df):
    columns = ["signature", "source_count", "weight", "source_diversity", "temporal_consistency", "unique_sources"]
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_equals_batch_and_survives_folding(spark, tmp_path):
    src, out = weigh(spark, tmp_path, LANDINGS)
    batch = ev.event_weights(ev.with_signature(spark.read.parquet(src)), ["signature"])
    want = rows_of(batch)
    assert rows_of(sw.current_weights(spark, out)) == want and len(want) == 4
    changes = spark.read.parquet(f"{out}/changes").groupBy("batch").agg(F.count("*").alias("n"))
    assert sorted(r.n for r in changes.collect()) == [2, 3, 3]  # only what a batch touched
    sw.fold_weights(spark, out)
    assert rows_of(sw.current_weights(spark, out)) == want
    src, out = weigh(spark, tmp_path, [[row("B", "s3", "right", 3)]])
    assert rows_of(sw.current_weights(spark, out)) == rows_of(
        ev.event_weights(ev.with_signature(spark.read.parquet(src)), ["signature"])
    )


def test_quiet_events_expire(spark, tmp_path):
    landings = [[row("A", "s1", "left", 0), row("B", "s1", "left", 0)], [row("B", "s2", "left", 30)], [row("A", "s7", "right", 31)]]
    _, out = weigh(spark, tmp_path, landings, expiry_ms=10 * 3_600_000, late="1 minute")
    status = spark.read.parquet(f"{out}/changes").where("status = 'expired'").select("signature", "source_count")
    assert ("a|signed|2025-01-01|rome", 1) in [tuple(r) for r in status.collect()]
    a = sw.current_weights(spark, out).where("signature like 'a|%'").first()
    assert a.source_count == 1 and a.weight == 1.0


def test_nothing_landed(spark, tmp_path):
    assert sw.current_weights(spark, str(tmp_path)).collect() == []


def test_kept_weights_need_no_python(spark):
    stream = spark.readStream.schema(DDL).parquet("/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert not re.search("Pandas|Python", plan(sw.changed_weights(stream)))
    assert "Pandas" in plan(sw.changed_weights(stream, 1000))
