"""Event weights as a stateful stream: each micro-batch emits the weights that it changed.

Keyed state holds, for each signature, the number of observations and the distinct biases, sources and
dates seen; what a micro-batch costs is its own signatures, not the history. State lives in the RocksDB
store and is checkpointed to the query's checkpoint folder. It is the state of a streaming aggregate, which
combines inside the scan's tasks first, so a signature with a third of a batch sends few rows to its task.

With ``expiry`` a signature that has had no observation for so long in event time leaves the state, and
a last row with status ``expired`` says so; an observation that comes later founds the event anew. That
takes timers, so there a processor in Python keeps the state: a call for each signature of a micro-batch.
Its observations are counted per (signature, bias, source, date) inside the scan's tasks; in the
processor they pass as an iterator of batches. A checkpoint goes on in the form that began it.

The sink keeps changes by micro-batch. ``current_weights`` takes the last row of each signature;
``fold_weights`` writes these as a base, from which later reads start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import events as ev
from ..sources.sinks import table_or_none
from .jobs import start, to_batches

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
COUNTED = "signature string, source_bias string, source_name string, date_raw string, n long"
STATE = "n long, biases array<string>, sources array<string>, dates array<string>, unnamed boolean, undated boolean, last_ms long"
CHANGED = "signature string, source_count long, biases long, named long, dates long, unnamed long, undated long, status string"


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Observations of an Arrow batch as counts; a stateless step that combines before the shuffle."""
    for rows in batches:
        keys = [c for c in rows.columns if c not in ("n", "seen_at")]
        yield rows.groupby(keys, dropna=False, as_index=False).agg(n=("n", "sum"), seen_at=("seen_at", "max"))[list(rows.columns)]


class Weigher(StatefulProcessor):
    """State and output of one signature."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", STATE)

    def _row(self, key, state, status: str) -> pd.DataFrame:
        n, biases, sources, dates, unnamed, undated, _ = state
        row = (key[0], n, len(biases), len(sources), len(dates), int(unnamed), int(undated), status)
        return pd.DataFrame([row], columns=[c.split(" ")[0] for c in CHANGED.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.seen.get() if self.seen.exists() else (0, [], [], [], False, False, 0)
        n, unnamed, undated, last = old[0], old[4], old[5], old[6]
        biases, sources, dates = (set(x) for x in old[1:4])
        for part in rows:
            n += int(part["n"].sum())
            biases.update(b for b in part["source_bias"].dropna() if b != "")
            sources.update(part["source_name"].dropna())
            dates.update(part["date_raw"].dropna())
            unnamed = unnamed or bool(part["source_name"].isna().any())
            undated = undated or bool(part["date_raw"].isna().any())
            last = max(last, int(part["seen_at"].max().timestamp() * 1000))
        state = (n, sorted(biases), sorted(sources), sorted(dates), unnamed, undated, last)
        self.seen.update(state)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(last + self.expiry_ms)
        yield self._row(key, state, "active")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.seen.get()
        self.seen.clear()
        yield self._row(key, state, "expired")

    def close(self) -> None:
        pass


def changed_weights(observations: DataFrame, expiry_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """Streaming observations (parts, source_name, source_bias, date_raw; with an expiry also ``seen_at``)
    to rows of changed signatures."""
    times = [] if expiry_ms is None else ["seen_at"]
    signed = ev.with_signature(observations).select(
        "signature", "source_bias", "source_name", "date_raw", F.lit(1).cast("long").alias("n"), *times
    )
    if expiry_ms is None:
        return _aggregated(signed)
    counted = signed.mapInPandas(_counted, f"{COUNTED}, seen_at timestamp").withWatermark("seen_at", late)
    return counted.groupBy("signature").transformWithStateInPandas(Weigher(expiry_ms), CHANGED, "Update", "EventTime")


def _aggregated(signed: DataFrame) -> DataFrame:
    """Rows of changed signatures whose state never expires; the sets leave out nulls."""
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")
    missing = lambda c: F.max(F.col(c).isNull().cast("long"))
    return signed.groupBy("signature").agg(
        F.sum("n").alias("source_count"),
        distinct(F.nullif(F.col("source_bias"), F.lit(""))).alias("biases"),
        distinct("source_name").alias("named"),
        distinct("date_raw").alias("dates"),
        missing("source_name").alias("unnamed"),
        missing("date_raw").alias("undated"),
    ).withColumn("status", F.lit("active"))


def stateful_weight_stream(
    observations: DataFrame, path: str, checkpoint: str, expiry_ms: int | None = None, late: str = "1 hour"
) -> StreamingQuery:
    """Write the signatures that each micro-batch changed."""
    conf = observations.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return start(changed_weights(observations, expiry_ms, late), to_batches(f"{path}/changes"), checkpoint, "update")
    finally:
        conf.set(PROVIDER, before)


def _last(spark: SparkSession, path: str) -> DataFrame | None:
    """Last row of each signature: of the newest base and the changes after it."""
    changes, bases = table_or_none(spark, f"{path}/changes"), table_or_none(spark, f"{path}/bases")
    if bases is not None:
        newest = bases.agg(F.max("base")).first()[0]
        after = bases.where(F.col("base") == newest).drop("base")
        changes = after if changes is None else after.unionByName(changes.where(F.col("batch") > newest))
    if changes is None:
        return None
    fields = [c for c in changes.columns if c not in ("signature", "batch")]
    last = changes.groupBy("signature").agg(F.max_by(F.struct(*fields), "batch").alias("last"), F.max("batch").alias("batch"))
    return last.select("signature", "last.*", "batch")


def fold_weights(spark: SparkSession, path: str) -> None:
    """Write the current rows as a base; a base is complete or not there, so changes stay valid beside it."""
    last = _last(spark, path)
    newest = None if last is None else last.agg(F.max("batch")).first()[0]
    if newest is not None:
        last.write.mode("overwrite").parquet(f"{path}/bases/base={newest}")


def current_weights(spark: SparkSession, path: str) -> DataFrame:
    """Weight fields of every signature in the state, as :func:`events.event_weights` gives them."""
    last = _last(spark, path)
    if last is None:
        last = spark.createDataFrame([], f"{CHANGED}, batch int")
    return ev.weights_from_counts(last.where("status = 'active'"), ["signature"])
