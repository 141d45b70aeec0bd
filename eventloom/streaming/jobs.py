"""Incremental forms of collecting, storing, counting, weighing and vector sync.

Sinks write one folder per micro-batch, so a batch that is run again replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import events as ev
from ..operators.vectors import embed, unindexed_nodes
from ..sources.sinks import append_new, table_or_none

OVERLAP = "1 hour"


def table_stream(spark: SparkSession, base: str, name: str) -> DataFrame:
    """New files of one Parquet table of a folder, with the stored schema. The table is a file or a folder
    of files; as a pattern its path stands for either, while a plain path would have to be a folder."""
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{base}/{name}.parque[t]")


def fresh_articles(articles: DataFrame, overlap: str = OVERLAP) -> DataFrame:
    """Articles without copies of a URL seen within the overlap of two runs."""
    return articles.withWatermark("collected_at", overlap).dropDuplicatesWithinWatermark(["url"])


def daily_counts(articles: DataFrame) -> DataFrame:
    """Articles per published day; state is one row per calendar day."""
    day = F.window("published", "1 day")
    return articles.where("published is not null").groupBy(day).agg(F.count(F.lit(1)).alias("n")).select(
        F.to_date("window.start").alias("day"), "n"
    )


def start(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Run all data there is now and stop; the checkpoint is the cursor of the next run."""
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def to_batches(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def collect_stream(articles: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return start(fresh_articles(articles), to_batches(path), checkpoint)


def store_stream(documents: DataFrame, path: str, checkpoint: str, key: str = "doc_id") -> StreamingQuery:
    """Store documents whose id is new."""
    return start(documents, lambda batch, _id: append_new(batch, path, key), checkpoint)


def history_stream(articles: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running daily counts; every batch writes the days it changed."""
    return start(daily_counts(articles), to_batches(path), checkpoint, "update")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Latest count per day."""
    return spark.read.parquet(path).groupBy("day").agg(F.max_by("n", "batch").alias("n"))


def weight_stream(observations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Per batch, the additive partials behind the event weights. There is no growing state: the
    event id is a function of the signature, and partials of all batches add up on reading."""

    def write(batch: DataFrame, batch_id: int) -> None:
        signed = ev.with_signature(batch)
        ev.observation_partials(signed, ["signature"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return start(observations, write, checkpoint)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return ev.weights_from_partials(spark.read.parquet(path), ["signature"])


def vector_stream(nodes: DataFrame, path: str, checkpoint: str, embedding) -> StreamingQuery:
    """Embed and append nodes that have no vector yet."""

    def write(batch: DataFrame, _id: int) -> None:
        known = table_or_none(batch.sparkSession, path)
        if known is None:
            known = batch.sparkSession.createDataFrame([], "item_id string")
        fresh = unindexed_nodes(batch.dropDuplicates(["node_id"]), known)
        embed(fresh, embedding).write.mode("append").parquet(path)

    return start(nodes, write, checkpoint)
