"""Exact nearest-neighbour search over an embedding column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import node_text


def squared_distance(embedding: Column, query: Column | Sequence[float]) -> Column:
    """Squared L2 distance in double precision.

    For a constant query the sum is written out per dimension, as a balanced tree, so that wide
    vectors stay shallow; for a column it folds over the zipped arrays.
    """
    if isinstance(query, Column):
        return F.aggregate(
            F.zip_with(
                embedding, query,
                lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")),
            ),
            F.lit(0.0),
            lambda acc, x: acc + x,
        )
    terms = []
    for i, q in enumerate(query):
        gap = F.get(embedding, F.lit(i)).cast("double") - F.lit(float(q))
        terms.append(gap * gap)
    while len(terms) > 1:
        terms = [sum(terms[i + 1 : i + 2], terms[i]) for i in range(0, len(terms), 2)]
    return terms[0]


def search(
    vectors: DataFrame, query: Column | Sequence[float], limit: int = 10, item_type: str | None = None
) -> DataFrame:
    """Nearest items (of one type, if given) with score 1 / (1 + squared distance); ties by item id.

    Items without a vector, or with one of another length than the query, are no hits. Each task
    keeps its own best rows; only those are merged.
    """
    keep = [c for c in vectors.columns if c != "embedding"]
    size = F.size(query) if isinstance(query, Column) else F.lit(len(query))
    rows = vectors.where(F.size("embedding") == size)
    if item_type is not None:
        rows = rows.where(F.col("item_type") == item_type)
    ranked = rows.select(*keep, squared_distance(F.col("embedding"), query).alias("distance"))
    top = ranked.where("distance is not null").orderBy("distance", "item_id").limit(limit)
    return top.withColumn("score", 1.0 / (1.0 + F.col("distance")))


def similar_to_item(vectors: DataFrame, item_id, limit: int = 10) -> DataFrame:
    """Neighbours of a stored item, itself left out; none of an unknown one. Its vector enters as a
    scalar subquery."""
    query = vectors.where(F.col("item_id") == item_id).select("embedding").scalar()
    found = search(vectors.withColumn("_query", query), F.col("_query"), limit + 1).drop("_query")
    return found.where(F.col("item_id") != item_id).orderBy("distance", "item_id").limit(limit)


def unindexed_nodes(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes without a vector, rendered to text for embedding."""
    fresh = nodes.join(vectors.select(F.col("item_id").alias("node_id")), "node_id", "left_anti")
    sentence = F.col("source_sentence") if "source_sentence" in nodes.columns else F.lit(None).cast("string")
    return fresh.select(
        F.col("node_id").alias("item_id"),
        F.lit("node").alias("item_type"),
        node_text(F.col("type"), F.col("name"), F.col("attributes"), sentence).alias("text"),
        F.create_map(F.lit("node_type"), "type", F.lit("name"), "name").alias("metadata"),
    )


def embed(items: DataFrame, embedding) -> DataFrame:
    """Add the vector of a user-supplied pandas UDF (text to array<float>)."""
    return items.select(
        "*", embedding(F.col("text")).cast("array<float>").alias("embedding"),
        F.current_timestamp().alias("added_at"),
    )


def vector_statistics(vectors: DataFrame) -> DataFrame:
    """Items per type, with the vector dimension."""
    return vectors.groupBy(F.coalesce("item_type", F.lit("unknown")).alias("item_type")).agg(
        F.count(F.lit(1)).alias("items"), F.max(F.size("embedding")).cast("bigint").alias("dimension")
    )
