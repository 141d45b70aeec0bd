"""Citing extracted items in their documents, and summing up how well that went."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import citing as C
from ..functions.fuzzy import fuzzy_quote


def cite(items: DataFrame, documents: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Items (item_id, doc_id, kind, text, name) with a ``citation`` struct or null.

    ``kind`` is node, edge or fact. Order of attempts: the quoted text exactly, then with other
    punctuation, then (edges, facts, nodes with a sentence) the most similar window; a node
    without a hit is looked up by its name, whole, then by last or short name. Only rows that
    all built-in attempts leave open go to Python, and only their texts are shipped.
    """
    text, name, source = F.col("text"), F.col("name"), F.col("content")
    quoted = F.nullif(text, F.lit(""))
    joined = items.join(documents.select("doc_id", "content"), "doc_id", "left")
    native = F.coalesce(C.exact_match(quoted, source), C.normalized_match(quoted, source))
    tried = joined.withColumn("_hit", native)
    if fuzzy:  # rows that are settled go to Python as nulls
        open_ = F.col("_hit").isNull() & quoted.isNotNull()
        tried = tried.withColumn("_hit", F.coalesce("_hit", fuzzy_quote(F.when(open_, text), F.when(open_, source))))
    is_node = (F.col("kind") == "node") & (F.coalesce(name, F.lit("")) != "")
    by_name = F.coalesce(
        C.exact_match(name, source), C.normalized_match(name, source), C.partial_entity_match(name, source)
    )
    found = tried.withColumn("_hit", F.coalesce("_hit", F.when(is_node, by_name)))
    hit = F.col("_hit")
    citation = F.when(
        hit.isNotNull(), C.span(source, hit["pos"], hit["len"], hit["confidence"], hit["kind"])
    )
    return found.withColumn("citation", citation).select(*items.columns, "citation")


def occurrences(items: DataFrame, documents: DataFrame, most: int | None = None) -> DataFrame:
    """All occurrences of each item (or the first ``most``), one row each."""
    joined = items.join(documents.select("doc_id", "content"), "doc_id")
    at = joined.withColumn("_at", C.all_occurrences(F.col("text"), F.col("content"), most))
    return at.select(
        *items.columns, F.posexplode("_at").alias("occurrence", "_pos"), "content"
    ).select(
        *items.columns, "occurrence",
        C.span(F.col("content"), F.col("_pos"), F.length("text"), F.lit(1.0), F.lit("exact")).alias("citation"),
    )


def citation_summary(cited: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and mean confidence; unmatched items count in the mean."""
    kind = F.col("citation.match_type")
    return cited.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_citations"),
        F.count_if(kind == "exact").alias("exact_matches"),
        F.count_if(kind != "exact").alias("fuzzy_matches"),
        F.count_if(F.col("citation").isNull()).alias("unmatched"),
        (F.coalesce(F.sum("citation.match_confidence"), F.lit(0.0)) / F.count(F.lit(1))).alias("avg_confidence"),
    )


def merge_summaries(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of several rounds, the mean weighted by totals."""
    total = F.sum("total_citations")
    return summaries.groupBy(*keys).agg(
        total.alias("total_citations"),
        F.sum("exact_matches").alias("exact_matches"),
        F.sum("fuzzy_matches").alias("fuzzy_matches"),
        F.sum("unmatched").alias("unmatched"),
        F.when(total > 0, F.sum(F.col("avg_confidence") * F.col("total_citations")) / total)
        .otherwise(0.0)
        .alias("avg_confidence"),
    )
