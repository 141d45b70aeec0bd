"""Equivalence sets of entities over many graphs, with their provenance.

A set is known by its key (entity type, lower-case name). The set id is a hash of the key and is
only added to reduced frames, not computed per instance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SET_KEY = ["entity_type", "canonical_name"]
PAIR_KEY = ["src_type", "src_name", "dst_type", "dst_name"]


def set_id(entity_type: Column, name: Column) -> Column:
    """Set id from the set's key, so a second run gives the same sets."""
    key = F.to_json(F.struct(entity_type.alias("t"), name.alias("n")))
    return F.concat(F.lit("equiv_"), F.substring(F.sha2(key, 256), 1, 16))


def instances(nodes: DataFrame) -> DataFrame:
    """Every node under the key of its set: the sets' members, one row each."""
    keep = [c for c in nodes.columns if c not in ("name", "confidence", "node_type")]
    return nodes.select(
        F.coalesce("node_type", F.lit("")).alias("entity_type"),
        F.lower(F.coalesce("name", F.lit(""))).alias("canonical_name"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        *keep,
    )


def equivalence_sets(members: DataFrame) -> DataFrame:
    grouped = members.groupBy(*SET_KEY).agg(
        F.count(F.lit(1)).alias("instance_count"),
        F.sum("confidence").alias("aggregate_weight"),
        F.lit(0.0).alias("cross_source_variance"),
        F.var_pop("confidence").alias("confidence_variance"),
    )
    return grouped.withColumn("set_id", set_id(*[F.col(c) for c in SET_KEY]))


def corroboration(members: DataFrame, domain: str = "domain") -> DataFrame:
    """Instances and distinct source domains per set; a missing domain counts as one."""
    per_domain = members.groupBy(*SET_KEY, domain).agg(F.count(F.lit(1)).alias("n"))
    return per_domain.groupBy(*SET_KEY).agg(
        F.sum("n").alias("corroboration_count"), F.count(F.lit(1)).alias("source_diversity")
    )


def relationship_evidence(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the set keys of both ends, within one graph; loops inside a set are left out.

    Members are placed by (analysis, local id) once, which serves the de-duplication and both
    joins.
    """
    placed = members.select("analysis_id", "local_id", *SET_KEY).repartition("analysis_id", "local_id")
    src = placed.toDF("analysis_id", "source_id", "src_type", "src_name")
    dst = placed.distinct().toDF("analysis_id", "target_id", "dst_type", "dst_name")
    return (
        edges.join(src, ["analysis_id", "source_id"])
        .join(dst, ["analysis_id", "target_id"])
        .where("src_type <> dst_type or src_name <> dst_name")
        .withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    )


def weighted_relationships(evidence: DataFrame) -> DataFrame:
    """Support of each pair of sets. Confidences are summed as decimals: the order of rows decides nothing."""
    found = evidence.groupBy(*PAIR_KEY).agg(
        F.count(F.lit(1)).alias("supporting_instances"),
        F.sum(F.col("confidence").cast("decimal(20,12)")).cast("double").alias("total_weight"),
    )
    return found.withColumns(
        {
            "confidence": F.col("total_weight") / F.col("supporting_instances"),
            "src_set": set_id(F.col("src_type"), F.col("src_name")),
            "dst_set": set_id(F.col("dst_type"), F.col("dst_name")),
        }
    )


def provenance_chain(members: DataFrame, analyses: DataFrame) -> DataFrame:
    """Article and time behind every instance; ``analyses`` is keyed by analysis_id."""
    return members.join(analyses, "analysis_id", "left").select(
        *SET_KEY, "analysis_id", F.col("url").alias("original_article"),
        F.col("title").alias("article_title"), F.col("published").alias("published_date"),
        "analyzed_at", F.col("local_id").alias("kg_node_id"),
        F.col("confidence").alias("confidence_score"),
    )


def entity(members: DataFrame, name: str) -> DataFrame:
    """Sets of one name, whatever its case. The filter reaches the members before grouping."""
    return equivalence_sets(members.where(F.col("canonical_name") == name.lower()))


def relationship(members: DataFrame, edges: DataFrame, first: str, second: str) -> DataFrame:
    """Weighted relationships between two names, in either direction.

    Only members of the two names enter the joins.
    """
    chosen = members.where(F.col("canonical_name").isin(first.lower(), second.lower()))
    found = weighted_relationships(relationship_evidence(chosen, edges))
    return found.where("src_name <> dst_name").select(
        "src_name", "dst_name", "supporting_instances", "total_weight", "confidence"
    )
