"""Building and extending the knowledge graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import graph as g
from ..operators.ordered import ranks
from ..session import cut
from ..sources.files import payload_from_answers, read_analyses
from ..sources.sinks import graph_metadata, save_snapshot, write_graph
from .aggregation import EventAggregation, numbered_edges, numbered_nodes


@dataclass
class KnowledgeGraph:
    nodes: DataFrame
    edges: DataFrame
    further_sources: DataFrame
    further_evidence: DataFrame


def outlet_nodes(analyses: DataFrame) -> DataFrame:
    """One media-outlet node per analysed article, placed before the article's own nodes."""
    a = F.col("article")
    return analyses.select(
        "analysis_id", F.coalesce("article.document_id", "document_id").alias("document_id"),
        (F.col("analysis_seq").cast("bigint") * 2**32 - 1).alias("node_seq"),
        F.lit(None).cast("string").alias("local_id"), F.lit("media_outlet").alias("node_type"),
        F.coalesce(a["source"], F.lit("Unknown Source")).alias("name"),
        a["published"].alias("timestamp"), F.lit(None).cast("string").alias("source_sentence"),
        F.create_map(
            F.lit("title"), F.coalesce(a["title"], F.lit("Untitled")), F.lit("url"), F.coalesce(a["url"], F.lit("")),
            F.lit("bias_label"), F.coalesce(a["bias_label"], F.lit("unknown")),
        ).alias("attributes"),
    )


def build_graph(
    analyses: DataFrame, existing_nodes: DataFrame | None = None, temporal: bool = True, digraph: bool = False
) -> KnowledgeGraph:
    """Nodes, edges and temporal edges of all analyses that carry an article and a payload.

    ``analyses`` has ``analysis_seq``, the order in which they are taken in. Entities are resolved
    once; node and edge tables reuse that result.
    """
    usable = fl.with_payload(analyses)
    published = usable.select("analysis_id", F.col("article.published").alias("_published"))
    fields = ["analysis_id", "document_id", "node_seq", "local_id", "node_type", "name", "timestamp", "source_sentence", "attributes"]
    nodes = fl.complete_nodes(numbered_nodes(usable).select(*fields)).unionByName(outlet_nodes(usable))
    nodes = nodes.join(published, "analysis_id").withColumn("timestamp", F.coalesce("timestamp", "_published"))
    nodes = nodes.drop("_published").withColumn(
        "attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    )
    entities = cut(g.resolve_entities(nodes, existing_nodes))
    placed = g.place_nodes(nodes, entities)
    base, more_sources = g.upsert_nodes(placed)
    edges = fl.complete_edges(numbered_edges(usable)).join(published, "analysis_id")
    edges = edges.withColumn("timestamp", F.coalesce("timestamp", "_published")).drop("_published")
    graph_edges, more_evidence = g.upsert_edges(g.link_edges(edges, placed), digraph)
    if temporal:
        graph_edges = add_temporal(base, graph_edges)
    return KnowledgeGraph(base, graph_edges, more_sources, more_evidence)


def add_temporal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges plus inferred ``precedes`` and ``follows`` edges between event nodes."""
    events = nodes.where("type = 'event'").select("node_id", "timestamp", F.col("node_seq").alias("seq"))
    inferred = g.temporal_edges(g.temporal_pairs(events, [], edges.select("src", "dst")), []).select(
        g.edge_id(F.col("src"), F.col("relation"), F.col("dst")).alias("edge_id"), "src", "relation", "dst", "timestamp",
        F.create_map(F.lit("days_between"), F.col("days_between").cast("string")).alias("attributes"),
    )
    return edges.unionByName(inferred, allowMissingColumns=True)


def fold_unified(nodes: DataFrame, edges: DataFrame, result: EventAggregation) -> tuple[DataFrame, DataFrame]:
    """Put a unified event graph into an existing graph; existing values stand."""
    incoming = result.nodes.select(
        "node_type", "name", "node_seq", "lname",
        F.create_map(
            F.lit("total_weight"), F.col("total_weight").cast("string"),
            F.lit("event_appearances"), F.col("event_appearances").cast("string"),
        ).alias("attributes"),
        F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("document_id"),
    )
    known = nodes.select(F.col("type").alias("node_type"), "name", "node_seq", "node_id")
    entities = cut(g.resolve_entities(incoming, known))
    base, _ = g.upsert_nodes(g.place_nodes(incoming, entities))
    folded = g.fold_nodes(nodes, base)
    # one edge row per unified edge, its ends looked up by type and name
    ids = entities.select(F.col("node_type").alias("_t"), F.col("norm").alias("_n"), "node_id")
    ends = (
        result.edges.withColumns(
            {"_sn": g.normalized_name(F.col("src_name")), "_dn": g.normalized_name(F.col("dst_name"))}
        )
        .join(ids.toDF("src_type", "_sn", "src"), ["src_type", "_sn"])
        .join(ids.toDF("dst_type", "_dn", "dst"), ["dst_type", "_dn"])
    )
    linked = ends.groupBy("src", "relation", "dst").agg(
        F.sum("total_weight").alias("total_weight"), F.sum("event_appearances").alias("event_appearances")
    )
    fresh = linked.join(edges.select("src", "relation", "dst"), ["src", "relation", "dst"], "left_anti").select(
        g.edge_id(F.col("src"), F.col("relation"), F.col("dst")).alias("edge_id"), "src", "relation", "dst",
        F.create_map(
            F.lit("total_weight"), F.col("total_weight").cast("string"),
            F.lit("event_appearances"), F.col("event_appearances").cast("string"),
        ).alias("attributes"),
    )
    return folded, edges.unionByName(fresh, allowMissingColumns=True)


def build_from_files(
    spark: SparkSession, analyses_dir: str, target: str, graph_id: str,
    patterns: tuple[str, ...] = ("kg_analysis_*.json", "analysis_*.json"), snapshot_id: str = "first",
) -> tuple[KnowledgeGraph, DataFrame]:
    """Read analysis files of all patterns, build, save, snapshot; returns the graph and statistics."""
    frames = [payload_from_answers(read_analyses(spark, analyses_dir, p)[0]) for p in patterns]
    analyses = frames[0]
    for other in frames[1:]:
        analyses = analyses.unionByName(other)
    # file names give the order in which analyses are taken in
    numbered = ranks(analyses.withColumn("_all", F.lit(0)), ["_all"], ["file_name"], "analysis_seq").drop("_all")
    built = build_graph(numbered)
    write_graph(built.nodes, built.edges, graph_metadata(built.nodes, built.edges, graph_id, 1), target)
    nodes, edges = spark.read.parquet(f"{target}/nodes"), spark.read.parquet(f"{target}/edges")
    save_snapshot(nodes, edges, target, graph_id, "Graph updated from analyses", snapshot_id)
    return built, g.graph_statistics(nodes, edges)
