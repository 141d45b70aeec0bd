"""Composite event jobs: per document, across analyses, and with lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import id_set_digest
from ..operators import document_events as doc
from ..operators import equivalence as eq
from ..operators import events as ev
from ..operators.graph import content_digest
from ..operators.ordered import join_by
from ..session import cut


def numbered_mentions(analyses: DataFrame, titles: bool = False, normalize: bool = False) -> DataFrame:
    """Mentions with ``mention_seq``, their place over all analyses.

    ``analysis_seq`` is the place of an analysis; origin and position order mentions inside it.
    """
    m = ev.extract_mentions(analyses, titles, normalize)
    return m.withColumn(
        "mention_seq",
        F.col("analysis_seq").cast("bigint") * 2**32 + F.col("origin").cast("bigint") * 2**30 + F.col("pos"),
    )


def numbered_nodes(analyses: DataFrame) -> DataFrame:
    nodes = ev.explode_nodes(analyses)
    return nodes.withColumn("node_seq", F.col("analysis_seq").cast("bigint") * 2**32 + F.col("node_pos"))


def numbered_edges(analyses: DataFrame) -> DataFrame:
    edges = ev.explode_edges(analyses)
    return edges.withColumn("edge_seq", F.col("analysis_seq").cast("bigint") * 2**32 + F.col("edge_pos"))


@dataclass
class EventAggregation:
    """Frames of a two-stage aggregation. Sources and linkages are the stage-one frames."""

    groups: DataFrame
    members: DataFrame
    node_sources: DataFrame
    event_nodes: DataFrame
    edge_sources: DataFrame
    event_edges: DataFrame
    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame


def aggregate_events(analyses: DataFrame, dedupe_mentions: bool = False) -> EventAggregation:
    """Match events over analyses, consolidate each event's graph, unify over events.

    The nodes are taken out of the nested analyses once; four steps read them.
    """
    columns = ["analysis_id", "node_seq", "local_id", "node_type", "name", "confidence", "timestamp", "attributes"]
    nodes = cut(numbered_nodes(analyses).select(*columns))
    return aggregate_frames(numbered_mentions(analyses), nodes, numbered_edges(analyses), dedupe_mentions)


def aggregate_frames(
    mentions: DataFrame, nodes: DataFrame, edges: DataFrame, dedupe_mentions: bool = False
) -> EventAggregation:
    groups = ev.event_groups(mentions, dedupe_mentions)
    members = ev.group_members(groups)
    node_sources = ev.event_node_sources(groups, nodes)
    event_nodes = ev.event_nodes(node_sources)
    edge_sources = ev.event_edge_sources(groups, ev.resolve_edges(edges, nodes))
    event_edges = ev.event_edges(edge_sources)
    names = ev.node_names(nodes)
    unified = join_by(ev.unified_nodes(event_nodes), names, ["node_type", "lname"])
    unified_edges = ev.unified_edges(event_edges)
    return EventAggregation(
        groups, members, node_sources, event_nodes, edge_sources, event_edges, unified, unified_edges,
        ev.unified_stats(unified, unified_edges, members),
    )


def aggregation_lineage(analyses: DataFrame, result: EventAggregation) -> tuple[DataFrame, DataFrame]:
    """Run record (ids and output hash), and one row per contributing analysis."""
    ids = analyses.select("analysis_id").distinct()
    record = ids.agg(id_set_digest(F.col("analysis_id")).alias("aggregation_id"))
    output = content_digest(result.nodes.drop("node_seq")).select("content_hash")
    record = record.select(
        "aggregation_id", output.scalar().alias("output_hash"),
        F.lit("two_stage_event_centric").alias("aggregation_method"),
        F.current_timestamp().alias("aggregation_timestamp"),
    )
    parts = ids.select(record.select("aggregation_id").scalar().alias("aggregation_id"), "analysis_id")
    return record, parts


@dataclass
class DocumentGraph:
    events: DataFrame
    actors: DataFrame
    nodes: DataFrame
    edges: DataFrame


def aggregate_documents(analyses: DataFrame) -> DocumentGraph:
    """Merge the analyses of each document into one event-centred graph.

    Payload edges are resolved to names before they enter the graph; an event endpoint stands for
    the merged event its mention went into.
    """
    # each of these is read by several steps below
    mentions = cut(numbered_mentions(analyses, titles=True, normalize=True))
    assigned = cut(doc.clusters(mentions))
    events = cut(doc.merged_events(mentions, assigned))
    nodes = cut(numbered_nodes(analyses).select("analysis_id", "document_id", "node_seq", "local_id", "node_type", "name"))
    edges = numbered_edges(analyses)

    heads = events.select("cluster", F.col("name").alias("event_name"))
    told = mentions.where("origin = 1").join(assigned, "mention_seq").join(heads, "cluster").select(
        "analysis_id", "local_id", "event_name"
    )
    named = nodes.join(told, ["analysis_id", "local_id"], "left").withColumn(
        "name", F.coalesce("event_name", "name")
    )
    ends = named.groupBy("analysis_id", "local_id").agg(
        F.max_by(F.struct("node_type", "name"), "node_seq").alias("k")
    ).select("analysis_id", "local_id", "k.node_type", "k.name")
    src, dst = ends.toDF("analysis_id", "source_id", "src_type", "src_name"), ends.toDF(
        "analysis_id", "target_id", "dst_type", "dst_name"
    )
    raw = edges.join(src, ["analysis_id", "source_id"]).join(dst, ["analysis_id", "target_id"]).select(
        "document_id", "src_type", "src_name", "relation", "dst_type", "dst_name"
    )
    plain = nodes.select("document_id", "node_type", "name")
    event_names = events.select("document_id", "name")
    links = (
        doc.actor_links(plain, event_names)
        .unionByName(doc.narrative_links(plain, event_names))
        .unionByName(doc.target_links(raw, event_names))
        .unionByName(raw)
        .distinct()
    )
    links = cut(links)
    performed = links.where("relation = 'performs' and dst_type = 'event'").join(
        events.select("document_id", F.col("name").alias("dst_name"), F.col("date_raw").alias("timestamp"), "cluster"),
        ["document_id", "dst_name"],
    ).select(
        "document_id", F.col("src_name").alias("actor"), F.col("dst_name").alias("event"),
        F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.col("cluster").alias("seq"),
    )
    follow = doc.actor_sequences(performed).select(
        "document_id", F.lit("event").alias("src_type"), F.col("src_event").alias("src_name"), "relation",
        F.lit("event").alias("dst_type"), F.col("dst_event").alias("dst_name"),
    )
    all_edges = links.unionByName(follow).distinct()
    from_edges = all_edges.select("document_id", F.col("src_type").alias("node_type"), F.col("src_name").alias("name")).union(
        all_edges.select("document_id", "dst_type", "dst_name")
    )
    shown = (
        event_names.select("document_id", F.lit("event").alias("node_type"), "name")
        .union(plain.where("node_type in ('actor', 'narrative')"))
        .union(from_edges)
    )
    return DocumentGraph(events, doc.merged_actors(mentions, assigned), doc.get_or_add_nodes(shown), all_edges)


def observations_from_documents(graph: DocumentGraph, documents: DataFrame, analysis_ids: DataFrame) -> DataFrame:
    """Merged events as observations of their source (doc_id, source, bias_label)."""
    actor = graph.actors.groupBy("document_id", "cluster").agg(F.min("actor").alias("actor"))
    return (
        graph.events.join(actor, ["document_id", "cluster"], "left")
        .withColumn("actor", F.coalesce("actor", F.lit("Unknown")))
        .join(documents.select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_name"),
                               F.col("bias_label").alias("source_bias")), "document_id", "left")
        .join(analysis_ids, "document_id", "left")
        .withColumn("source_doc_id", F.col("document_id"))
    )


@dataclass
class ProvenanceBatch:
    members: DataFrame
    sets: DataFrame
    evidence: DataFrame
    relationships: DataFrame


def provenance_batch(analyses: DataFrame) -> ProvenanceBatch:
    """Equivalence sets and weighted relationships of a batch, with every instance kept."""
    domain = analyses.select("analysis_id", F.col("article.domain").alias("domain"))
    members = eq.instances(numbered_nodes(analyses)).join(domain, "analysis_id", "left")
    evidence = eq.relationship_evidence(members, ev.explode_edges(analyses))
    return ProvenanceBatch(members, eq.equivalence_sets(members), evidence, eq.weighted_relationships(evidence))
