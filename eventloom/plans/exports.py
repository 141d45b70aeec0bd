"""Lineage chains, export records and applying updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import multiset_digest
from ..operators import graph as g
from ..operators import lineage as ln
from ..sources.files import file_manifest, read_graph_file
from ..sources.sinks import import_verified, log_export, read_graph


def lineage_chain(documents: DataFrame, analyses: DataFrame, aggregations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Derivation steps, and one row with the chain id and the counts.

    ``documents`` (document_id), ``analyses`` (analysis_id, document_id), ``aggregations``
    (aggregation_id, analysis_id).
    """
    steps = ln.derivations(documents, analyses, aggregations)
    hashed = steps.select(F.sha2(F.to_json(F.struct("document_id", "analysis_id", "aggregation_id")), 256).alias("h"))
    chain = hashed.agg(multiset_digest(F.col("h")).alias("chain_id"))

    def total(df: DataFrame, column: str):
        return df.agg(F.count_distinct(column).alias("n")).scalar()

    return steps, chain.select(
        "chain_id",
        total(documents, "document_id").alias("total_documents"),
        total(analyses, "analysis_id").alias("total_analyses"),
        total(aggregations, "aggregation_id").alias("total_aggregations"),
    )


def export_record(version: str, unified_nodes: DataFrame, nodes: DataFrame, edges: DataFrame, chain: DataFrame) -> DataFrame:
    """One row: version, hashes of both graphs, chain id and the hash over all of it."""
    unified = g.content_digest(unified_nodes).select("content_hash")
    graph = g.graph_hash(nodes, edges).select("content_hash")
    row = chain.select(
        F.lit(version).alias("version"), "chain_id", unified.scalar().alias("unified_hash"),
        graph.scalar().alias("graph_hash"), "total_documents", "total_analyses", "total_aggregations",
    )
    return row.withColumn("export_hash", F.sha2(F.to_json(F.struct(*sorted(row.columns))), 256))


def check_folder(spark: SparkSession, base: str, manifest: DataFrame) -> DataFrame:
    """Status of every file of a manifest (path, sha256)."""
    return ln.verify_manifest(manifest, file_manifest(spark, base))


def all_ok(statuses: DataFrame) -> bool:
    return statuses.where("status <> 'ok'").isEmpty()


def apply_update(
    spark: SparkSession, folder: str, manifest: DataFrame, own_graph: str, repository: str,
    incoming: DataFrame | None, signatures: DataFrame | None, key: bytes, target: str,
) -> dict[str, object]:
    """Check a folder against its manifest and version log, then merge graph and documents.

    The merged graph is written to ``target``; nothing is written when a check fails.
    """
    if not all_ok(check_folder(spark, folder, manifest)):
        return {"applied": False, "reason": "manifest"}
    log = spark.read.schema("graph_id string").option("multiLine", True).json(f"{folder}/graph/graph_provenance.json")
    meta = spark.read.schema("metadata struct<graph_id string>").option("multiLine", True).json(
        f"{folder}/graph/graph.json"
    ).select("metadata.graph_id")
    if not ln.graph_matches_log(meta, log).first()["consistent"]:
        return {"applied": False, "reason": "provenance"}
    other_nodes, other_edges, _log = read_graph_file(spark, f"{folder}/graph/graph.json")
    nodes, edges, _meta = read_graph(spark, own_graph)
    merged_nodes, merged_edges = g.merge_graphs(nodes, edges, other_nodes, other_edges)
    merged_nodes.write.mode("overwrite").parquet(f"{target}/nodes")
    merged_edges.write.mode("overwrite").parquet(f"{target}/edges")
    failed = None
    if incoming is not None:
        failed = import_verified(incoming, signatures, repository, key)
    return {"applied": True, "failed_documents": failed}


def accept_artifact(
    spark: SparkSession, folder: str, manifest: DataFrame, versions: DataFrame, package: str, version: str, history: str
) -> bool:
    """Manifest and version chain must hold; the accepted version is noted."""
    chain = ln.audit_versions(versions).where((F.col("package") == package) & (F.col("version") == version))
    ok = all_ok(check_folder(spark, folder, manifest)) and not chain.where("ok").isEmpty()
    log_export(spark, history, version, ok, "accepted" if ok else "rejected")
    return ok
