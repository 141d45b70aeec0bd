"""Roll-ups and review screens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import year_bucket
from .events import document_of


def recent_analyses(analyses: DataFrame, limit: int = 20) -> DataFrame:
    unknown = F.lit("Unknown")
    return analyses.orderBy(F.desc("analyzed_at"), "analysis_id").limit(limit).select(
        "analysis_id", "analyzed_at",
        F.coalesce("template_name", unknown).alias("template"),
        F.coalesce("article.title", unknown).alias("article_title"),
        F.coalesce("article.source", unknown).alias("article_source"),
        F.coalesce("validation.status", unknown).alias("validation_status"),
        F.coalesce("manipulation_score", F.lit(0.0)).alias("manipulation_score"),
        F.coalesce("concern_level", unknown).alias("concern_level"),
    )


def review_queue(analyses: DataFrame) -> DataFrame:
    """Analyses that wait for a person."""
    unknown = F.lit("Unknown")
    return analyses.where(F.col("validation.status") == "REVIEW").select(
        "analysis_id",
        F.coalesce("template_name", unknown).alias("template_name"),
        F.coalesce("validation.template_status", unknown).alias("template_status"),
        F.col("validation.status").alias("validation_status"),
        F.coalesce("validation.reason", F.lit("")).alias("validation_reason"),
        F.coalesce("manipulation_score", F.lit(0.0)).alias("manipulation_score"),
        F.coalesce("concern_level", unknown).alias("concern_level"),
        F.coalesce("authoritarian_indicators", F.array().cast("array<string>")).alias("authoritarian_indicators"),
    )


def apply_decisions(analyses: DataFrame, decisions: DataFrame) -> DataFrame:
    """Set status, actor, time and notes from the latest decision (analysis_id, approve, actor,
    decided_at, notes) of each analysis."""
    latest = decisions.groupBy("analysis_id").agg(
        F.max(F.struct("decided_at", "approve", "actor", "notes")).alias("_d")
    )
    d = latest.select(
        "analysis_id", F.col("_d.approve").alias("_ok"), F.col("_d.actor").alias("_by"),
        F.col("_d.decided_at").alias("_at"), F.col("_d.notes").alias("_notes"),
    )
    v = F.col("validation")
    decided = F.col("_ok").isNotNull()
    yes, no = decided & F.col("_ok"), decided & ~F.col("_ok")
    new = (
        v.withField("status", F.when(yes, "VALID").when(no, "REJECTED").otherwise(v["status"]))
        .withField("approved_by", F.when(yes, F.col("_by")).otherwise(v["approved_by"]))
        .withField("approved_at", F.when(yes, F.col("_at")).otherwise(v["approved_at"]))
        .withField("rejected_by", F.when(no, F.col("_by")).otherwise(v["rejected_by"]))
        .withField("rejected_at", F.when(no, F.col("_at")).otherwise(v["rejected_at"]))
        .withField("notes", F.when(decided, F.coalesce("_notes", F.lit(""))).otherwise(v["notes"]))
    )
    return analyses.join(d, "analysis_id", "left").withColumn("validation", new).drop("_ok", "_by", "_at", "_notes")


def approve_templates(analyses: DataFrame, approvals: DataFrame) -> DataFrame:
    """REVIEW becomes VALID for every analysis of an approved template (template_name, actor, at; the latest counts)."""
    latest = approvals.groupBy("template_name").agg(F.max(F.struct("at", "actor")).alias("_d"))
    a = latest.select("template_name", F.col("_d.actor").alias("_by"), F.col("_d.at").alias("_at"))
    v = F.col("validation")
    hit = F.col("_by").isNotNull() & (v["status"] == "REVIEW")
    new = (
        v.withField("status", F.when(hit, "VALID").otherwise(v["status"]))
        .withField("approved_by", F.when(hit, F.col("_by")).otherwise(v["approved_by"]))
        .withField("approved_at", F.when(hit, F.col("_at")).otherwise(v["approved_at"]))
    )
    return analyses.join(a, "template_name", "left").withColumn("validation", new).drop("_by", "_at")


def top_sources(rows: DataFrame, limit: int = 10) -> DataFrame:
    return (
        rows.groupBy(F.coalesce("source", F.lit("Unknown")).alias("source"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "source")
        .limit(limit)
    )


def profile(nodes: DataFrame) -> DataFrame:
    """(section, value, n): nodes per type, and events per event type, source and year.

    One pass: grouping sets over the exploded nodes (node_type, event_type, source, timestamp).
    """
    is_event = F.col("node_type") == "event"
    rows = nodes.select(
        F.coalesce("node_type", F.lit("unknown")).alias("node_type"),
        F.when(is_event, F.coalesce("event_type", F.lit("unspecified"))).alias("event_type"),
        F.when(is_event, F.coalesce("source", F.lit("Unknown"))).alias("event_source"),
        F.when(is_event, year_bucket(F.col("timestamp"))).alias("event_year"),
    )
    dims = ["node_type", "event_type", "event_source", "event_year"]
    counted = rows.groupingSets([[d] for d in dims], *dims).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(d).alias(f"_g_{d}") for d in dims]
    )
    section, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        of = F.col(f"_g_{d}") == 0
        section = F.when(of, F.lit(d)).otherwise(section)
        value = F.when(of, F.col(d)).otherwise(value)
    return counted.select(section.alias("section"), value.alias("value"), "n").where("value is not null")


def analysis_profile(analyses: DataFrame) -> DataFrame:
    """One row: analyses in total, with a payload, and with an event node."""
    kinds = F.col("kg_payload.nodes")
    return analyses.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("kg_payload").isNotNull()).alias("files_with_kg_payload"),
        F.count_if(F.exists(kinds, lambda n: n["node_type"] == "event")).alias("files_with_events"),
        F.sum(F.coalesce(F.size(F.filter(kinds, lambda n: n["node_type"] == "event")), F.lit(0))).alias("total_event_nodes"),
    )


def template_usage(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy(F.coalesce("template_file", F.lit("Unknown")).alias("template")).agg(
        F.count(F.lit(1)).alias("n")
    )


def sample_events(nodes: DataFrame, limit: int = 10) -> DataFrame:
    return nodes.where("node_type = 'event'").orderBy("analysis_id", "local_id").limit(limit)


def sample_without_events(analyses: DataFrame, limit: int = 5) -> DataFrame:
    kinds = F.transform("kg_payload.nodes", lambda n: F.coalesce(n["node_type"], F.lit("unknown")))
    bare = (F.size("kg_payload.nodes") > 0) & ~F.array_contains(kinds, "event")
    return analyses.where(bare).orderBy("analysis_id").limit(limit).select(
        "analysis_id", "template_file", F.array_distinct(kinds).alias("node_types_found"),
        F.size("kg_payload.nodes").alias("node_count"),
    )


def repository_statistics(documents: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row: documents, analyses, bytes and megabytes."""
    both = documents.select(F.lit(1).alias("d"), F.lit(0).alias("a"), F.octet_length("content").cast("bigint").alias("b")).union(
        analyses.select(F.lit(0), F.lit(1), F.lit(0).cast("bigint"))
    )
    return both.agg(
        F.coalesce(F.sum("d"), F.lit(0)).alias("total_documents"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("total_analyses"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("total_size_bytes"),
        F.round(F.coalesce(F.sum("b"), F.lit(0)) / 1024 / 1024, 2).alias("total_size_mb"),
    )


def status_rollup(documents: DataFrame, analyzed: DataFrame, **parts: DataFrame) -> DataFrame:
    """One row of totals: documents, analyzed, pending, and a count per further frame."""
    pieces = [documents.select(F.lit("documents").alias("k")), analyzed.select(F.lit("analyzed").alias("k"))]
    pieces += [df.select(F.lit(name).alias("k")) for name, df in parts.items()]
    counts = None
    for piece in pieces:
        one = piece.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        counts = one if counts is None else counts.union(one)
    n = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("n"))), F.lit(0))
    return counts.agg(
        n("documents").alias("documents"), n("analyzed").alias("analyzed"),
        (n("documents") - n("analyzed")).alias("pending"), *[n(k).alias(k) for k in parts],
    )


def template_catalogue(templates: DataFrame) -> DataFrame:
    """Templates with their status group and number of rounds."""
    return templates.select(
        "name",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("version", F.lit("")).alias("version"),
        F.coalesce("status", F.lit("UNKNOWN")).alias("status"),
        F.greatest(F.size(F.coalesce("rounds", F.array().cast(templates.schema["rounds"].dataType))), F.lit(0)).alias("rounds"),
        F.when(F.col("status") == "PRODUCTION", "approved").otherwise("unapproved").alias("catalogue"),
    )


def analyzed_count(analyses: DataFrame) -> DataFrame:
    return analyses.select(document_of(analyses).alias("d")).agg(F.count_distinct("d").alias("analyzed"))
