"""Signatures, lineage and manifest checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, hmac_sha256, hmac_sha256_private
from ..functions.text import blank
from ..session import cut


def _message(hash_: Column, metadata: Column, signed_at: Column) -> Column:
    """The signed text: hash, metadata and time as JSON with fields in name order."""
    return F.to_json(
        F.struct(hash_.alias("content_hash"), metadata.alias("metadata"), signed_at.alias("timestamp"))
    )


def sign(
    documents: DataFrame, key: bytes, signed_at: Column, id_column: str = "doc_id", private: bool = False
) -> DataFrame:
    """Signature rows for (id, content, metadata), metadata being canonical JSON text."""
    hmac = hmac_sha256_private if private else hmac_sha256
    hashed = documents.select(
        id_column, content_hash(F.col("content")).alias("content_hash"), "metadata", signed_at.alias("signed_at")
    )
    message = _message(F.col("content_hash"), F.col("metadata"), F.col("signed_at"))
    return hashed.withColumn("signature", hmac(message, key))


def verify(documents: DataFrame, signatures: DataFrame, key: bytes, id_column: str = "doc_id") -> DataFrame:
    """(id, verified, reason): content hash, metadata and HMAC must all agree."""
    s = signatures.select(
        id_column, F.col("content_hash").alias("_hash"), F.col("metadata").alias("_metadata"), "signed_at", "signature"
    )
    message = _message(F.col("_hash"), F.col("_metadata"), F.col("signed_at"))
    reason = (
        F.when(blank(F.col("content")), "empty content")
        .when(F.col("metadata").isNull(), "no metadata")
        .when(F.col("signature").isNull(), "no signature")
        .when(content_hash(F.col("content")) != F.col("_hash"), "content hash mismatch")
        .when(~F.col("metadata").eqNullSafe(F.col("_metadata")), "metadata mismatch")
        .when(~F.coalesce(hmac_sha256(message, key) == F.col("signature"), F.lit(False)), "signature mismatch")
    )
    return documents.join(s, id_column, "left").select(
        id_column, reason.isNull().alias("verified"), reason.alias("reason")
    )


def verification_summary(checked: DataFrame, keys: list[str]) -> DataFrame:
    return checked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("verified").alias("verified"),
        F.count_if(~F.col("verified")).alias("failed"),
    )


def verify_records(records: DataFrame, key: bytes) -> DataFrame:
    """Check signed analysis records (analysis_id, result_hash, record, signed_at, signature)."""
    message = _message(F.col("result_hash"), F.col("record"), F.col("signed_at"))
    reason = (
        F.when(F.col("record").isNull(), "Invalid provenance file")
        .when(F.col("signature").isNull(), "No signature found")
        .when(F.col("signature") != hmac_sha256(message, key), "Signature verification failed")
    )
    return records.select("analysis_id", reason.isNull().alias("verified"), reason.alias("reason"))


def sign_records(records: DataFrame, key: bytes) -> DataFrame:
    message = _message(F.col("result_hash"), F.col("record"), F.col("signed_at"))
    return records.withColumn("signature", hmac_sha256(message, key))


def split_import(checked: DataFrame, incoming: DataFrame, id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and failed ids with the reason."""
    good = checked.where("verified").select(id_column)
    return incoming.join(good, id_column, "left_semi"), checked.where(~F.col("verified"))


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status): ok, missing or mismatch for every listed path. ``sha256:`` may prefix."""
    bare = lambda c: F.regexp_replace(c, "^sha256:", "")
    found = files.select("path", bare(F.col("sha256")).alias("_found"))
    return manifest.join(found, "path", "left").select(
        "path",
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("_found") != bare(F.col("sha256")), "mismatch")
        .otherwise("ok")
        .alias("status"),
    )


def derivations(documents: DataFrame, analyses: DataFrame, aggregations: DataFrame) -> DataFrame:
    """Lineage edges document -> analysis -> aggregation, one row per step.

    ``analyses`` is (analysis_id, document_id), ``aggregations`` (aggregation_id, analysis_id).
    """
    steps = analyses.where(F.col("document_id").isNotNull()).select("document_id", "analysis_id")
    known = steps.join(documents.select("document_id"), "document_id", "left_semi").select(
        "document_id", "analysis_id", F.lit(True).alias("stored")
    )
    tagged = steps.join(known, ["document_id", "analysis_id"], "left").withColumn(
        "stored", F.coalesce("stored", F.lit(False))
    )
    return tagged.join(aggregations, "analysis_id", "left").select(
        "document_id", "analysis_id", "aggregation_id", "stored"
    )


def derivation_map(steps: DataFrame) -> DataFrame:
    """Per document: number of its analyses and of the aggregations built on them."""
    return steps.groupBy("document_id").agg(
        F.count_distinct("analysis_id").alias("analyses"),
        F.count_distinct("aggregation_id").alias("aggregations"),
    )


def audit_versions(versions: DataFrame) -> DataFrame:
    """(package, version, ok) for rows (package, version, hash, previous_version, previous_hash, genesis).

    The first version must be a genesis; each later one names its predecessor and the
    predecessor's hash and is one higher. The predecessor of a number is found by an equi-join on
    that number, and only the first number of a package needs an aggregate.
    """
    num = F.regexp_replace("version", "^v+", "").try_cast("bigint")
    rows = versions.withColumn("num", num)
    first = rows.groupBy("package").agg(F.min("num").alias("_first"))
    prior = rows.select(
        "package", (F.col("num") + 1).alias("num"), F.col("version").alias("_version"), F.col("hash").alias("_hash")
    )
    ok = F.when(F.col("num") == F.col("_first"), F.coalesce("genesis", F.lit(False))).otherwise(
        F.coalesce(
            (F.col("previous_version") == F.col("_version")) & (F.col("previous_hash") == F.col("_hash")),
            F.lit(False),
        )
    )
    return rows.join(first, "package").join(prior, ["package", "num"], "left").select(
        "package", "version", F.coalesce(ok, F.lit(False)).alias("ok")
    )


def valid_versions(versions: DataFrame) -> DataFrame:
    """(package, version, valid): whether a version and all before it, back to the genesis, pass the audit.

    ``versions`` is as for :func:`audit_versions`. Each version points at the one that it names; in a
    round every pointer jumps to where its target points, taking the target's verdict along, so a
    chain of n versions takes log2(n) rounds, each a written table. One broken version makes all
    later ones invalid; so does a missing one, and versions that name each other in a ring. Of
    repeated rows of one version all must pass.
    """
    key = ["package", "version"]
    audited = audit_versions(versions).groupBy(*key).agg(F.min("ok").alias("valid"))
    named = versions.groupBy(*key).agg(
        F.max("previous_version").alias("up"), F.min(F.coalesce("genesis", F.lit(False))).alias("genesis")
    )
    # who is invalid, or is the genesis, has arrived
    on_the_way = F.when(F.col("valid") & ~F.col("genesis"), F.col("up"))
    at = cut(audited.join(named, key).select(*key, "valid", on_the_way.alias("up")))
    for _ in range(at.count().bit_length() + 1):
        if at.where("up is not null").isEmpty():
            break
        over = at.select(F.col("package").alias("p"), F.col("version").alias("v"), F.col("valid").alias("good"), F.col("up").alias("farther"))
        met = at.join(over, (at["package"] == over["p"]) & (at["up"] == over["v"]), "left")
        valid = F.col("valid") & (F.col("up").isNull() | F.coalesce("good", F.lit(False)))
        at = cut(met.select(*key, valid.alias("valid"), F.when(valid, F.col("farther")).alias("up")))
    return at.select(*key, (F.col("valid") & F.col("up").isNull()).alias("valid"))


def next_package_version(history: DataFrame) -> DataFrame:
    """``vNNN`` after the latest successful export; v001 where there is none."""
    current = current_version(history).select(
        (F.regexp_replace("version", "^v+", "").try_cast("bigint") + 1).alias("n")
    )
    return current.agg(F.max("n").alias("n")).select(
        F.format_string("v%03d", F.coalesce("n", F.lit(1))).alias("version")
    )


def current_version(history: DataFrame) -> DataFrame:
    """Latest successful export."""
    return history.where("success").agg(F.max_by("version", "time").alias("version")).where("version is not null")


def graph_matches_log(graph_metadata: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row: whether graph and version log speak of the same graph."""
    both = graph_metadata.select("graph_id", F.lit("graph").alias("part")).union(
        provenance.select("graph_id", F.lit("log").alias("part"))
    )
    return both.agg(
        ((F.count_distinct("part") == 2) & (F.count_distinct("graph_id") == 1)).alias("consistent")
    )


def latest(df: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Newest row per key; older rows are dropped before the shuffle."""
    w = W.partitionBy(*keys).orderBy(F.desc(stamp))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
