"""Readers for landed files. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas as S
from ..functions.dates import iso_timestamp
from ..functions.maps import list_or_map
from ..functions.text import blank, strip


def _stem(name, suffix: str):
    """File name without its ending."""
    return F.regexp_replace(name, suffix, "")


def _json(spark: SparkSession, path: str, ddl: str, glob: str = "*.json", **options: str) -> DataFrame:
    """One JSON document per file, with ``file_name``; unreadable ones keep their text in
    ``_corrupt``."""
    schema = StructType.fromDDL(ddl).add("_corrupt", "string")
    texts = spark.read.options(pathGlobFilter=glob, **options).text(path, wholetext=True)
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return texts.select(parsed.alias("x"), F.col("_metadata.file_name").alias("file_name")).select("x.*", "file_name")


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the names of unreadable files."""
    good = df.where(F.col("_corrupt").isNull()).drop("_corrupt")
    return good, df.where(F.col("_corrupt").isNotNull()).select("file_name", "_corrupt")


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return texts.select(
        _stem(F.col("_metadata.file_name"), r"\.txt$").alias("doc_id"), F.col("value").alias("content")
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    good, _corrupt = split_corrupt(_json(spark, path, S.DOCUMENT_METADATA))
    return good.withColumn("doc_id", _stem(F.col("file_name"), r"\.json$")).drop("file_name")


def read_documents(spark: SparkSession, base: str) -> DataFrame:
    """Documents with text and metadata, times parsed beside the raw strings."""
    joined = read_contents(spark, f"{base}/content").join(read_metadata(spark, f"{base}/metadata"), "doc_id")
    return joined.withColumns(
        {
            "published_raw": F.col("published"),
            "published": iso_timestamp(F.col("published")),
            "collected_at": iso_timestamp(F.col("collected_at")),
            "stored_at": iso_timestamp(F.col("stored_at")),
        }
    )


def read_analyses(
    spark: SparkSession, path: str, pattern: str = "analysis_*.json", modified_after: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Analyses and unreadable files. ``modified_after`` bounds the scan by file time.

    Payload lists may also be written as objects; both forms come out as arrays.
    """
    typed = f"kg_payload struct<nodes array<{S.NODE}>, edges array<{S.EDGE}>>"
    raw_ddl = S.ANALYSES.replace(typed, f"kg_payload {S.RAW_PAYLOAD}")
    options = {} if modified_after is None else {"modifiedAfter": modified_after}
    raw = _json(spark, path, raw_ddl, pattern, **options)
    payload = F.when(
        F.col("kg_payload").isNotNull(),
        F.struct(
            list_or_map(F.col("kg_payload.nodes"), S.NODE).alias("nodes"),
            list_or_map(F.col("kg_payload.edges"), S.EDGE).alias("edges"),
        ),
    )
    good, corrupt = split_corrupt(raw)
    named = F.coalesce("analysis_id", F.regexp_replace("file_name", r"\.json$", ""))
    return good.withColumns({"kg_payload": payload, "analysis_id": named}), corrupt


def payload_from_answers(analyses: DataFrame) -> DataFrame:
    """Fill a missing payload from the extraction answers of the prompt chain.

    Every JSON list in a "Node Extraction" or "Edge Extraction" answer counts; its first element
    tells nodes from edges.
    """
    answers = F.transform(
        F.filter(
            F.coalesce("prompt_chain", F.array().cast(analyses.schema["prompt_chain"].dataType)),
            lambda r: F.contains(r["name"], F.lit("Node Extraction")) | F.contains(r["name"], F.lit("Edge Extraction")),
        ),
        lambda r: r["response"],
    )
    lists = F.filter(
        F.flatten(F.transform(answers, lambda a: F.regexp_extract_all(a, F.lit(r"(?s)(\[\s*\{.*\}\s*\])"), F.lit(1)))),
        lambda j: F.try_parse_json(j).isNotNull(),
    )

    def of_kind(field: str, schema: str):
        wanted = F.filter("_lists", lambda j: F.get_json_object(j, f"$[0].{field}").isNotNull())
        return F.flatten(F.transform(wanted, lambda j: F.from_json(j, f"array<{schema}>")))

    filled = analyses.withColumn("_lists", lists).withColumns(
        {"_nodes": of_kind("node_type", S.NODE), "_edges": of_kind("relation", S.EDGE)}
    )
    rebuilt = F.when(
        (F.size("_nodes") > 0) | (F.size("_edges") > 0),
        F.struct(F.col("_nodes").alias("nodes"), F.col("_edges").alias("edges")),
    )
    return filled.withColumn("kg_payload", F.coalesce("kg_payload", rebuilt)).drop("_lists", "_nodes", "_edges")


def read_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Declared types (kind, name, domain, range, attributes, examples) and domain mappings."""
    ddl = "taxonomy_type string, name string, domain_range string, key_attributes string, examples string"
    raw = spark.read.csv(path, header=True, schema=ddl, multiLine=True, escape='"')
    sides = F.transform(F.split(F.coalesce("domain_range", F.lit("")), "→"), strip)
    rows = raw.where(~blank(strip(F.col("taxonomy_type"))) & ~blank(strip(F.col("name")))).select(
        strip(F.col("taxonomy_type")).alias("kind"), strip(F.col("name")).alias("name"),
        F.when(F.size(sides) > 1, sides[0]).alias("domain"), F.try_element_at(sides, F.lit(2)).alias("range"),
        F.transform(F.split(F.coalesce("key_attributes", F.lit("")), ";"), strip).alias("attributes"), "examples",
    )
    declared = rows.where("kind = 'node' or (kind = 'relation' and domain is not null)")
    mappings = declared.where("kind = 'relation'").groupBy("domain", F.col("name").alias("relation")).agg(
        F.collect_list("range").alias("ranges")
    )
    return declared, mappings


def _graph_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    node_rows = nodes.select(
        "node_id", F.coalesce("n.type", F.lit("unknown")).alias("type"), "n.name", "n.attributes", "n.timestamp",
        "n.created_at", F.col("n.source.document_id").alias("document_id"),
        F.col("n.source.sentence").alias("source_sentence"), "n.graph_id", "n.graph_version",
    )
    edge_rows = edges.select(
        F.col("e.id").alias("edge_id"), F.coalesce("e.source", "e.source_id").alias("src"), "e.relation",
        F.coalesce("e.target", "e.target_id").alias("dst"), "e.timestamp", "e.created_at", "e.evidence_quote",
        F.col("e.source_document_id").alias("document_id"), "e.attributes", "e.graph_id", "e.graph_version",
    ).where(~blank(F.col("src")) & ~blank(F.col("dst")))
    return node_rows, edge_rows


def read_graph_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and version log of a graph kept in one JSON file."""
    raw = spark.read.schema(StructType.fromDDL(S.GRAPH_FILE)).option("multiLine", True).json(path)
    nodes = raw.select(F.explode("nodes").alias("node_id", "n"))
    edges = raw.select(F.explode("edges").alias("e"))
    log = raw.select(
        F.col("metadata.graph_id").alias("graph_id"), F.col("metadata.parent_graph_id").alias("parent_graph_id"),
        F.explode_outer("metadata.provenance_chain").alias("p"),
    ).select("graph_id", "parent_graph_id", "p.timestamp", "p.operation", "p.graph_version", "p.description",
             "p.source_ids", "p.content_hash")
    return (*_graph_rows(nodes, edges), log)


def read_graph_dir(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Graph kept as one JSON file per node and edge."""

    def part(name: str, schema: str) -> DataFrame:
        ddl = schema.removeprefix("struct<").removesuffix(">")
        good, _corrupt = split_corrupt(_json(spark, f"{base}/{name}", ddl))
        fields = [c for c in good.columns if c != "file_name"]
        return good.select(_stem(F.col("file_name"), r"\.json$").alias("_id"), F.struct(*fields).alias("x"))

    nodes = part("nodes", S.GRAPH_NODE).select(F.col("_id").alias("node_id"), F.col("x").alias("n"))
    edges = part("edges", S.GRAPH_EDGE).select(F.col("x").withField("id", F.col("_id")).alias("e"))
    return _graph_rows(nodes, edges)


def highest_suffix(ids: DataFrame, column: str) -> DataFrame:
    """Largest number behind the last underscore of an id column, 0 if there is none."""
    number = F.regexp_extract(column, r"_(\d+)$", 1).try_cast("bigint")
    return ids.agg(F.coalesce(F.max(number), F.lit(0)).alias("highest"))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Landed feed entries, JSON lines."""
    return spark.read.schema(S.FEED_ENTRIES).json(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """URLs of XML sitemaps with their parsed time."""
    raw = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return raw.where("loc is not null").select(
        strip(F.col("loc")).alias("loc"), iso_timestamp(strip(F.col("lastmod"))).alias("lastmod")
    )


def file_manifest(spark: SparkSession, base: str) -> DataFrame:
    """(path, sha256, length) of every file below a folder, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    root = base.rstrip("/").removeprefix("file:")
    inside = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), r"^\Q" + root + r"\E/", "")
    return files.select(inside.alias("path"), F.sha2("content", 256).alias("sha256"), "length")


def latest_file(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    """Path of the file written last; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(base)
    return files.agg(F.max_by("path", "modificationTime").alias("path"))


def read_lineage(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Lineage files of one kind: document, analysis or aggregation."""
    ddl = {
        "document": S.LINEAGE_DOCUMENT,
        "analysis": S.LINEAGE_ANALYSIS,
        "aggregation": S.LINEAGE_AGGREGATION,
    }[kind]
    return split_corrupt(_json(spark, path, ddl, "*_lineage.json"))[0].drop("file_name")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    ddl = (
        "name string, description string, version string, status string, "
        "rounds array<struct<name string, prompt string, max_tokens int>>"
    )
    raw = _json(spark, path, ddl, "*_analysis.json")
    return split_corrupt(raw)[0].withColumn("name", F.coalesce("name", "file_name"))
