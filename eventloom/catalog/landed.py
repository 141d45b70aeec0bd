"""Sources, sinks and scoring functions: tables are landed in their stored form, read back, compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import maps as M
from ..functions import text as T
from ..operators import events as ev
from ..operators import filters as fl
from ..operators import ingest as ing
from ..session import fresh_dir
from ..sources import files, sinks
from ..sources import tables as t
from .registry import query, r6


@query("feed_entries_scan", """SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1) AS source, page_id AS pos,
  url AS link, sha256(html) AS summary_hash FROM pages""")
def feed_entries_scan(spark, sf):
    """Feed entries landed as JSON lines."""
    base = fresh_dir(spark, "entries")
    t.table(spark, sf, "pages").select(
        T.url_netloc(F.col("url")).alias("source"), F.col("page_id").alias("pos"), F.col("url").alias("link"), F.col("html").alias("summary")
    ).write.json(base)
    read = files.read_entries(spark, base)
    return read.select("source", "pos", "link", F.sha2("summary", 256).alias("summary_hash"))


@query("sitemap_scan", """SELECT url AS loc, CASE WHEN page_id % 7 <> 0 THEN strftime(DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER), '%Y-%m-%d') END AS day FROM pages""")
def sitemap_scan(spark, sf):
    """Sitemap rows landed as XML, some without a date; newest first."""
    base = fresh_dir(spark, "sitemap")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("page_id") % 365).cast("int"))
    t.table(spark, sf, "pages").select(
        F.col("url").alias("loc"), F.when(F.col("page_id") % 7 != 0, F.date_format(day, "yyyy-MM-dd")).alias("lastmod")
    ).write.format("xml").option("rowTag", "url").option("rootTag", "urlset").save(base)
    newest = ing.sitemap_newest_first(files.read_sitemap(spark, base))
    return newest.select("loc", F.date_format("lastmod", "yyyy-MM-dd").alias("day"))


@query("taxonomy_scan", """SELECT 'node' AS kind, p_name || ' ' || p_partkey AS name, len(string_split(p_type, ' ')) AS attributes FROM part
UNION ALL SELECT 'relation', 'r' || p_partkey, 1 FROM part WHERE p_partkey % 3 <> 0""")
def taxonomy_scan(spark, sf):
    """Types declared in CSV: nodes, relations with and without both sides, and rows without a name."""
    base, part = fresh_dir(spark, "taxonomy"), t.table(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    nodes = part.select(F.lit("node"), F.concat_ws(" ", "p_name", key), F.lit(""), F.replace("p_type", F.lit(" "), F.lit(";")), F.lit("x, \"y\""))
    sides = F.when(F.col("p_partkey") % 3 != 0, "actor → event").otherwise("actor")
    relations = part.select(F.lit("relation"), F.concat(F.lit("r"), key), sides, F.lit(""), F.lit(""))
    unnamed = part.select(F.lit("node"), F.lit(" "), F.lit(""), F.lit(""), F.lit(""))
    columns = ["taxonomy_type", "name", "domain_range", "key_attributes", "examples"]
    nodes.union(relations).union(unnamed).toDF(*columns).write.option("escape", '"').csv(base, header=True)
    declared, _mappings = files.read_taxonomy(spark, base)
    return declared.select("kind", "name", F.size("attributes").cast("bigint").alias("attributes"))


@query("document_sink", "SELECT doc_id, sha256(text) AS digest FROM documents")
def document_sink(spark, sf):
    """Half of the documents stored first, then all of them: each is stored once."""
    base, docs = fresh_dir(spark, "store"), t.table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    sinks.store_documents(docs.where("doc_id % 2 = 0"), base)
    sinks.store_documents(docs, base)
    return spark.read.parquet(base).select("doc_id", F.sha2("content", 256).alias("digest"))


@query("lineage_sink", "SELECT sha256(text) AS document_id, CAST(doc_id AS VARCHAR) AS stored_doc_id FROM documents")
def lineage_sink(spark, sf):
    """Lineage of all documents, stored twice with the same effect as once."""
    base = fresh_dir(spark, "lineage")
    rows = t.table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("document_id"), F.col("doc_id").cast("string").alias("stored_doc_id")
    )
    for _again in range(2):
        sinks.store_lineage(rows, base)
    return spark.read.parquet(base).select("document_id", "stored_doc_id")


@query("vector_sink", "SELECT vec_id AS item_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings")
def vector_sink(spark, sf):
    """Vectors written, appended again, cleared, written anew."""
    base, rows = fresh_dir(spark, "vectors"), t.vectors(spark, sf)
    sinks.write_vectors(rows.where("item_id % 3 = 0"), base)
    sinks.clear_vectors(spark, base)
    sinks.write_vectors(rows.where("item_id % 2 = 0"), base)
    sinks.write_vectors(rows, base)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return spark.read.parquet(base).select("item_id", r6(total).alias("total"))


@query("repository_export", """SELECT 'part' AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part
UNION ALL SELECT 'customer', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer""")
def repository_export(spark, sf):
    """Tables copied to an export folder; one that does not exist is left out."""
    base, target = fresh_dir(spark, "repository"), fresh_dir(spark, "export")
    keys = {"part": "p_partkey", "customer": "c_custkey"}
    for name in keys:
        t.table(spark, sf, name).write.parquet(f"{base}/{name}")
    sinks.export_tables(spark, base, target, [*keys, "missing"])
    each = [
        spark.read.parquet(f"{target}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(key).cast("bigint").alias("keys"))
        for name, key in keys.items()
    ]
    return each[0].unionByName(each[1])


@query("latest_unified", "SELECT user_id AS node, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'click' GROUP BY user_id")
def latest_unified(spark, sf):
    """Two runs of a unified graph; only the newer one is read."""
    base, events = fresh_dir(spark, "unified"), t.table(spark, sf, "events")
    for run, kind in (("2024-01", "view"), ("2024-02", "click")):
        counted = events.where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("node")).agg(F.count("*").alias("n"))
        sinks.write_unified(counted, counted, base, run)
    nodes, _edges = sinks.read_latest_unified(spark, base)
    return nodes.select("node", "n")


_SIGN = """sig AS (SELECT *, lower(event_type) || '|' || user_id % 5 || '|' || strftime(ts, '%Y-%m-%d') AS a,
  lower(event_type) || '|' || CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id % 5 AS VARCHAR) END || '|' || strftime(ts, '%Y-%m-%d') AS b FROM events)"""


@query("signature_similarity", f"""WITH {_SIGN} SELECT event_id,
  CASE WHEN event_id % 11 = 0 THEN 0.0 WHEN event_id % 3 <> 0 AND user_id % 5 = event_id % 5 THEN 1.0 ELSE round(CAST(2 AS DOUBLE) / 3, 6) END AS similarity FROM sig""")
def signature_similarity(spark, sf):
    day, kind = F.date_format("ts", "yyyy-MM-dd"), F.lower("event_type")
    left = F.concat_ws("|", kind, (F.col("user_id") % 5).cast("string"), day)
    odd = F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") % 5).cast("string"))
    right = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat_ws("|", kind, odd, day))
    return t.table(spark, sf, "events").select("event_id", r6(T.signature_similarity(left, right)).alias("similarity"))


@query("temporal_scores", """SELECT event_id, CAST(CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE CASE event_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 0.0 END END AS DOUBLE) AS score FROM events""")
def temporal_scores(spark, sf):
    """Days apart, with missing and unreadable dates."""
    day = F.to_date("ts")
    other = F.date_format(F.date_add(day, (F.col("event_id") % 4).cast("int")), "yyyy-MM-dd")
    right = F.when(F.col("event_id") % 14 == 0, "N/A").when(F.col("event_id") % 7 == 0, "soon").otherwise(other)
    score = D.temporal_score(F.date_format(day, "yyyy-MM-dd"), right)
    return t.table(spark, sf, "events").select("event_id", score.cast("double").alias("score"))


@query("location_scores", """SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 0.0 END AS DOUBLE) AS score FROM customer""")
def location_scores(spark, sf):
    key = F.col("c_custkey") % 4
    left = F.concat_ws(", ", F.lit("Hall"), "c_name", F.lit("State"))
    right = (
        F.when(key == 0, F.upper(left)).when(key == 1, F.concat_ws(",", F.lit("Room"), "c_name", F.lit("state")))
        .when(key == 2, F.lit("Elsewhere, State")).otherwise(F.lit("Elsewhere"))
    )
    return t.table(spark, sf, "customer").select("c_custkey", T.location_score(left, right).cast("double").alias("score"))


@query("event_dates", """SELECT event_id, CASE WHEN event_id % 5 > 1 THEN strftime(ts, '%Y-%m-%d') END AS day FROM events""")
def event_dates(spark, sf):
    """ISO days and times; ``N/A`` and words give null."""
    k = F.col("event_id") % 5
    raw = (
        F.when(k == 0, "N/A").when(k == 1, "someday").when(k == 2, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00Z")))
    )
    return t.table(spark, sf, "events").select("event_id", F.date_format(D.event_date(raw), "yyyy-MM-dd").alias("day"))


@query("stripped_answers", "SELECT conv_id, turn, sha256(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS digest FROM conversations")
def stripped_answers(spark, sf):
    """Reasoning before every second answer is cut off."""
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("I think < so\n</think>\n"), "text")).otherwise(F.col("text"))
    return t.table(spark, sf, "conversations").select("conv_id", "turn", F.sha2(T.strip_reasoning(answer), 256).alias("digest"))


@query("payload_forms", "SELECT doc_id, source || ',' || lang AS names FROM documents")
def payload_forms(spark, sf):
    """Payload lists written as lists and as objects read alike."""
    node = lambda c: F.struct(F.col(c).alias("name"))
    as_list = F.to_json(F.array(node("source"), node("lang")))
    as_map = F.to_json(F.struct(node("source").alias("n1"), node("lang").alias("n2")))
    raw = F.when(F.col("doc_id") % 2 == 0, as_list).otherwise(as_map)
    names = F.transform(M.list_or_map(raw, "struct<name string>"), lambda n: n["name"])
    return t.table(spark, sf, "documents").select("doc_id", F.array_join(names, ",").alias("names"))


@query("analyses_with_payload", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0")
def analyses_with_payload(spark, sf):
    docs = t.table(spark, sf, "documents")
    analyses = docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 3 != 0, F.struct(F.col("text").alias("content"))).alias("article"),
        F.when(F.col("doc_id") % 4 != 0, F.struct(F.array("source").alias("nodes"))).alias("kg_payload"),
    )
    return fl.with_payload(analyses).select("doc_id")


@query("documents_with_content", "SELECT d.doc_id, quality FROM documents d JOIN labels USING (doc_id) WHERE d.doc_id % 5 <> 0")
def documents_with_content(spark, sf):
    """Texts joined to their metadata; empty texts are none."""
    contents = t.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("text")).otherwise("").alias("content"))
    return ing.with_content(contents, t.table(spark, sf, "labels")).select("doc_id", "quality")


@query("new_events", """WITH m AS (SELECT event_id AS o, 'user_' || user_id AS a, event_type AS b, strftime(ts, '%Y-%m-%d') AS c FROM events)
SELECT DISTINCT sha256(a || '|' || b || '|' || c || '|here') AS event_id, a || '|' || b || '|' || c || '|here' AS event_signature, b AS event_type FROM m WHERE o % 2 = 0
  AND a || b || c NOT IN (SELECT a || b || c FROM m WHERE o % 2 = 1)""")
def new_events(spark, sf):
    """Rows inserted for observations of events that are not stored yet."""
    e = t.table(spark, sf, "events").select(
        F.col("event_id").alias("observation_id"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("sig_actor"),
        F.col("event_type").alias("sig_action"), F.date_format("ts", "yyyy-MM-dd").alias("sig_date"), F.lit("here").alias("sig_location"),
        F.col("event_type").alias("action"),
    )
    e = e.withColumn("signature", F.concat_ws("|", *ev.SIGNATURE_PARTS))
    known = e.where("observation_id % 2 = 1").select("signature", F.col("signature").alias("event_id"), F.col("observation_id").alias("last_updated"))
    attached = ev.attach_observations(e.where("observation_id % 2 = 0"), known)
    return ev.new_event_rows(attached).select("event_id", "event_signature", "event_type")


@query("title_actors", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Clerk ' || o_custkey END AS actor FROM orders")
def title_actors(spark, sf):
    name = F.concat(F.lit("Clerk "), F.col("o_custkey").cast("string"))
    title = F.when(F.col("o_orderkey") % 2 == 0, F.concat(name, F.lit(" signs order "), "o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return t.table(spark, sf, "orders").select("o_orderkey", T.title_actor(title).alias("actor"))
