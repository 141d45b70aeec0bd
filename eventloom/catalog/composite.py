"""Streaming queries and composite jobs over the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..plans import aggregation as agg
from ..plans import annotate as an
from ..plans import collect as co
from ..plans import exports as ex
from ..session import fresh_dir
from ..sources import tables as t
from ..streaming import jobs as sj
from ..streaming import weights as sw
from .events import _STAGE1, WEIGHT_SQL
from .registry import ARTICLES, SIGNED, query, r6


def _run(spark, stream_job, label):
    """Run a job to its end in fresh folders; returns the sink folder."""
    base = fresh_dir(spark, label)
    stream_job(f"{base}/out", f"{base}/cursor").awaitTermination()
    return f"{base}/out"


@query("stream_fresh_articles", "SELECT DISTINCT url FROM pages")
def stream_fresh_articles(spark, sf):
    """Two landings of every page within the overlap; one of each URL is kept."""
    pages = sj.table_stream(spark, sf, "pages").select(
        "url", F.explode(F.array(F.lit(0), F.lit(10))).alias("late"), "page_id"
    )
    stamped = pages.select("url", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 60 + F.col("late") * 60).alias("collected_at"))
    out = _run(spark, lambda o, c: sj.collect_stream(stamped, o, c), "articles")
    return spark.read.parquet(out).select("url")


@query("stream_store", "SELECT doc_id, source FROM documents")
def stream_store(spark, sf):
    """Every document arrives twice and is stored once."""
    docs = sj.table_stream(spark, sf, "documents").select(
        "doc_id", "source", F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival")
    ).drop("arrival")
    out = _run(spark, lambda o, c: sj.store_stream(docs, o, c), "store")
    return spark.read.parquet(out)


@query("stream_daily_history", f"WITH {ARTICLES} SELECT published AS day, CAST(count(*) AS BIGINT) AS n FROM articles WHERE published IS NOT NULL GROUP BY published")
def stream_daily_history(spark, sf):
    doc = F.col("doc_id")
    stamped = sj.table_stream(spark, sf, "documents").select(
        F.when(doc % 20 != 0, F.date_add(F.to_date(F.lit("2024-01-01")), (doc % 365).cast("int")).cast("timestamp")).alias("published")
    )
    out = _run(spark, lambda o, c: sj.history_stream(stamped, o, c), "history")
    return sj.read_history(spark, out)


def _observations(events):
    user, bias = F.col("user_id"), F.col("user_id") % 4
    return events.select(
        F.concat(F.lit("User "), user.cast("string")).alias("actor"), F.col("event_type").alias("action"),
        F.date_format("ts", "yyyy-MM-dd").alias("date_raw"),
        F.concat(F.lit("loc "), F.get_json_object("props", "$.k")).alias("location"),
        F.concat(F.lit("src"), (user % 10).cast("string")).alias("source_name"),
        F.when(bias == 0, "left").when(bias == 1, "center").when(bias == 2, "right").alias("source_bias"),
    )


@query("stream_event_weight", f"""WITH {SIGNED}, g AS (
{WEIGHT_SQL.format(keys="sig_actor, sig_action, sig_date, sig_location", frame="signed")})
SELECT concat_ws('|', sig_actor, sig_action, sig_date, sig_location) AS signature, CAST(n AS BIGINT) AS source_count,
       CAST(biases AS DOUBLE) AS weight FROM g""")
def stream_event_weight(spark, sf):
    obs = _observations(sj.table_stream(spark, sf, "events"))
    out = _run(spark, lambda o, c: sj.weight_stream(obs, o, c), "weights")
    return sj.read_weights(spark, out).select("signature", "source_count", r6("weight").alias("weight"))


@query("stream_stateful_weights", f"""WITH {SIGNED}, g AS (
{WEIGHT_SQL.format(keys="sig_actor, sig_action, sig_date, sig_location", frame="signed")})
SELECT concat_ws('|', sig_actor, sig_action, sig_date, sig_location) AS signature, CAST(n AS BIGINT) AS source_count,
       CAST(biases AS DOUBLE) AS weight, CAST(names AS BIGINT) AS unique_sources FROM g""")
def stream_stateful_weights(spark, sf):
    """All events landed as three files, a micro-batch each, weighed with keyed state."""
    landed = fresh_dir(spark, "landed")
    t.table(spark, sf, "events").repartition(3, "event_id").write.parquet(landed)
    stream = spark.readStream.schema(spark.read.parquet(landed).schema).option("maxFilesPerTrigger", 1).parquet(landed)
    out = fresh_dir(spark, "weights")
    sw.stateful_weight_stream(_observations(stream), out, fresh_dir(spark, "cursor")).awaitTermination()
    return sw.current_weights(spark, out).select("signature", "source_count", r6("weight").alias("weight"), "unique_sources")


def _letter_embedding():
    """Stub embedding: vowel counts."""

    @F.pandas_udf("array<float>")
    def embedding(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [float(s.count(v)) for v in "aeiou"])

    return embedding


@query("stream_vector_sync", """SELECT 'node_' || p_partkey AS item_id,
  CAST(length('Type: part Name: ' || p_name) - length(replace('Type: part Name: ' || p_name, 'a', '')) AS DOUBLE) AS letter_a FROM part""")
def stream_vector_sync(spark, sf):
    parts = sj.table_stream(spark, sf, "part").select(
        F.concat(F.lit("node_"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("part").alias("type"),
        F.col("p_name").alias("name"), F.create_map().cast("map<string,string>").alias("attributes"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival"),
    ).drop("arrival")
    out = _run(spark, lambda o, c: sj.vector_stream(parts, o, c, _letter_embedding()), "vectors")
    return spark.read.parquet(out).select("item_id", F.col("embedding")[0].cast("double").alias("letter_a"))


@query("event_aggregation", f"""WITH {_STAGE1}
SELECT node_type, lname, round(sum(weight), 6) AS total_weight, CAST(count(*) AS BIGINT) AS event_appearances
FROM en GROUP BY node_type, lname""")
def event_aggregation(spark, sf):
    """The two-stage job as one call."""
    result = agg.aggregate_frames(t.order_mentions(spark, sf), t.kg_nodes(spark, sf), t.kg_edges(spark, sf))
    return result.nodes.select("node_type", "lname", r6("total_weight").alias("total_weight"), "event_appearances")


@query("annotated_documents", """SELECT conv_id || '/' || turn || '_length' AS analysis_id, role || ' ' || length(text) AS answer FROM conversations""")
def annotated_documents(spark, sf):
    """Two rounds of a stub annotator over every turn: the second sees the first one's answer."""
    docs = t.table(spark, sf, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("doc_id"),
        F.col("text").alias("content"), F.col("text").alias("raw"), "role",
    )

    def stub(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: str(len(p[6:])) if p.startswith("count:") else p)

    template = an.Template("length", [an.Round("size", "count:{raw}"), an.Round("answer", "{role} {size}")])
    out = an.annotate(docs, template, stub, separator="\n")
    return out.select("analysis_id", F.element_at("rounds", -1)["response"].alias("answer"))


@query("collected_entries", """WITH e AS (
  SELECT source, doc_id AS pos, 'https://n.example/' || doc_id AS url, contains(lower(source || ' ' || text), 'the ') AS rel,
         DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS published FROM documents),
o AS (SELECT *, rel AND published BETWEEN DATE '2024-02-01' AND DATE '2024-11-30' AS ok FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos) AS rk, sum(CAST(ok AS INT)) OVER (PARTITION BY source ORDER BY pos) AS oks FROM o),
f AS (SELECT *, rk - coalesce(max(CASE WHEN ok THEN rk END) OVER (PARTITION BY source ORDER BY pos), 0) AS run FROM r),
s AS (SELECT source, least(min(CASE WHEN run = 5 THEN rk END), min(CASE WHEN oks = 10 THEN rk END)) AS stop FROM f GROUP BY source)
SELECT url, source, CAST(published AS DATE) AS published, substr(md5(url), 1, 12) AS id
FROM f JOIN s USING (source) WHERE ok AND rk <= coalesce(stop, 9223372036854775807)""")
def collected_entries(spark, sf):
    """Documents as feed entries of their source, through the whole collection job."""
    import datetime as dt

    doc = F.col("doc_id")
    entries = t.table(spark, sf, "documents").select(
        "source", doc.alias("pos"), F.concat(F.lit("https://n.example/"), doc.cast("string")).alias("link"),
        F.col("source").alias("title"), F.col("text").alias("summary"),
        F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (doc % 365).cast("int")), "yyyy-MM-dd").alias("date"),
    )
    got = co.collect(entries, dt.datetime(2024, 2, 1), dt.datetime(2024, 11, 30), limit=10, keywords=["the "])
    return got.articles.select("url", "source", F.to_date("published").alias("published"), "id")


@query("lineage_chain", """SELECT CAST((SELECT count(*) FROM customer) AS BIGINT) AS total_documents, CAST((SELECT count(*) FROM orders) AS BIGINT) AS total_analyses,
  CAST((SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m')) FROM orders) AS BIGINT) AS total_aggregations""")
def lineage_chain(spark, sf):
    orders = t.table(spark, sf, "orders")
    doc = F.concat(F.lit("doc_"), F.col("o_custkey").cast("string")).alias("document_id")
    an_id = F.concat(F.lit("an_"), F.col("o_orderkey").cast("string")).alias("analysis_id")
    documents = t.table(spark, sf, "customer").select(F.concat(F.lit("doc_"), F.col("c_custkey").cast("string")).alias("document_id"))
    steps, chain = ex.lineage_chain(
        documents, orders.select(an_id, doc), orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("aggregation_id"), an_id)
    )
    return chain.drop("chain_id")
