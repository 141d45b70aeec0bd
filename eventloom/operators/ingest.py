"""Landed collection rows: limits, breaker, union, dedup, idempotent storing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import article_id, url_netloc
from .ordered import join_by, ranks, running_sums

BREAKER_FAILURES = 5


def limit_per_source(entries: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` entries of each source (null is one too) in feed order.

    Places are counted in blocks, so a source of any size is split over tasks.
    """
    return ranks(entries, ["source"], ["pos"], "_rn").where(F.col("_rn") <= limit).drop("_rn")


def first_per_url(articles: DataFrame, order: str = "seq") -> DataFrame:
    """Keep the first article of each URL; copies are dropped before the shuffle."""
    w = W.partitionBy("url").orderBy(order)
    return articles.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def circuit_breaker(
    entries: DataFrame, limit: int | None = None, failures: int = BREAKER_FAILURES
) -> DataFrame:
    """Entries (source, pos, ok, ...) that are still read before their source is stopped.

    A source stops with the ``failures``-th failure in a row, or once ``limit`` entries are ok.
    Positions and successes are counted by blocked running sums; an island is a success and the
    failures behind it, and only island and source minima are shuffled.
    """
    counted = running_sums(
        entries, ["source"], ["pos"], {"_rank": F.lit(1), "_oks": F.col("ok").cast("int")}
    )
    islands = counted.groupBy("source", "_oks").agg(
        F.count_if(~F.col("ok")).alias("bad"), F.min("_rank").alias("start")
    )
    behind = F.when(F.col("_oks") == 0, F.lit(0)).otherwise(F.col("start"))
    stops = islands.groupBy("source").agg(
        F.min(F.when(F.col("bad") >= failures, behind + failures)).alias("_trip"),
        F.min(F.when(F.col("_oks") == limit, F.col("start"))).alias("_full")
        if limit is not None
        else F.lit(None).cast("bigint").alias("_full"),
    )
    kept = F.coalesce(F.least("_trip", "_full"), F.lit(2**62))
    return join_by(counted, stops, ["source"]).where(F.col("_rank") <= kept).drop(
        "_rank", "_oks", "_trip", "_full"
    )


def union_channels(*channels: DataFrame) -> DataFrame:
    """All channels with the union of their columns."""
    out = channels[0]
    for other in channels[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def article_metadata(articles: DataFrame) -> DataFrame:
    """Stored metadata columns with their defaults."""
    have = set(articles.columns)

    def get(name: str, default=None, kind: str = "string"):
        col = F.col(name) if name in have else F.lit(None).cast(kind)
        return (col if default is None else F.coalesce(col, F.lit(default))).alias(name)

    return articles.select(
        get("title", "Untitled"),
        get("url", ""),
        get("source", "Unknown"),
        get("bias_label", "unknown"),
        get("published"),
        get("collected_at"),
        get("id"),
        get("author"),
        get("via_google_news", False, "boolean"),
        get("via_gdelt", False, "boolean"),
        get("via_gov_api", False, "boolean"),
        get("extraction_method"),
    )


def with_article_id(articles: DataFrame) -> DataFrame:
    return articles.withColumn("id", article_id(F.col("url")))


def unseen(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet, one per key within the batch."""
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def unanalyzed(documents: DataFrame, analyses: DataFrame) -> DataFrame:
    return documents.join(
        analyses.where(F.col("doc_id").isNotNull()).select("doc_id"), "doc_id", "left_anti"
    )


def analyzed_documents(analyses: DataFrame) -> DataFrame:
    """Document ids of analyses in either layout."""
    doc = F.coalesce("article.document_id", "document_id") if "document_id" in analyses.columns else F.col("article.document_id")
    return analyses.select(doc.alias("doc_id")).where("doc_id is not null").distinct()


def select_targets(
    documents: DataFrame, analyses: DataFrame, target: str = "unanalyzed", since=None, cap: int | None = None
) -> DataFrame:
    """Documents for the next analysis batch, oldest id first; ``cap`` at most where one is given."""
    if target in ("recent", "all") and since is not None:
        chosen = documents.where(F.col("collected_at") >= F.lit(since))
    elif target == "recent":
        chosen = documents.limit(0)
    else:
        chosen = unanalyzed(documents, analyses)
    return chosen if cap is None else chosen.orderBy("doc_id").limit(cap)


def with_content(contents: DataFrame, metadata: DataFrame) -> DataFrame:
    """Documents that have both a text and metadata."""
    return contents.where(F.coalesce("content", F.lit("")) != "").join(metadata, "doc_id")


def recover_failed(
    failed: DataFrame, candidates: DataFrame, attempts: int | None = None
) -> DataFrame:
    """First candidate page of the same host for each failed URL, or the first ``attempts`` of them.

    The best candidate of a host is settled by aggregation before the join, so a host with many
    candidates or failures is no hot pair.
    """
    tried = failed if attempts is None else failed.orderBy("seq").limit(attempts)
    tried = tried.withColumn("host", url_netloc(F.col("url")))
    best = (
        candidates.withColumn("host", url_netloc(F.col("candidate_url")))
        .groupBy("host")
        .agg(F.min_by("candidate_url", "rank").alias("candidate_url"))
    )
    return tried.join(best, "host").select("url", "source", "candidate_url")


def collection_stats(entries: DataFrame) -> DataFrame:
    """One row of attempt and success counts and rates from (stage, ok) rows."""
    out = []
    for stage in ("source", "article", "decode", "recovery"):
        of = F.col("stage") == stage
        tried, good = F.count_if(of), F.count_if(of & F.col("ok"))
        rate = good / F.greatest(F.lit(1), tried) * 100
        out += [
            tried.alias(f"{stage}_attempted"),
            good.alias(f"{stage}_succeeded"),
            F.format_string("%.1f%%", rate).alias(f"{stage}_rate"),
        ]
    return entries.agg(*out)


def filter_reasons(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def daily_history(articles: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Articles per published day, added to stored counts."""
    fresh = (
        articles.where(F.col("published").isNotNull())
        .groupBy(F.to_date("published").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if history is None:
        return fresh
    return fresh.unionByName(history).groupBy("day").agg(F.sum("n").alias("n"))


def channel_counts(articles: DataFrame) -> DataFrame:
    """Counts per channel flag. Government rows also count as feed rows."""
    have = set(articles.columns)

    def flag(name: str):
        return F.coalesce(F.col(name), F.lit(False)) if name in have else F.lit(False)

    return articles.agg(
        F.count_if(~flag("via_google_news") & ~flag("via_gdelt")).alias("rss"),
        F.count_if(flag("via_google_news")).alias("google_news"),
        F.count_if(flag("via_gdelt")).alias("gdelt"),
        F.count_if(flag("via_gov_api") | flag("via_gov_scraper")).alias("government"),
    )


def sitemap_newest_first(urls: DataFrame) -> DataFrame:
    """Sitemap rows (loc, lastmod), newest first, undated last."""
    return urls.orderBy(F.col("lastmod").desc_nulls_last(), "loc")
