"""From landed entries to stored documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import entry_date, iso_timestamp
from ..functions.text import article_id
from ..operators import filters as fl
from ..operators import ingest as ing


@dataclass
class Collected:
    articles: DataFrame
    reasons: DataFrame
    channels: DataFrame
    history: DataFrame


def screen_entries(entries: DataFrame, start, end, keywords=fl.TOPIC_KEYWORDS, threshold: int = 1) -> DataFrame:
    """Entries with ``published``, the ``reason`` they are left out for, and ``ok``."""
    dated = entries.withColumn("published", entry_date(entries.columns))
    reason = (
        F.when(F.coalesce("link", F.lit("")) == "", "no_link")
        .when(~fl.in_date_range(F.col("published"), start, end), "outside_date_range")
        .when(~fl.is_relevant(F.col("title"), F.col("summary"), keywords, threshold), "not_political")
    )
    return dated.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def screen_sitemap(urls: DataFrame, start, end) -> DataFrame:
    """Sitemap rows (source, loc, lastmod) inside the dates that look like articles."""
    return urls.where(fl.in_date_range(F.col("lastmod"), start, end) & fl.is_article_url(F.col("loc")))


def entries_of(entries: DataFrame, sources: DataFrame, kind: str) -> DataFrame:
    """Landed rows of the active sources of one type, with the source's bias."""
    wanted = fl.active_sources(sources).where(F.col("type") == kind).select(
        F.col("name").alias("source"), F.col("bias").alias("bias_label")
    )
    return entries.join(wanted, "source")


def collect(
    entries: DataFrame,
    start,
    end,
    limit: int | None = None,
    extra_channels: tuple[DataFrame, ...] = (),
    history: DataFrame | None = None,
    mode: str = "incremental",
    keywords=fl.TOPIC_KEYWORDS,
    threshold: int = 1,
) -> Collected:
    """Screen feed entries, stop broken sources, add other channels, drop URL copies.

    ``entries`` is (source, pos, title, link, summary, date fields); other channels are articles
    (url, title, content, published, source, flags). Feed rows come first in the URL dedup.
    """
    screened = screen_entries(entries, start, end, keywords, threshold)
    read = ing.circuit_breaker(screened, limit=limit)
    feed = read.where("ok").select(
        F.col("link").alias("url"), "title", F.col("summary").alias("content"), "published", "source",
        F.lit(0).alias("_channel"), F.col("pos").alias("_pos"),
    )
    if mode == "first_run":
        feed = feed.where(fl.after_cutoff(F.col("published")))
    channels = [feed]
    for i, other in enumerate(extra_channels, 1):
        stamped = other.withColumn("published", iso_timestamp(F.col("published").cast("string")))
        channels.append(stamped.withColumns({"_channel": F.lit(i), "_pos": F.xxhash64("url", "title")}))
    everything = ing.union_channels(*channels)
    counted = ing.daily_history(everything, history)
    unique = ing.first_per_url(everything.withColumn("seq", F.struct("_channel", "_pos"))).drop("seq", "_channel", "_pos")
    articles = unique.withColumn("id", article_id(F.col("url")))
    return Collected(articles, ing.filter_reasons(read), ing.channel_counts(articles), counted)
