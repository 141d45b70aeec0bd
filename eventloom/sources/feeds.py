"""Landed JSON pages of three public feeds, brought to one article layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_tags

ARTICLE_COLUMNS = ["title", "url", "content", "published", "source"]
REGISTER = "results array<struct<title string, html_url string, abstract string, publication_date string, type string>>"
ACTIONS = "title struct<rendered string>, link string, excerpt struct<rendered string>, date string"
BILLS = "packages array<struct<title string, packageLink string, lastModified string>>"


def _text(c: str):
    return F.coalesce(F.col(c), F.lit(""))


def _limited(df: DataFrame, limit: int | None) -> DataFrame:
    """A feed's own row limit, in page order (the landed pages carry ``_page`` and ``_pos``)."""
    out = df if limit is None else df.orderBy("_page", "_pos").limit(limit)
    return out.select(*ARTICLE_COLUMNS)


def _pages(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("multiLine", True).json(path).withColumn("_page", F.col("_metadata.file_name"))


def register(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = _pages(spark, path, REGISTER).select("_page", F.posexplode("results").alias("_pos", "r"))
    return _limited(
        rows.select(
            "_page", "_pos", _text("r.title").alias("title"), _text("r.html_url").alias("url"),
            _text("r.abstract").alias("content"), _text("r.publication_date").alias("published"),
            F.lit("Federal Register").alias("source"),
        ),
        limit,
    )


def actions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Posts whose link speaks of presidential actions; the excerpt loses its markup."""
    pages = spark.read.text(path, wholetext=True).withColumn("_page", F.col("_metadata.file_name"))
    rows = pages.select("_page", F.posexplode(F.from_json("value", f"array<struct<{ACTIONS}>>")).alias("_pos", "r"))
    return _limited(
        rows.where(F.contains(_text("r.link"), F.lit("presidential-actions"))).select(
            "_page", "_pos", _text("r.title.rendered").alias("title"), _text("r.link").alias("url"),
            strip_tags(F.col("r.excerpt.rendered")).alias("content"), _text("r.date").alias("published"),
            F.lit("White House").alias("source"),
        ),
        limit,
    )


def bills(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = _pages(spark, path, BILLS).select("_page", F.posexplode("packages").alias("_pos", "r"))
    return _limited(
        rows.select(
            "_page", "_pos", _text("r.title").alias("title"), _text("r.packageLink").alias("url"),
            F.lit("").alias("content"), _text("r.lastModified").alias("published"),
            F.lit("Congress.gov").alias("source"),
        ),
        limit,
    )
