"""Corpus pipeline: language ID, near-dedup, decontamination, PII redaction, piece encoding.

Each stage takes what its predecessor kept and returns rows with the columns of ``documents``; the
last one adds ``token_ids`` and ``n_tokens``. Null and empty texts are rejected by the first stage
(they have no letters); an empty table passes through all stages. ``run`` writes each stage's result
to the shared folder and reads it back, so a stage is planned over written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, language, pieces, pii, simhash
from eventloom.llm.common import free, table
from eventloom.session import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; models are learned from the labelled ones."""
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that of the smallest doc_id."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind in brackets."""
    return pii.redact(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids and the number of them; ``text`` is what the ids decode to."""
    import public_tokenizers

    codec = pieces.Pieces(spark, public_tokenizers.path("piece_bpe_32k.model"))
    ids, count = free(docs, "token_ids"), free(docs, "n_tokens")
    both = free(docs, "transcoded")
    encoded = docs.withColumn(both, codec.transcode(docs["text"]))
    decoded = F.col(f"{both}.decoded").alias("text")
    return encoded.select(
        *[decoded if c == "text" else encoded[c] for c in docs.columns],
        F.col(f"{both}.ids").alias(ids),
        F.size(f"{both}.ids").cast("long").alias(count),
    )


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("SentencePiece encoding and decoding", piece_encoding),
]
ORACLE_SQL = None  # models and automata are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (_name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = cut(docs)
    return docs
