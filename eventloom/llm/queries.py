"""Queries of this subpackage: name -> function, and SQL where SQL can say the same."""

from __future__ import annotations

from eventloom.llm import (
    arrow_ids,
    byte_bpe,
    decontaminate,
    hnsw,
    importance,
    language,
    pieces,
    pii,
    quality,
    simhash,
    spelling,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_sentencepiece": pieces.query,
    "op3_pii": pii.query,
    "op4_hnsw": hnsw.query,
    "op5_toxicity": toxicity.query,
    "op6_arrow_ids": arrow_ids.query,
    "op7_quality": quality.query,
    "op8_language": language.query,
    "op9_simhash": simhash.query,
    "op10_decontamination": decontaminate.query,
    "op11_spelling": spelling.query,
    "op12_importance": importance.query,
    "op13_byte_bpe": byte_bpe.query,
}

ORACLES: dict[str, str] = {}
