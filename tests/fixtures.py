"""Small synthetic analyses in the fixed schema."""

import json

from pyspark.sql import functions as F

from eventloom import schemas


def node(i, kind, name, confidence=None, timestamp=None, attributes=None, sentence=None):
    return {"id": str(i), "node_type": kind, "name": name, "confidence": confidence, "timestamp": timestamp,
            "attributes": attributes or {}, "source_sentence": sentence}


def edge(a, relation, b, confidence=None, quote=None):
    return {"source_id": str(a), "relation": relation, "target_id": str(b), "confidence": confidence, "evidence_quote": quote}


def analyses_frame(spark, rows):
    """Rows as dicts -> analyses frame with ``analysis_seq`` in the given order."""
    lines = [json.dumps({**r, "analysis_seq": i}) for i, r in enumerate(rows)]
    ddl = schemas.ANALYSES + ", analysis_seq bigint"
    return spark.createDataFrame([(x,) for x in lines], "j string").select(F.from_json("j", ddl).alias("x")).select("x.*")


EVENT = "Climate Executive Order Signing"


def two_stage_rows():
    rows = []
    for doc, source, ev_conf, act_conf, perf, act2, inst, dirc in [
        ("doc_001", "CNN", 0.90, 0.95, 0.90, 0.90, 0.80, 0.85),
        ("doc_002", "Reuters", 0.80, 0.90, 0.80, 0.88, 0.85, 0.80),
        ("doc_003", "Fox", 0.85, 0.90, 0.85, 0.87, 0.80, 0.82),
    ]:
        article = {"document_id": doc, "source": source, "domain": f"{source.lower()}.com"}
        rows.append({
            "analysis_id": f"{doc}_event_analysis", "article": article,
            "facts_data": {"events": [{"name": EVENT, "date": "2025-01-24"}]},
            "kg_payload": {
                "nodes": [node(1, "event", EVENT, ev_conf, "2025-01-24"), node(2, "actor", "President Biden", act_conf)],
                "edges": [edge(2, "performs", 1, perf)],
            },
        })
        rows.append({
            "analysis_id": f"{doc}_actor_analysis", "article": article,
            "kg_payload": {
                "nodes": [node(1, "actor", "President Biden", act2), node(2, "institution", "EPA", inst)],
                "edges": [edge(1, "directs", 2, dirc)],
            },
        })
    return rows
