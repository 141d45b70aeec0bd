"""Fixed schemas of the domain tables. Ids are strings, also where JSON holds numbers."""

from __future__ import annotations

CITATION = (
    "struct<doc_id string, source_text string, context string, paragraph_num int, "
    "sentence_num int, char_start int, char_end int, match_confidence double, match_type string>"
)
NODE = (
    "struct<id string, node_type string, name string, confidence double, timestamp string, "
    f"source_sentence string, attributes map<string,string>, citations array<{CITATION}>>"
)
EDGE = (
    "struct<source_id string, relation string, target_id string, confidence double, "
    "timestamp string, evidence_quote string, attributes map<string,string>, "
    f"citations array<{CITATION}>>"
)
FACT_EVENT = (
    "struct<name string, date string, actors array<string>, action string, "
    "targets array<string>, location string, description string>"
)
ARTICLE = (
    "struct<document_id string, source string, title string, url string, published string, "
    "domain string, bias_label string>"
)
ANALYSES = (
    "analysis_id string, template_name string, template_file string, document_id string, "
    f"article {ARTICLE}, "
    f"facts_data struct<events array<{FACT_EVENT}>, publication_date string>, "
    f"kg_payload struct<nodes array<{NODE}>, edges array<{EDGE}>>, "
    "prompt_chain array<struct<name string, response string>>, "
    "manipulation_score double, concern_level string, authoritarian_indicators array<string>, "
    "validation struct<status string, reason string, template_status string, approved_by string, "
    "approved_at string, rejected_by string, rejected_at string, notes string>, "
    "analyzed_at string"
)
# kg_payload kept as text, for files whose nodes and edges may be objects instead of lists
RAW_PAYLOAD = "struct<nodes string, edges string>"
DOCUMENT_METADATA = (
    "title string, url string, source string, bias_label string, published string, "
    "collected_at string, id string, author string, via_google_news boolean, via_gdelt boolean, "
    "via_gov_api boolean, extraction_method string, document_id string, stored_at string"
)
FEED_ENTRIES = (
    "source string, pos bigint, title string, link string, summary string, "
    "published_parsed string, updated_parsed string, fr_citation_date string, "
    "publication_date string, lastmod_date string, date string, dc_date string"
)
GRAPH_NODE = (
    "struct<id string, type string, name string, attributes map<string,string>, timestamp string, "
    "created_at string, source struct<document_id string, sentence string>, graph_id string, "
    "graph_version int>"
)
GRAPH_EDGE = (
    "struct<id string, source string, target string, source_id string, target_id string, "
    "relation string, timestamp string, created_at string, evidence_quote string, "
    "source_document_id string, attributes map<string,string>, graph_id string, graph_version int>"
)
PROVENANCE = (
    "struct<timestamp string, operation string, graph_id string, graph_version int, "
    "parent_graph_id string, description string, source_ids array<string>, content_hash string>"
)
GRAPH_FILE = (
    "metadata struct<graph_id string, graph_version int, parent_graph_id string, "
    f"provenance_chain array<{PROVENANCE}>>, nodes map<string,{GRAPH_NODE}>, "
    f"edges array<{GRAPH_EDGE}>"
)
LINEAGE_DOCUMENT = (
    "document_id string, crypto_record struct<document_id string, content_hash string, "
    "collection_timestamp string, original_url string, stored_doc_id string>, "
    "collection_signature string, lineage_type string, created_at string"
)
LINEAGE_ANALYSIS = (
    "analysis_id string, crypto_lineage struct<analysis_id string, output_hash string, "
    "derivation struct<analysis_id string, derived_from_document string, "
    "derived_from_template string, analysis_timestamp string>>, lineage_type string, stored_at string"
)
LINEAGE_AGGREGATION = (
    "aggregation_id string, crypto_lineage struct<aggregation_id string, output_hash string, "
    "derived_from_analyses array<string>, aggregation_timestamp string>, lineage_type string, "
    "stored_at string"
)
EVENT_STORE = {
    "events": (
        "event_id string, event_signature string, event_type string, first_seen timestamp, "
        "last_updated timestamp, weight double, source_count bigint, source_diversity double, "
        "confidence_score double, status string, core_attributes string"
    ),
    "observations": (
        "observation_id string, event_id string, source_doc_id string, source_name string, "
        "source_bias string, observed_at timestamp, extracted_data string, analysis_id string, "
        "citations string"
    ),
    "match_decisions": (
        "decision_id string, signature_1 string, signature_2 string, decision string, "
        "confidence double, method string, reasoning string, decided_at timestamp"
    ),
}
