import json

from fixtures import analyses_frame, node, two_stage_rows
from pyspark.sql import functions as F

from eventloom.operators import events as ev
from eventloom.operators import lineage as ln
from eventloom.operators import quality as ql
from eventloom.operators import stats as st
from eventloom.plans import aggregation as agg
from eventloom.plans import exports as ex
from eventloom.sources import files, sinks


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value), encoding="utf-8")


def test_event_store_round_trip(spark, tmp_path):
    mentions = spark.createDataFrame(
        [(1, "Bob", "arrested", "2025-01-01", "NY", "d1", "a1", "S", "left"), (2, "bob", "detained", "2025-01-01", "ny", "d2", "a2", "T", "right")],
        "observation_id long, actor string, action string, date_raw string, location string, source_doc_id string, analysis_id string, source_name string, source_bias string",
    )
    signed = ev.with_signature(mentions)
    none = signed.limit(0).select("signature", F.lit("x").alias("event_id"), F.lit(1).alias("last_updated"))
    attached = ev.attach_observations(signed, none)
    rows = ev.new_event_rows(attached)
    assert rows.count() == 1 and rows.first().weight == 1.0
    path = str(tmp_path / "obs")
    for _ in range(2):
        sinks.save_observations(attached, path)
    obs = spark.read.parquet(path)
    assert obs.count() == 2
    weights = ev.event_weights(obs, ["event_id"])
    assert weights.first().weight == 2.0 and ev.heavy_events(weights).count() == 1
    stored = rows.withColumn("core_attributes", F.lit('{"actor": "Bob"}'))
    event_id = rows.first().event_id
    assert ev.event_by_id(stored, event_id).first().core_attributes == {"actor": "Bob"}
    told = obs.select("event_id", "observation_id", F.col("date_raw").alias("observed_at"), F.lit('{"date": "x"}').alias("extracted_data"))
    assert ev.event_detail(stored, told, event_id).first().extracted_data == {"date": "x"}
    assert ev.with_observation_counts(rows, obs).first().observation_count == 2
    assert ev.recent_events(rows, None).count() == 1 and ev.no_observation_weight()["weight"] == 0.0


def test_document_observations(spark):
    a = analyses_frame(spark, two_stage_rows())
    graph = agg.aggregate_documents(a)
    docs = spark.createDataFrame([("doc_001", "CNN", "left"), ("doc_002", "Reuters", "center"), ("doc_003", "Fox", "right")], "doc_id string, source string, bias_label string")
    ids = docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("agg_"), "doc_id").alias("analysis_id"))
    obs = agg.observations_from_documents(graph, docs, ids)
    got = obs.collect()
    assert len(got) == 3 and {r.actor for r in got} == {"Unknown"} and {r.source_bias for r in got} == {"left", "center", "right"}
    assert ev.event_weights(ev.with_signature(obs), ["signature"]).first().weight == 3.0


def test_profiles(spark):
    rows = two_stage_rows() + [{"analysis_id": "bare", "template_file": "t.json"}]
    a = analyses_frame(spark, rows)
    p = st.analysis_profile(a).first()
    assert tuple(p) == (7, 6, 3, 3)
    assert {r.template: r.n for r in st.template_usage(a).collect()} == {"Unknown": 6, "t.json": 1}
    samples = st.sample_without_events(a).collect()
    assert len(samples) == 3 and set(samples[0].node_types_found) == {"actor", "institution"}
    nodes = ev.explode_nodes(a)
    assert st.sample_events(nodes, 2).count() == 2
    prof = st.profile(nodes.select("node_type", F.lit(None).cast("string").alias("event_type"), F.lit("S").alias("source"), "timestamp"))
    got = {(r.section, r.value): r.n for r in prof.collect()}
    assert got[("event_year", "2025")] == 3 and got[("event_type", "unspecified")] == 3 and got[("node_type", "actor")] == 6
    assert st.analyzed_count(a).first().analyzed == 3


def test_templates_and_files(spark, tmp_path):
    write(tmp_path / "t/a_analysis.json", {"name": "A", "status": "PRODUCTION", "rounds": [{"name": "r", "prompt": "p"}]})
    write(tmp_path / "t/b_analysis.json", {"status": "TESTING"})
    got = {r["name"]: (r.catalogue, r.rounds) for r in st.template_catalogue(files.read_templates(spark, str(tmp_path / "t"))).collect()}
    assert got == {"A": ("approved", 1), "b_analysis.json": ("unapproved", 0)}
    assert files.latest_file(spark, str(tmp_path / "t"), "*.json").first().path.endswith(".json")
    write(tmp_path / "l/x_lineage.json", {"aggregation_id": "x", "crypto_lineage": {"derived_from_analyses": ["a", "b"]}})
    write(tmp_path / "m/y_lineage.json", {"analysis_id": "a", "crypto_lineage": {"derivation": {"derived_from_document": "d"}}})
    write(tmp_path / "n/z_lineage.json", {"document_id": "d", "crypto_record": {"stored_doc_id": "s"}})
    aggs = files.read_lineage(spark, str(tmp_path / "l"), "aggregation").select("aggregation_id", F.explode("crypto_lineage.derived_from_analyses").alias("analysis_id"))
    ans = files.read_lineage(spark, str(tmp_path / "m"), "analysis").select("analysis_id", F.col("crypto_lineage.derivation.derived_from_document").alias("document_id"))
    docs = files.read_lineage(spark, str(tmp_path / "n"), "document").select("document_id")
    steps, chain = ex.lineage_chain(docs, ans, aggs)
    assert [(r.document_id, r.analysis_id, r.aggregation_id, r.stored) for r in steps.collect()] == [("d", "a", "x", True)]
    row = chain.first()
    assert (row.total_documents, row.total_analyses, row.total_aggregations) == (1, 1, 1)
    nodes = spark.createDataFrame([("n", "t")], "node_id string, type string")
    edges = spark.createDataFrame([("n", "r", "n")], "src string, relation string, dst string")
    record = ex.export_record("v001", nodes, nodes, edges, chain)
    assert record.first().export_hash == ex.export_record("v001", nodes, nodes, edges, chain).first().export_hash
    assert record.first().export_hash != ex.export_record("v002", nodes, nodes, edges, chain).first().export_hash


def test_tables(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1.0)], "lname string, total_weight double")
    for run, df in (("20250101", nodes), ("20250102", nodes.union(nodes))):
        sinks.write_unified(df, df, str(tmp_path / "u"), run)
    latest, _edges = sinks.read_latest_unified(spark, str(tmp_path / "u"))
    assert latest.count() == 2
    sinks.export_tables(spark, str(tmp_path / "u"), str(tmp_path / "copy"), ["nodes", "absent"])
    assert spark.read.parquet(str(tmp_path / "copy/nodes")).count() == 3
    vectors = spark.createDataFrame([("v", [1.0])], "item_id string, embedding array<float>")
    path = str(tmp_path / "v")
    sinks.write_vectors(vectors, path)
    sinks.write_vectors(vectors, path)
    assert spark.read.parquet(path).count() == 1
    sinks.clear_vectors(spark, path)
    assert spark.read.parquet(path).count() == 0
    sinks.log_export(spark, str(tmp_path / "h"), "v001", True)
    sinks.log_export(spark, str(tmp_path / "h"), "v002", False)
    assert ln.next_package_version(spark.read.parquet(str(tmp_path / "h"))).first().version == "v002"
    docs = spark.createDataFrame([("d", "text", "u", "2025")], "doc_id string, content string, url string, collected_at string")
    lineage = sinks.document_lineage(docs, b"k")
    sinks.store_lineage(lineage, str(tmp_path / "lin"))
    assert spark.read.parquet(str(tmp_path / "lin")).first().stored_doc_id == "d"
    newest = ln.latest(spark.createDataFrame([("g", 1), ("g", 2)], "k string, t int"), ["k"], "t")
    assert [r.t for r in newest.collect()] == [2]


def test_rounds_validation_equals_row_form(spark):
    rows = [("a", "PRODUCTION", True, n, "fine", None) for n in ("fact_extraction", "article_analysis", "node_extraction")]
    rows += [("b", "PRODUCTION", True, "fact_extraction", "ERROR: x", "x"), ("c", None, True, "fact_extraction", "ok", None)]
    df = spark.createDataFrame(rows, "id string, template_status string, has_article boolean, name string, response string, error string")
    got = {r.id: (r.status, r.reason) for r in ql.validate_rounds(df, ["id"]).collect()}
    assert got["a"] == ("VALID", "Passed all validation checks") and got["c"][0] == "REVIEW"
    assert got["b"] == ("FAILED", "Failed validation checks: required_fields, no_llm_errors")


def test_quarantine(spark):
    df = spark.createDataFrame([("1", '[{"id": 3}]'), ("2", "no")], "k string, response string")
    good, bad = ql.recover(df, "list", "array<struct<id string>>")
    assert good.first().parsed[0].id == "3" and [(r.k, r.length) for r in bad.collect()] == [("2", 2)]


def test_decisions_leave_others_alone(spark):
    rows = [{"analysis_id": i, "template_name": "t", "validation": {"status": s}} for i, s in (("a", "REVIEW"), ("b", "REVIEW"), ("c", "VALID"))]
    a = analyses_frame(spark, rows)
    d = spark.createDataFrame([("a", True, "me", "now", None), ("b", False, "me", "now", "bad")], "analysis_id string, approve boolean, actor string, decided_at string, notes string")
    got = {r.analysis_id: r.validation for r in st.apply_decisions(a, d).collect()}
    assert (got["a"].status, got["a"].approved_by, got["a"].notes) == ("VALID", "me", "")
    assert (got["b"].status, got["b"].rejected_by, got["b"].notes) == ("REJECTED", "me", "bad")
    assert got["c"].status == "VALID" and got["c"].approved_by is None
    assert st.review_queue(a).count() == 2 and node(1, "x", "y")["id"] == "1"
