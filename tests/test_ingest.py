import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventloom import schemas
from eventloom.operators import citations as ci
from eventloom.operators import filters as fl
from eventloom.operators import ingest as ing
from eventloom.operators import lineage as ln
from eventloom.operators import vectors as ve
from eventloom.operators.ordered import ranks, with_next
from eventloom.plans import annotate as an
from eventloom.plans import collect as co
from eventloom.plans import exports as ex
from eventloom.plans import graph_build as gb
from eventloom.sources import feeds, files, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")


@pytest.mark.parametrize("outcomes, limit, kept", [("SFFFFSFFFFFS", None, 11), ("FFFFFS", None, 5), ("SSFSSS", 3, 4), ("SFFFFS", None, 6), ("FFFFSSFFFFFFF", 9, 11)])
def test_circuit_breaker(spark, outcomes, limit, kept):
    rows = [("s", i * 3, c == "S") for i, c in enumerate(outcomes)] + [("t", 0, False)]
    got = ing.circuit_breaker(spark.createDataFrame(rows, "source string, pos long, ok boolean"), limit).groupBy("source").count()
    assert {r.source: r["count"] for r in got.collect()} == {"s": kept, "t": 1}


def test_source_limit_small_and_large(spark):
    df = spark.createDataFrame([("hot" if i % 3 else None, i) for i in range(90)], "source string, pos long")
    for limit in (7, 40, 2000):
        got = [tuple(r) for r in ing.limit_per_source(df, limit).collect()]
        want = [("hot", i) for i in range(90) if i % 3][:limit] + [(None, i) for i in range(0, 90, 3)][:limit]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_null_keys_stay(spark):
    df = spark.createDataFrame([("s", 1, True), (None, 1, True), (None, 2, False), ("s", 2, False)], "source string, pos long, ok boolean")
    assert ing.circuit_breaker(df).count() == 4
    assert sorted((r.source or "", r.pos, r.next.pos if r.next else None) for r in with_next(df, ["source"], ["pos"], ["pos"]).collect()) == [
        ("", 1, 2), ("", 2, None), ("s", 1, 2), ("s", 2, None),
    ]
    assert sorted((r.source or "", r["rank"]) for r in ranks(df, ["source"], ["pos"]).collect()) == [("", 1), ("", 2), ("s", 1), ("s", 2)]


def test_filters(spark):
    df = spark.createDataFrame([("https://a.com/2024/x",), ("https://a.com/TAG/x",), ("https://a.com/tag/x",), ("https://a.com/a.pdf",)], "u string")
    assert [r[0] for r in df.select(fl.is_article_url(F.col("u"))).collect()] == [True, False, False, False]
    df = spark.createDataFrame([("The Senate", "voted"), ("Sports", None), (None, "democracy and POLITICS")], "t string, c string")
    assert [r[0] for r in df.select(fl.keyword_hits(F.col("t"), F.col("c"))).collect()] == [1, 0, 2]
    auto = spark.createDataFrame([("auto", "x/sitemap"), ("auto", "x/a.xml"), ("auto", "x/feed"), ("auto", "x/page"), (None, "x"), ("sitemap", "x")], "k string, u string")
    assert [r[0] for r in auto.select(fl.source_type(F.col("k"), F.col("u"))).collect()] == ["sitemap", "sitemap", "rss", "article", "rss", "sitemap"]
    now = dt.datetime(2025, 6, 1)
    assert fl.read_window(None, now)[0] == "first_run" and fl.read_window("x", now)[1] == now - dt.timedelta(days=1)
    assert fl.read_window("2025-05-01T10:00:00", now) == ("incremental", dt.datetime(2025, 5, 1, 9), now)
    assert fl.read_window("2025-05-01T10:00:00", now, force_full=True)[0] == "full"


def test_collect(spark):
    rows = [("S", 0, "Senate", "https://x/1", "s", "2025-02-01"), ("S", 1, "Senate", None, "s", "2025-02-01"), ("S", 2, "Sport", "https://x/2", "s", "2025-02-01"),
            ("S", 3, "Senate", "https://x/3", "s", "2020-01-01"), ("S", 4, "Senate", "https://x/1", "s", None)]
    entries = spark.createDataFrame(rows, "source string, pos long, title string, link string, summary string, date string")
    other = spark.createDataFrame([("https://x/1", "t", "c", "2025-03-01", "G", True), ("https://x/9", "t", "c", "2025-03-01", "G", True)],
                                  "url string, title string, content string, published string, source string, via_google_news boolean")
    got = co.collect(entries, dt.datetime(2025, 1, 1), dt.datetime(2025, 12, 31), extra_channels=(other,))
    assert {(r.url, r.source) for r in got.articles.collect()} == {("https://x/1", "S"), ("https://x/9", "G")}
    assert {r.reason: r.n for r in got.reasons.collect()} == {"no_link": 1, "not_political": 1, "outside_date_range": 1}
    assert tuple(got.channels.first())[:2] == (1, 1)
    assert {str(r.day): r.n for r in got.history.collect()} == {"2025-02-01": 1, "2025-03-01": 2}


def test_documents_analyses_and_corrupt_files(spark, tmp_path):
    write(tmp_path / "content/d1.txt", "Text one")
    write(tmp_path / "content/d2.txt", "no metadata")
    write(tmp_path / "metadata/d1.json", {"title": "T", "published": "2025-01-01T00:00:00Z", "url": "u"})
    docs = files.read_documents(spark, str(tmp_path)).collect()
    assert [(d.doc_id, d.content, d.published) for d in docs] == [("d1", "Text one", dt.datetime(2025, 1, 1))]
    write(tmp_path / "an/analysis_1.json", {"analysis_id": "a", "article": {"document_id": "d"}, "kg_payload": {"nodes": {"x": {"id": 1, "node_type": "event", "name": "E"}}, "edges": []}})
    write(tmp_path / "an/analysis_2.json", {"article": {"document_id": "d2"}, "prompt_chain": [
        {"name": "Node Extraction", "response": 'ok [{"id": 7, "node_type": "actor", "name": "N"}]'},
        {"name": "Edge Extraction", "response": 'ok [{"source_id": 7, "relation": "r", "target_id": 7}]'}]})
    write(tmp_path / "an/analysis_3.json", "{broken")
    write(tmp_path / "an/other.json", {})
    good, corrupt = files.read_analyses(spark, str(tmp_path / "an"))
    filled = {r.analysis_id: r for r in files.payload_from_answers(good).collect()}
    assert set(filled) == {"a", "analysis_2"}
    assert filled["a"].kg_payload.nodes[0].id == "1"
    assert filled["analysis_2"].kg_payload.nodes[0].name == "N" and filled["analysis_2"].kg_payload.edges[0].relation == "r"
    assert [r.file_name for r in corrupt.collect()] == ["analysis_3.json"]
    late, _ = files.read_analyses(spark, str(tmp_path / "an"), modified_after="2999-01-01T00:00:00")
    assert late.count() == 0


def test_build_from_files(spark, tmp_path):
    for i, name in enumerate(["kg_analysis_1", "analysis_1"]):
        write(tmp_path / f"an/{name}.json", {"article": {"document_id": f"d{i}", "source": "S", "published": f"2025-01-0{i + 1}"},
              "kg_payload": {"nodes": [{"id": 1, "node_type": "event", "name": f"Event {'alpha' if i else 'omega'}"}], "edges": []}})
    target = str(tmp_path / "graph")
    built, stats = gb.build_from_files(spark, str(tmp_path / "an"), target, "g1")
    facts = {(r.section, r.name): r.value for r in stats.collect()}
    assert facts[("graph", "node_count")] == 3 and facts[("relation", "precedes")] == 1
    nodes, edges, meta = sinks.read_graph(spark, target)
    assert meta.first().node_count == nodes.count() == 3
    assert spark.read.parquet(f"{target}/versions").count() == 2
    assert built.edges.count() == edges.count() == 2


def test_graph_files_and_taxonomy(spark, tmp_path):
    write(tmp_path / "g.json", {"metadata": {"graph_id": "g", "provenance_chain": [{"operation": "initialize", "timestamp": "t"}]},
          "nodes": {"node_7": {"type": "actor", "name": "A"}}, "edges": [{"id": "edge_3", "source": "node_7", "target": "node_7", "relation": "r"}, {"source": "", "target": "x"}]})
    nodes, edges, log = files.read_graph_file(spark, str(tmp_path / "g.json"))
    assert nodes.first().node_id == "node_7" and [e.edge_id for e in edges.collect()] == ["edge_3"] and log.count() == 1
    write(tmp_path / "d/nodes/node_12.json", {"type": "actor", "name": "A"})
    write(tmp_path / "d/nodes/node_9.json", {"name": "B"})
    write(tmp_path / "d/edges/edge_1.json", {"source_id": "node_9", "target_id": "node_12", "relation": "r"})
    nodes, edges = files.read_graph_dir(spark, str(tmp_path / "d"))
    assert {n.type for n in nodes.collect()} == {"actor", "unknown"} and edges.first().dst == "node_12"
    assert files.highest_suffix(nodes, "node_id").first().highest == 12
    write(tmp_path / "t.csv", "taxonomy_type,name,domain_range,key_attributes,examples\nnode,actor,,a; b,x\nrelation,performs,actor → event,,\nrelation,bad,actor,,\n,none,,,\n")
    declared, mapped = files.read_taxonomy(spark, str(tmp_path / "t.csv"))
    assert {r.name for r in declared.collect()} == {"actor", "performs"}
    assert [tuple(r) for r in mapped.collect()] == [("actor", "performs", ["event"])]


def test_feeds_and_sitemap(spark, tmp_path):
    write(tmp_path / "fr/p1.json", {"results": [{"title": "T", "html_url": "u", "abstract": None, "publication_date": "2025-01-01"}, {"title": "T2", "html_url": "u2"}]})
    write(tmp_path / "wh/p1.json", [{"title": {"rendered": "A"}, "link": "https://w/presidential-actions/1", "excerpt": {"rendered": "<p>Hi &amp; bye</p>"}, "date": "d"}, {"link": "https://w/news"}])
    write(tmp_path / "bi/p1.json", {"packages": [{"title": "B", "packageLink": "l", "lastModified": "m"}]})
    assert feeds.register(spark, str(tmp_path / "fr")).count() == 2
    assert feeds.register(spark, str(tmp_path / "fr"), limit=1).first().url == "u"
    a = feeds.actions(spark, str(tmp_path / "wh")).collect()
    assert [(r.title, r.content, r.source) for r in a] == [("A", "Hi & bye", "White House")]
    assert tuple(feeds.bills(spark, str(tmp_path / "bi")).first()) == ("B", "l", "", "m", "Congress.gov")
    write(tmp_path / "s.xml", "<urlset><url><loc> https://x/a </loc><lastmod>2025-01-02</lastmod></url><url><loc>https://x/b</loc></url><url><lastmod>2025</lastmod></url><url><loc>https://x/c</loc><lastmod>2025-03-02T00:00:00Z</lastmod></url></urlset>")
    urls = files.read_sitemap(spark, str(tmp_path / "s.xml"))
    assert [r.loc for r in ing.sitemap_newest_first(urls).collect()] == ["https://x/c", "https://x/a", "https://x/b"]
    kept = co.screen_sitemap(urls, dt.datetime(2025, 2, 1), dt.datetime(2025, 12, 1))
    assert {r.loc for r in kept.collect()} == {"https://x/c", "https://x/b"}


def test_idempotent_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "doc_id string, content string")
    path = str(tmp_path / "docs")
    for _ in range(2):
        sinks.store_documents(docs, path)
    assert spark.read.parquet(path).count() == 2
    sinks.write_cursor(spark, str(tmp_path / "cursor"), "2025-01-01")
    assert sinks.read_cursor(spark, str(tmp_path / "cursor")) == "2025-01-01"
    assert sinks.read_cursor(spark, str(tmp_path / "none")) is None
    sinks.create_event_store(spark, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/events")).count() == 0


@pytest.mark.parametrize("change", [None, "content", "metadata", "signature"])
def test_signatures(spark, tmp_path, change):
    key = b"k" * 32
    docs = spark.createDataFrame([("a", "text", '{"m":1}'), ("e", "", "{}")], "doc_id string, content string, metadata string")
    signed = ln.sign(docs, key, F.lit("t"))
    if change in ("content", "metadata"):
        docs = docs.withColumn(change, F.concat(change, F.lit("!")))
    if change == "signature":
        signed = signed.withColumn("signature", F.concat(F.substring("signature", 1, 63), F.lit("x")))
    got = {r.doc_id: r.verified for r in ln.verify(docs, signed, key).collect()}
    assert got == {"a": change is None, "e": False}
    failed = sinks.import_verified(docs, signed, str(tmp_path / "repo"), key)
    assert failed.count() == (1 if change is None else 2)


def test_signed_records(spark):
    rows = spark.createDataFrame([("a", ["d1"], "t", "{}", '{"x":1}', "2025")], "analysis_id string, document_ids array<string>, analysis_type string, parameters string, result_json string, timestamp string")
    rec = sinks.analysis_record(rows, b"k")
    assert ln.verify_records(rec, b"k").first().verified and not ln.verify_records(rec, b"z").first().verified


def test_version_chain(spark):
    v = "package string, version string, hash string, previous_version string, previous_hash string, genesis boolean"
    rows = [("p", "v001", "h1", None, None, True), ("p", "v002", "h2", "v001", "h1", False), ("p", "v004", "h4", "v002", "h2", False), ("q", "v001", "h", None, None, False)]
    got = {(r.package, r.version): r.ok for r in ln.audit_versions(spark.createDataFrame(rows, v)).collect()}
    assert got == {("p", "v001"): True, ("p", "v002"): True, ("p", "v004"): False, ("q", "v001"): False}
    hist = spark.createDataFrame([("v001", True, 1), ("v007", False, 2)], "version string, success boolean, time long")
    assert ln.next_package_version(hist).first().version == "v002"
    assert ln.next_package_version(hist.where("false")).first().version == "v001"


def test_update(spark, tmp_path):
    folder = tmp_path / "in"
    graph = {"metadata": {"graph_id": "g"}, "nodes": {"n1": {"type": "a", "name": "A"}, "n2": {"type": "a", "name": "B"}}, "edges": [{"id": "e", "source": "n1", "target": "n2", "relation": "r"}]}
    write(folder / "graph/graph.json", graph)
    write(folder / "graph/graph_provenance.json", {"graph_id": "g"})
    manifest = files.file_manifest(spark, str(folder)).select("path", F.concat(F.lit("sha256:"), "sha256").alias("sha256"))
    manifest = spark.createDataFrame(manifest.collect(), "path string, sha256 string")
    assert {r.path for r in manifest.collect()} == {"graph/graph.json", "graph/graph_provenance.json"}
    nodes, edges, _ = files.read_graph_file(spark, str(folder / "graph/graph.json"))
    own = str(tmp_path / "own")
    sinks.write_graph(nodes.where("node_id = 'n1'"), edges.where("false"), spark.range(1), own)
    out = ex.apply_update(spark, str(folder), manifest, own, str(tmp_path / "repo"), None, None, b"k", str(tmp_path / "merged"))
    assert out["applied"] and spark.read.parquet(str(tmp_path / "merged/nodes")).count() == 2
    versions = spark.createDataFrame([("p", "v001", "h", None, None, True)], "package string, version string, hash string, previous_version string, previous_hash string, genesis boolean")
    assert ex.accept_artifact(spark, str(folder), manifest, versions, "p", "v001", str(tmp_path / "hist"))
    write(folder / "graph/graph_provenance.json", {"graph_id": "other"})
    assert ex.apply_update(spark, str(folder), manifest, own, "r", None, None, b"k", "t") == {"applied": False, "reason": "manifest"}
    assert not ex.accept_artifact(spark, str(folder), manifest, versions, "p", "v001", str(tmp_path / "hist"))


def test_cite_cascade(spark):
    docs = spark.createDataFrame([("d", "The quick brown fox. Doctor Smith ran; he was fast")], "doc_id string, content string")
    items = spark.createDataFrame(
        [("1", "d", "edge", "QUICK brown", None), ("2", "d", "edge", "smith ran he", None), ("3", "d", "node", None, "John Smith"),
         ("4", "d", "edge", "quick brawn fox", None), ("5", "d", "fact", "zzzz", None), ("6", "d", "node", "zzzzzzzz", "fox")],
        "item_id string, doc_id string, kind string, text string, name string",
    )
    cited = ci.cite(items, docs)
    got = {r.item_id: (r.citation.match_type if r.citation else None) for r in cited.collect()}
    assert got == {"1": "exact", "2": "normalized", "3": "partial", "4": "fuzzy", "5": None, "6": "exact"}
    s = ci.citation_summary(cited, ["doc_id"]).first()
    assert (s.total_citations, s.exact_matches, s.fuzzy_matches, s.unmatched) == (6, 2, 3, 1)
    two = ci.merge_summaries(ci.citation_summary(cited, ["doc_id"]).union(ci.citation_summary(cited.where("item_id = '1'"), ["doc_id"])), ["doc_id"]).first()
    assert two.total_citations == 7 and abs(two.avg_confidence - (s.avg_confidence * 6 + 1) / 7) < 1e-12


def test_vector_modes(spark):
    rows = [(i, "b" if i in (5, 9) else "a", [float(i), 0.0]) for i in range(12)]
    v = spark.createDataFrame(rows, "item_id long, item_type string, embedding array<float>")
    ids = lambda df: [r.item_id for r in df.collect()]
    assert ids(ve.search(v, [0.0, 0.0], 2, "b")) == [5, 9]
    assert ve.search(v, [1.0, 0.0], 1).first().score == 1.0
    assert ids(ve.similar_to_item(v, 3, 3)) == [2, 4, 1]
    assert ids(ve.similar_to_item(v, 77, 3)) == []
    odd = spark.createDataFrame([(50, "a", None), (51, "a", [0.0]), (52, "a", [0.0, None])], v.schema)
    assert ids(ve.search(v.union(odd), [0.0, 0.0], 2)) == [0, 1]


@pytest.mark.parametrize("size", [384, 768, 1536])
def test_wide_vectors(spark, size):
    rows = [(i, "a", [float(i)] * size) for i in range(4)]
    v = spark.createDataFrame(rows, "item_id long, item_type string, embedding array<float>")
    got = ve.search(v, [1.0] * size, 3).collect()
    assert [(r.item_id, r.distance) for r in got] == [(1, 0.0), (0, float(size)), (2, float(size))]


def test_annotate_isolates_failures(spark):
    docs = spark.createDataFrame([("d1", "one"), ("d2", "bad"), ("d3", "three")], "doc_id string, content string")

    def stub(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no answer")
        return prompts.map(lambda p: f"hm</think>{p.upper()}")

    t = an.Template("t", [an.Round("first", "say {content}"), an.Round("second", "{first}!")], status="PRODUCTION")
    got = {r.doc_id: r.rounds for r in an.annotate(docs, t, stub).collect()}
    assert got["d1"][1].response == "SAY ONE!" and got["d1"][1].error is None
    assert got["d2"][0].error == "no answer" and got["d2"][0].response.startswith("ERROR")
    assert an.annotate_all(docs, [t, an.Template("u", t.rounds)], stub).count() == 6
    assert an.trial(docs, "d3", t, stub).count() == 1


def test_schemas_parse(spark):
    for ddl in (schemas.ANALYSES, schemas.GRAPH_FILE, schemas.FEED_ENTRIES, *schemas.EVENT_STORE.values()):
        assert spark.createDataFrame([], ddl).columns
