import datetime as dt
import itertools
import random

from fixtures import analyses_frame, edge, node, two_stage_rows
from pyspark.sql import functions as F

from eventloom.operators import equivalence as eq
from eventloom.operators import graph as g
from eventloom.operators import matching
from eventloom.plans import aggregation as agg
from eventloom.plans import graph_build as gb


def brute_resolve(names):
    """names in insertion order -> leader of each, by direct comparison."""
    leaders, out = [], {}
    for kind, name in names:
        for lk, ln in leaders:
            longer, shorter = max(len(ln), len(name)), min(len(ln), len(name))
            if lk == kind and (ln == name or ((name in ln or ln in name) and longer / shorter <= 1.5)):
                out[(kind, name)] = ln
                break
        else:
            leaders.append((kind, name))
            out[(kind, name)] = name
    return out


def test_entity_resolution_equals_brute_force(spark):
    rnd = random.Random(7)
    names = list(dict.fromkeys(
        (rnd.choice(["actor", "place"]), "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9)))) for _ in range(300)
    ))
    df = spark.createDataFrame([(k, f" {n.upper()} ", i) for i, (k, n) in enumerate(names)], "node_type string, name string, node_seq long")
    want = brute_resolve(names)
    ids = {r.node_id: r.norm for r in g.exact_entities(df).collect()}
    got = {(r.node_type, r.norm): ids[r.node_id] for r in g.resolve_entities(df).collect()}
    assert got == want


def test_existing_nodes_stand(spark):
    old = spark.createDataFrame([("a", "Biden", 5, "node_1"), ("a", "Joe Biden", 6, "node_2")], "node_type string, name string, node_seq long, node_id string")
    new = spark.createDataFrame([("a", "bidens", 0), ("a", "obama", 1), ("b", "Biden", 2)], "node_type string, name string, node_seq long")
    got = {(r.node_type, r.norm): r.node_id for r in g.resolve_entities(new, old).collect()}
    assert got[("a", "bidens")] == "node_1" and got[("a", "joe biden")] == "node_2"
    assert got[("a", "obama")] not in ("node_1", "node_2") and got[("b", "biden")] != "node_1"


def test_components_equal_brute_force(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(60, 90)] + [(100, i) for i in range(101, 130)]
    label = list(range(130))
    for _ in range(130):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = matching.components(spark.range(130), spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == dict(enumerate(label))


def rows_for_upsert():
    return [
        {"analysis_id": "a1", "article": {"document_id": "d1", "source": "CNN", "published": "2025-01-01"},
         "kg_payload": {"nodes": [node(1, "actor", "Bob", attributes={"x": "1"}, sentence="s1"), node(2, "event", "Fire", timestamp="2025-01-02"), node(3, "", "none")],
                        "edges": [edge(1, "performs", 2, quote="q1"), edge(1, "performs", 9), edge(1, "", 2)]}},
        {"analysis_id": "a2", "article": {"document_id": "d2", "source": "CNN"},
         "kg_payload": {"nodes": [node(1, "actor", "BOB", attributes={"x": "2", "y": "2"}, sentence="s2"), node(2, "event", "Fires", timestamp="2025-01-09")],
                        "edges": [edge(1, "performs", 2, quote="q2"), edge(1, "sees", 2)]}},
    ]


def test_graph_build(spark):
    built = gb.build_graph(analyses_frame(spark, rows_for_upsert()), temporal=False)
    nodes = {r.name: r for r in built.nodes.collect()}
    assert set(nodes) == {"Bob", "Fire", "CNN"}
    assert nodes["Bob"].attributes == {"x": "1", "y": "2"} and nodes["Bob"].document_id == "d1"
    assert nodes["CNN"].type == "media_outlet" and nodes["Fire"].timestamp == "2025-01-02"
    more = built.further_sources.join(built.nodes.select("node_id", "name"), "node_id").collect()
    assert {(r.name, r.document_id, r.sentence) for r in more} == {("Bob", "d2", "s2"), ("Fire", "d2", None), ("CNN", "d2", None)}
    edges = {(r.relation): r for r in built.edges.collect()}
    assert set(edges) == {"performs", "sees"} and edges["performs"].mentions == 2 and edges["performs"].evidence_quote == "q1"
    assert [r.quote for r in built.further_evidence.collect()] == ["q2"]


def test_digraph_keeps_last_relation(spark):
    linked = spark.createDataFrame([("a", "r1", "b", 1, "q"), ("a", "r2", "b", 2, "q"), ("a", "r1", "c", 3, "q")], "src string, relation string, dst string, edge_seq long, evidence_quote string")
    got, _ = g.upsert_edges(linked, digraph=True)
    assert {(r.src, r.relation, r.dst) for r in got.collect()} == {("a", "r2", "b"), ("a", "r1", "c")}


def stamps(spark, days):
    rows = [(f"n{i}", (dt.date(2024, 1, 1) + dt.timedelta(d)).isoformat(), i) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "node_id string, timestamp string, seq long"), [d for d in days]


def test_temporal_fixture(spark):
    df, _ = stamps(spark, [0, 0, 3, 31, 40, 75])
    pairs = {(r.earlier, r.later, r.days_between) for r in g.temporal_pairs(df, []).collect()}
    assert pairs == {("n0", "n2", 3), ("n1", "n2", 3), ("n2", "n3", 28), ("n3", "n4", 9)}
    linked = spark.createDataFrame([("n4", "n3")], "src string, dst string")
    edges = g.temporal_edges(g.temporal_pairs(df, [], linked), []).collect()
    assert len(edges) == 6 and {e.relation for e in edges} == {"precedes", "follows"}
    assert ("n3", "n4") not in {(e.src, e.dst) for e in edges}


def test_temporal_equals_brute_force_with_crowded_days(spark):
    rnd = random.Random(5)
    days = [rnd.choice([0, 0, 0, 0, 1, 1, 2, 9, 50, 51]) for _ in range(60)]
    df, _ = stamps(spark, days)
    line = sorted(range(60), key=lambda i: (days[i], i))
    want = set()
    for p, i in enumerate(line):
        for j in line[p + 1 : p + 5]:
            if 0 < days[j] - days[i] <= 30:
                want.add((f"n{i}", f"n{j}"))
    assert {(r.earlier, r.later) for r in g.temporal_pairs(df, []).collect()} == want


def plain(spark, nodes, edges):
    return spark.createDataFrame(nodes, "node_id string, type string"), spark.createDataFrame(edges, "src string, relation string, dst string")


def test_merge_twice_adds_nothing_and_hash_ignores_order(spark):
    n, e = plain(spark, [("a", "x"), ("b", "y")], [("a", "r", "b")])
    on, oe = plain(spark, [("b", "z"), ("c", "y")], [("a", "q", "b"), ("b", "r", "c")])
    mn, me = g.merge_graphs(n, e, on, oe)
    assert {tuple(r) for r in mn.collect()} == {("a", "x"), ("b", "y"), ("c", "y")}
    assert {tuple(r) for r in me.select("src", "relation", "dst").collect()} == {("a", "r", "b"), ("b", "r", "c")}
    again_n, again_e = g.merge_additions(mn, me, on, oe)
    assert again_n.count() == 0 and again_e.count() == 0
    h = g.graph_hash(mn, me.select("src", "relation", "dst")).first()[0]
    assert h == g.graph_hash(mn.orderBy("type").repartition(3), me.select("relation", "dst", "src")).first()[0]
    assert h != g.graph_hash(n, e).first()[0]


def test_statistics_and_taxonomy(spark):
    n, e = plain(spark, [("a", "x"), ("b", "y"), ("c", None)], [("a", "r", "b"), ("b", "r", "c")])
    facts = {(r.section, r.name): r.value for r in g.graph_statistics(n, e).collect()}
    assert facts[("graph", "density")] == 2 / 6 and facts[("node_type", "unknown")] == 1 and facts[("relation", "r")] == 2
    empty_n, empty_e = plain(spark, [], [])
    facts = {(r.section, r.name): r.value for r in g.graph_statistics(empty_n, empty_e).collect()}
    assert facts == {("graph", "node_count"): 0, ("graph", "edge_count"): 0, ("graph", "density"): 0.0}
    tax = spark.createDataFrame([("node", "x"), ("relation", "r")], "kind string, name string")
    assert {r.name for r in g.undeclared_types(n, e, tax).collect()} == {"y", None}


def provenance_rows():
    return [
        {"analysis_id": "a1", "article": {"document_id": "1", "domain": "a.com"},
         "kg_payload": {"nodes": [node("1", "event", "Launch", 0.9), node("2", "actor", "NASA", 0.5)], "edges": [edge("2", "performs", "1", 0.4)]}},
        {"analysis_id": "a2", "article": {"document_id": "2", "domain": "b.com"},
         "kg_payload": {"nodes": [node("1", "actor", "Other"), node("2", "event", "Launch", 0.8)], "edges": [edge("2", "hurts", "2")]}},
    ]


def test_equivalence_sets(spark):
    batch = agg.provenance_batch(analyses_frame(spark, provenance_rows()))
    sets = {r.canonical_name: r for r in batch.sets.collect()}
    assert round(sets["launch"].aggregate_weight, 6) == 1.7 and sets["other"].aggregate_weight == 1.0
    c = {r.canonical_name: r for r in eq.corroboration(batch.members).collect()}["launch"]
    assert (c.corroboration_count, c.source_diversity) == (2, 2)
    rel = batch.relationships.collect()
    assert [(r.src_name, r.dst_name, r.total_weight) for r in rel] == [("nasa", "launch", 0.4)]
    look = eq.relationship(batch.members, batch.evidence.drop("src_type", "src_name", "dst_type", "dst_name"), "LAUNCH", "Nasa").collect()
    assert [(r.src_name, r.dst_name) for r in look] == [("nasa", "launch")]
    assert eq.entity(batch.members, "nobody").count() == 0


def test_fold_unified(spark):
    a = analyses_frame(spark, two_stage_rows())
    built = gb.build_graph(a, temporal=False)
    nodes, edges = gb.fold_unified(built.nodes, built.edges, agg.aggregate_events(a))
    got = {r.name: r for r in nodes.collect()}
    assert len(got) == built.nodes.count()
    assert got["President Biden"].attributes["event_appearances"] == "1"
    assert edges.count() == built.edges.count()


def test_contained_pairs(spark):
    words = ["a", "ab", "bc", "abc", "xyz", "yz"]
    hays = ["abcab", "xyz", "", "b"]
    df = lambda c, v: spark.createDataFrame([("s", x) for x in v], f"scope string, {c} string")
    got = {(r.n, r.h) for r in matching.contained_pairs(df("n", words), df("h", hays), ["scope"], "n", "h").collect()}
    assert got == {(n, h) for n, h in itertools.product(words, hays) if n in h}


def test_version_log(spark):
    log = spark.createDataFrame([("g", "2024-01-02", "b", "h2"), ("g", "2024-01-01", "a", "h1"), ("k", "2024-01-01", "a", None)], "graph_id string, timestamp string, operation string, content_hash string")
    assert {(r.graph_id, r.operation): r.graph_version for r in g.version_rows(log).collect()} == {("g", "a"): 1, ("g", "b"): 2, ("k", "a"): 1}
    info = {r.graph_id: r for r in g.provenance_info(log).collect()}["g"]
    assert (info.update_count, info.content_hash) == (2, "h2")
    assert g.version_rows(log).withColumn("n", F.lit(1)).count() == 3
