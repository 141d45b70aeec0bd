"""Counts of nodes and edges from one placement by analysis."""

import __spark_entry__ as entry
from eventloom.operators import events as ev
from eventloom.operators import graph as g
from eventloom.sources import tables as t

NODES = [
    ("a", "1", "actor", "Ann", 1), ("a", "1", "actor", "Anna", 5), ("a", "2", "event", "Vote", 2), ("a", None, "event", "None", 3),
    ("b", "1", "actor", "Bob", 7), (None, "1", "actor", "Nobody", 8), ("b", "2", None, "Loose", 9), ("b", "3", "actor", "ANN ", 10),
    ("b", "4", "actor", " ", 11),
]
EDGES = [("a", "1", "does", "2"), ("a", "1", "does", "2"), ("a", "2", "by", "1"), ("a", "1", "is", "1"), ("a", "1", "does", "9"),
         ("a", None, "does", "2"), ("b", "1", "does", "2"), ("b", "1", None, "3"), ("b", "1", "unknown", "3"), ("b", "4", "does", "1"),
         ("c", "1", "does", "2"), (None, "1", "does", "1")]


def frames(spark):
    nodes = spark.createDataFrame(NODES, "analysis_id string, local_id string, node_type string, name string, node_seq long")
    edges = spark.createDataFrame(EDGES, "analysis_id string, source_id string, relation string, target_id string")
    return nodes, edges


def facts(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_graph_statistics_from_one_placement(spark):
    nodes, edges = frames(spark)
    named = g.named_nodes(nodes, g.plain_id)
    keys = g.link_edges(edges, named).select("src", "relation", "dst").distinct()
    apart = g.graph_statistics(g.exact_entities(nodes).withColumnRenamed("node_type", "type"), keys)
    got = facts(g.named_graph_statistics(edges, named))
    assert got == facts(apart) and ("node_type", "actor", 4.0) in got and ("relation", "unknown", 2.0) in got
    none = facts(g.named_graph_statistics(edges.limit(0), named.limit(0)))
    assert none == [("graph", "density", 0.0), ("graph", "edge_count", 0.0), ("graph", "node_count", 0.0)]


def test_graph_stats_reads_nodes_once(spark, sf):
    plan = entry.queries()["graph_stats"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/lineitem.parquet") == 2 and plan.count("/part.parquet") == 1  # once for nodes, once for edges
    assert "/step-" not in plan


def test_batch_stats_from_one_placement(spark):
    nodes, edges = frames(spark)
    nodes, edges = nodes.selectExpr("*", "1.0D as confidence"), edges.selectExpr("*", "1.0D as confidence")
    groups = spark.createDataFrame([("v", "a", "d", 1), ("w", "a", "e", 2), ("w", "x", "e", 1), ("w", None, None, 1)],
                                   "event_key string, analysis_id string, document_id string, n_mentions long")
    en = ev.event_nodes(ev.event_node_sources(groups, nodes))
    ee = ev.event_edges(ev.event_edge_sources(groups, ev.resolve_edges(edges, nodes)))
    apart = ev.unified_stats(ev.unified_nodes(en), ev.unified_edges(ee), ev.group_members(groups))
    assert facts(ev.batch_stats(groups, edges, nodes)) == facts(apart) == [(4, 3, 2, 2)]
    assert facts(ev.batch_stats(groups.limit(0), edges, nodes)) == [(0, 0, 0, 0)]


def test_unified_stats_reads_nodes_once(spark, sf):
    plan = entry.queries()["unified_stats"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/lineitem.parquet") == 2 and plan.count("/part.parquet") == 1


def test_values_of_both_ends_are_sent_once(spark):
    nodes, edges = frames(spark)
    sent = ev.resolve_edges(edges, nodes)._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert sent.count("lower(") == 1 and sent.count("null AS target_id") == sent.count("AS target_id") == 1


def test_batch_edges_sent_once(spark):
    nodes, edges = frames(spark)
    nodes, edges = nodes.selectExpr("*", "1.0D as confidence"), edges.selectExpr("*", "IF(target_id = '2', 0.25D, null) as confidence")
    groups = spark.createDataFrame([("v", "a", "d", 1), ("w", "a", "e", 2), ("w", "b", "e", 3), ("w", "x", "e", 1), (None, "b", None, 1)],
                                   "event_key string, analysis_id string, document_id string, n_mentions long")
    sources = ev.event_edge_sources(groups, ev.resolve_edges(edges, nodes))
    got = ev.batch_unified_edges(sources)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning" in line and "src_name" in line for line in plan.splitlines()) == 1
    assert facts(got) == facts(ev.unified_edges(ev.event_edges(sources))) and got.count() == 7
    assert ("actor", "anna", "does", "event", "vote", 1.5, 2) in facts(got)


def test_unified_edges_places_lines_not_their_nodes(spark, sf):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["unified_edges"](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    above = [plan[i - 1] for i, line in enumerate(plan) if line.lstrip(" :+-").startswith("Union")]
    assert above and not any("Exchange" in line for line in above)
    assert sum("Exchange hashpartitioning" in line and "src_name" in line for line in plan) == 1


def test_placed_frames_hold_the_same_rows(spark, sf):
    for frame in (t.kg_nodes, t.kg_edges):
        apart, placed = frame(spark, sf), frame(spark, sf, placed=True)
        assert placed.columns == apart.columns
        text = lambda rows: rows.selectExpr("to_json(struct(*)) as row")
        assert text(placed).exceptAll(text(apart)).isEmpty() and text(apart).exceptAll(text(placed)).isEmpty()
