"""Lookups of both ends of an edge: one exchange, the last node of a local id, nothing else."""

from eventloom.operators import events as ev
from eventloom.operators import graph as g
from eventloom.sources import tables as t

NODES = [
    ("a", "1", "actor", "Ann", 1), ("a", "1", "actor", "Anna", 5), ("a", "2", "event", "Vote", 2), ("a", None, "event", "None", 3),
    ("b", "1", "actor", "Bob", 7), (None, "1", "actor", "Nobody", 8), ("b", "2", None, "Loose", 9),
]
EDGES = [("a", "1", "does", "2", 1), ("a", "2", "by", "1", 2), ("a", "1", "is", "1", 3), ("a", "1", "does", "9", 4), ("a", None, "does", "2", 5),
         ("b", "1", "does", "2", 6), ("c", "1", "does", "2", 7), (None, "1", "does", "1", 8), ("a", "1", "does", "2", 1)]


def frames(spark):
    nodes = spark.createDataFrame(NODES, "analysis_id string, local_id string, node_type string, name string, node_seq long")
    edges = spark.createDataFrame(EDGES, "analysis_id string, source_id string, relation string, target_id string, edge_seq long")
    return nodes, edges


def test_last_node_of_a_local_id(spark):
    nodes, edges = frames(spark)
    got = ev.resolve_edges(edges, nodes).select("edge_seq", *ev.EDGE_KEY).collect()
    assert sorted(map(tuple, got), key=str) == [
        (1, "actor", "anna", "does", "event", "vote"), (1, "actor", "anna", "does", "event", "vote"),
        (2, "event", "vote", "by", "actor", "anna"), (3, "actor", "anna", "is", "actor", "anna"),
        (6, "actor", "bob", "does", None, "loose"),
    ]
    linked = g.link_edges(edges, g.named_nodes(nodes, g.plain_id), ("node_seq",)).select("edge_seq", "src.name", "dst.type", "node_seq")
    assert (2, "vote", "actor", 2) in [tuple(r) for r in linked.collect()] and linked.count() == 5


def test_one_exchange(spark):
    nodes, edges = frames(spark)
    by_analysis = ev.resolve_edges(edges, nodes).groupBy("analysis_id", *ev.EDGE_KEY).count()
    assert by_analysis._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_joins_carry_only_what_is_read(spark, sf):
    for df, unread in ((t.kg_nodes(spark, sf).select("analysis_id", "name"), ("p_brand", "l_discount", "o_orderdate", "c_mktsegment")),
                       (t.kg_edges(spark, sf).select("analysis_id", "target_id"), ("l_discount", "l_returnflag", "o_orderpriority"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        columns = [line for line in plan.splitlines() if "Project [" in line]
        assert columns and not any(c in line for c in unread for line in columns)
