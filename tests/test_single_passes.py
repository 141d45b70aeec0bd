"""Steps that were computed twice, or shuffled a row for every date."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventloom.functions import maps
from eventloom.operators import events as ev


def test_first_and_last_map(spark):
    rows = [("k", 1, {"a": "x", "b": "y"}), ("k", 2, {"a": "z"}), ("k", 2, {"a": "w"}), ("n", 1, None), (None, 3, {"a": "q"}), ("k", 3, {"c": None})]
    df = spark.createDataFrame(rows, "k string, s long, m map<string,string>")
    got = {r.k: (r.first, r.last) for r in maps.first_and_last(df, ["k"], "m", F.col("s")).collect()}
    for place, last in ((0, False), (1, True)):
        alone = {r.k: r.m for r in maps.merge_maps(df, ["k"], "m", F.col("s"), last).collect()}
        assert {k: v[place] for k, v in got.items()} == alone
    assert got["k"][0]["a"] == "x" and got["k"][1]["a"] == "z"


def test_attributes_read_lines_once(spark, sf):
    plan = entry.queries()["attributes_first_wins_all"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/lineitem.parquet") == 1


def test_merge_reads_written_graph(spark, sf):
    plan = entry.queries()["graph_merge"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan


def test_edge_names_come_with_the_edges(spark, sf):
    plan = entry.queries()["edge_upsert"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_names_are_not_shuffled_by_date(spark):
    nodes = spark.createDataFrame([("p", "A", None, 1), ("p", "a", "d2", 2), ("p", "B", "d1", 3), ("p", "B", "d0", 4), (None, "B", "d", 5)],
                                  "node_type string, name string, timestamp string, node_seq long")
    names = ev.node_names(nodes)
    assert sorted(map(tuple, names.collect()), key=str) == sorted(
        [("p", "a", "A", "N/A"), ("p", "b", "B", "d1"), (None, "b", "B", "d")], key=str)
    # where the date is not read, nothing is kept of it
    assert "timestamp" not in names.select("lname", "name")._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_further_sources_look_no_names_up(spark, sf):
    plan = entry.queries()["node_further_sources"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
