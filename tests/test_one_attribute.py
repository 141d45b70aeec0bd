"""One merged attribute, and merged attributes as rows, without building maps."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from eventloom.functions import maps
from eventloom.operators import events as ev

ROWS = [
    ("k", 1, {"a": "x", "b": "y"}), ("k", 2, {"a": "z"}), ("k", 2, {"a": "w"}), ("k", 3, {"c": None}), ("n", 1, None), ("e", 1, {}),
    ("l", 1, {"a": "x"}), ("l", 2, {"a": None}), ("o", 1, {"b": "y"}), ("o", None, {"a": "u"}), (None, 3, {"a": "q"}),
]


def test_equal_to_merged_maps(spark):
    df = spark.createDataFrame(ROWS, "k string, s long, m map<string,string>")
    merged = maps.merge_maps(df, ["k"], "m", F.col("s"), True)
    for name in ("a", "b", "c", "d"):
        want = merged.select("k", F.try_element_at("m", F.lit(name)).alias(name))
        got = maps.last_value(df, ["k"], "m", name, F.col("s"))
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    for last in (True, False):
        want = maps.merge_maps(df, ["k"], "m", F.col("s"), last).select("k", F.explode("m").alias("key", "value"))
        got = maps.merged_entries(df, ["k"], "m", F.col("s"), last, "key", "value")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_operators_agree(spark):
    nodes = spark.createDataFrame([(a, "part", n, s, m) for a, n, s, m in (
        ("1", "Nut", 1, {"brand": "x", "kind": "k"}), ("1", "nut", 2, {"kind": "l"}), ("2", "NUT", 3, {"brand": "y"}), ("2", "Bolt", 4, {"kind": "k"}),
    )], "analysis_id string, node_type string, name string, node_seq long, attributes map<string,string>")
    groups = spark.createDataFrame([("v", "1"), ("v", "2"), ("w", "1")], "event_key string, analysis_id string")
    brands = {(r.event_key, r.lname): r.brand for r in ev.event_node_attribute(groups, nodes, "brand").collect()}
    assert brands == {("v", "nut"): "y", ("v", "bolt"): None, ("w", "nut"): "x"}
    merged = {(r.event_key, r.lname): r.attributes for r in ev.event_node_attributes(groups, nodes).collect()}
    rows = {}
    for r in ev.event_node_attribute_rows(groups, nodes).collect():
        rows.setdefault((r.event_key, r.lname), {})[r.attribute] = r.value
    assert rows == merged and brands == {k: m.get("brand") for k, m in merged.items()}


def test_queries_build_no_maps_to_take_apart(spark, sf):
    for name in ("event_node_attributes", "event_node_attributes_all"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "map_from_entries" not in plan
    brand = entry.queries()["event_node_attributes"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(attributes" not in brand
