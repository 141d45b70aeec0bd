"""Queries without a filter on node type or kind hold what the filtered ones hold, and the rest."""

import __spark_entry__ as entry


def _rows(spark, sf, name):
    return entry.queries()[name](spark, sf)


def _set(df):
    return sorted(map(tuple, df.collect()))


def test_event_node_attributes(spark, sf):
    whole = _rows(spark, sf, "event_node_attributes_all").cache()
    assert {"part", "supplier"} <= {r[0] for r in whole.select("node_type").distinct().collect()}
    brands = whole.where("node_type = 'part' and attribute = 'brand'").select("event_key", "node_type", "lname", "value")
    assert _set(brands) == _set(_rows(spark, sf, "event_node_attributes").where("brand is not null"))


def test_attributes_first_wins(spark, sf):
    whole = _rows(spark, sf, "attributes_first_wins_all").cache()
    assert {"part", "supplier"} <= {r[0] for r in whole.select("node_type").distinct().collect()}
    kinds = whole.where("node_type = 'part' and attribute = 'kind'").select("node_type", "lname", "value", "last_value")
    assert _set(kinds) == _set(_rows(spark, sf, "attributes_first_wins").where("kind is not null").select("node_type", "lname", "kind", "last_kind"))


def test_citations(spark, sf):
    whole = _rows(spark, sf, "citation_all_kinds").cache()
    assert {r[0] for r in whole.select("kind").distinct().collect()} == {"edge", "fact", "node"}
    assert _set(whole.where("kind = 'edge'").drop("kind")) == _set(_rows(spark, sf, "citation_exact"))
