"""What the join of order lines carries."""

from pyspark.sql import functions as F

from eventloom.sources import tables as t


def test_names_are_joined_after_orders(spark, sf):
    lines = t.kg_nodes(spark, sf).where(F.col("node_type") == "part")
    joins = lines._jdf.queryExecution().optimizedPlan().toString()
    assert joins.rindex("= o_orderkey") > joins.rindex("= p_partkey")  # deeper in the tree
