"""Domain frames derived from the benchmark tables (whole tables, no subsets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event mentions with their observation fields, one per row of ``events``."""
    user, bias = F.col("user_id"), F.col("user_id") % 4
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("mention_seq"),
        F.concat(F.lit("an_"), user.cast("string")).alias("analysis_id"),
        F.concat(F.lit("doc_"), (F.col("event_id") % 200).cast("string")).alias("document_id"),
        F.concat(F.lit("User "), user.cast("string")).alias("actor"),
        F.col("event_type").alias("action"),
        F.concat(F.lit("User "), user.cast("string"), F.lit(" "), "event_type").alias("name"),
        F.date_format("ts", "yyyy-MM-dd").alias("date_raw"),
        F.concat(F.lit("loc "), F.get_json_object("props", "$.k")).alias("location"),
        F.concat(F.lit("src"), (user % 10).cast("string")).alias("source_name"),
        F.when(bias == 0, "left").when(bias == 1, "center").when(bias == 2, "right").alias("source_bias"),
        (F.col("value") / 500).alias("confidence"),
        "ts",
    )


def _order_lines(spark: SparkSession, sf_dir: str, placed: bool) -> DataFrame:
    """Order lines with the names they refer to. Orders are as long as lines, so their join always shuffles:
    it comes first, while rows are narrow, or last and by analysis, where rows are to lie by analysis."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))

    if placed:
        lines = named(lines).withColumn("analysis_id", _an("l_orderkey")).drop("l_orderkey")
        return lines.join(orders.withColumn("analysis_id", _an("o_orderkey")), "analysis_id")
    lines = named(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")))
    return lines.withColumn("analysis_id", _an("o_orderkey"))


def _an(c: str):
    return F.concat(F.lit("an_"), F.col(c).cast("string"))


def _doc(c: str):
    return F.concat(F.lit("doc_"), F.col(c).cast("string"))


def _lying(rows: DataFrame, placed: bool) -> DataFrame:
    """Rows by analysis if ``placed``, in the session's number of partitions: the adaptive planner would merge them by
    their size as lines, and what each then grows to would no longer sort in memory."""
    if not placed:
        return rows
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "analysis_id")


def _each(*values: str):
    """A row for each value."""
    return F.explode(F.array(*[F.lit(v) for v in values]))


def kg_nodes(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Graph payload nodes: an order is an analysis, its customer the document.

    With ``placed`` rows lie by analysis, as lookups of edge ends need them: they are sent there as order lines,
    before each becomes several nodes."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    node = (
        "analysis_id string, document_id string, node_seq bigint, local_id string, "
        "node_type string, name string, confidence double, timestamp string, "
        "attributes map<string,string>"
    )
    # a row for each type, whose columns are then told by the type: structs taken apart by ``inline`` would
    # bring all columns through the joins, also those that nobody reads
    kind = F.col("node_type")

    def text_map(*entries):
        return F.create_map(*entries).cast("map<string,string>")

    part = kind == "part"
    base = F.col("o_orderkey") * 100 + F.col("l_linenumber") * 2
    line_nodes = _order_lines(spark, sf_dir, placed).withColumn("node_type", _each("part", "supplier")).select(
        "analysis_id",
        _doc("o_custkey").alias("document_id"),
        (base + F.when(part, 2).otherwise(3)).alias("node_seq"),
        F.when(part, F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
        .otherwise(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("local_id"),
        kind,
        F.when(part, F.col("p_name")).otherwise(F.col("s_name")).alias("name"),
        (1 - F.col("l_discount")).alias("confidence"),
        day.alias("timestamp"),
        F.when(part, text_map(F.lit("brand"), "p_brand", F.lit("kind"), "p_type"))
        .otherwise(text_map(F.lit("flag"), "l_returnflag")).alias("attributes"),
    )
    orders = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"),
        F.col("o_custkey") == F.col("c_custkey"),
    )
    orders = _lying(orders.withColumn("analysis_id", _an("o_orderkey")), placed)
    head = F.col("o_orderkey") * 100
    event = kind == "event"
    head_nodes = orders.withColumn("node_type", _each("event", "customer")).select(
        "analysis_id",
        _doc("o_custkey").alias("document_id"),
        F.when(event, head).otherwise(head + 1).alias("node_seq"),
        F.when(event, "e").otherwise("c").alias("local_id"),
        kind,
        F.when(event, F.concat(F.lit("Order "), "o_orderpriority")).otherwise(F.col("c_name")).alias("name"),
        F.when(event, 1.0).otherwise(0.5 + (F.col("o_custkey") % 50) / 100).alias("confidence"),
        day.alias("timestamp"),
        F.when(event, text_map(F.lit("status"), "o_orderstatus"))
        .otherwise(text_map(F.lit("segment"), "c_mktsegment")).alias("attributes"),
    )
    assert [f.split(" ")[0] for f in node.split(", ")] == head_nodes.columns
    return line_nodes.unionByName(head_nodes)


def kg_edges(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Payload edges: customer buys part, supplier supplies part, customer performs event. ``placed`` as for nodes."""
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    base = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 2
    buys = F.col("relation") == "buys"
    lines = _lying(table(spark, sf_dir, "lineitem").withColumn("analysis_id", _an("l_orderkey")), placed)
    line_edges = lines.withColumn("relation", _each("buys", "supplies")).select(
        "analysis_id",
        (base + F.when(buys, 2).otherwise(3)).alias("edge_seq"),
        F.when(buys, "c").otherwise(supplier).alias("source_id"),
        "relation",
        part.alias("target_id"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.concat("l_returnflag", "l_linestatus").alias("evidence_quote"),
    )
    orders = _lying(table(spark, sf_dir, "orders").withColumn("analysis_id", _an("o_orderkey")), placed)
    head_edges = orders.select(
        "analysis_id",
        (F.col("o_orderkey") * 100).alias("edge_seq"),
        F.lit("c").alias("source_id"),
        F.lit("performs").alias("relation"),
        F.lit("e").alias("target_id"),
        F.lit(1.0).alias("confidence"),
        F.col("o_orderpriority").alias("evidence_quote"),
    )
    return line_edges.unionByName(head_edges)


def order_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of the order events: each in the graph, finished orders also in the facts."""
    orders = table(spark, sf_dir, "orders")
    copies = F.when(F.col("o_orderstatus") == "F", 2).otherwise(1)
    return orders.select(
        (F.col("o_orderkey") * 2).alias("_seq"),
        _an("o_orderkey").alias("analysis_id"),
        _doc("o_custkey").alias("document_id"),
        F.concat(F.lit("Order "), "o_orderpriority").alias("name"),
        F.date_format("o_orderdate", "yyyy-MM").alias("date_raw"),
        F.explode(F.sequence(F.lit(0), copies - 1)).alias("_copy"),
    ).select(
        (F.col("_seq") + F.col("_copy")).alias("mention_seq"),
        "analysis_id", "document_id", "name", "date_raw",
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles; every twentieth has no date."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("text").alias("content"),
        "source",
        "lang",
        F.when(doc % 20 != 0, F.date_add(F.to_date(F.lit("2024-01-01")), (doc % 365).cast("int"))).alias("published"),
        (doc % 3 == 0).alias("via_google_news"),
        (doc % 5 == 0).alias("via_gdelt"),
        (doc % 7 == 0).alias("via_gov_api"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.concat(F.lit("type_"), F.col("label").cast("string")).alias("item_type"),
        "embedding",
    )
