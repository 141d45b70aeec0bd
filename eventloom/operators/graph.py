"""The knowledge graph as two frames: upsert, merge, statistics, hash, temporal edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import multiset_digest, row_digest
from ..functions.maps import merge_maps, overlay
from ..functions.text import strip
from ..session import cut
from .matching import containment_pairs, first_fit, nodes_and_edges, with_ends

LOOK_AHEAD = 4
EDGE_FIELDS = ("timestamp", "evidence_quote", "document_id", "attributes")
MAX_DAYS = 30


def normalized_name(c: Column) -> Column:
    return strip(F.lower(c))


# ---- entity resolution and upsert --------------------------------------------------------


def name_pairs(nodes: DataFrame) -> DataFrame:
    """Distinct names (node_type, norm, ord) and their containment pairs' names."""
    names = distinct_names(nodes)
    pairs = containment_pairs(names)
    a = names.select("node_type", F.col("ord").alias("earlier"), F.col("norm").alias("earlier_name"))
    b = names.select("node_type", F.col("ord").alias("later"), F.col("norm").alias("later_name"))
    return pairs.join(a, ["node_type", "earlier"]).join(b, ["node_type", "later"]).select("node_type", "earlier_name", "later_name")


def distinct_names(nodes: DataFrame) -> DataFrame:
    """One row per (node_type, normalised name) with its first place; empty names are left out."""
    return (
        nodes.select("node_type", normalized_name(F.col("name")).alias("norm"), "node_seq")
        .where("norm <> ''")
        .groupBy("node_type", "norm")
        .agg(F.min("node_seq").alias("ord"))
    )


def resolve_entities(nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(node_type, norm, node_id): the graph node each name ends up in.

    A name joins the earliest node of its type that has the same name, or whose name contains or
    is contained in it with a length ratio of at most 1.5. ``node_seq`` gives the order and is
    unique per row. Existing nodes (node_type, name, node_seq, node_id) come first and always
    stand.
    """
    fresh = distinct_names(nodes).select(
        "node_type", "norm", "ord", graph_node_id(F.col("node_type"), F.col("norm")).alias("node_id"),
        F.lit(False).alias("fixed"),
    )
    if existing is not None:
        known = (
            existing.select("node_type", normalized_name(F.col("name")).alias("norm"), "node_seq", "node_id")
            .where("norm <> ''")
            .groupBy("node_type", "norm")
            .agg(F.min("node_seq").alias("ord"), F.min_by("node_id", "node_seq").alias("node_id"))
            # places before every new one
            .withColumn("ord", F.col("ord") - F.lit(2**62))
            .withColumn("fixed", F.lit(True))
        )
        fresh = known.unionByName(
            fresh.join(known.select("node_type", "norm"), ["node_type", "norm"], "left_anti")
        )
    # the distinct names are read in every round: take them out of the nodes once
    fresh = cut(fresh)
    led = first_fit(fresh.select("ord", "fixed"), containment_pairs(fresh))
    ids = fresh.select(F.col("ord").alias("leader"), "node_id")
    return fresh.drop("node_id").join(led, "ord").join(ids, "leader").select("node_type", "norm", "node_id")


def exact_entities(nodes: DataFrame) -> DataFrame:
    """Resolution by equal name only."""
    return distinct_names(nodes).select(
        "node_type", "norm", graph_node_id(F.col("node_type"), F.col("norm")).alias("node_id")
    )


def named_nodes(nodes: DataFrame, id_of: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Payload nodes with the graph node of their own name: a function of type and name, no join.

    ``id_of`` gives another id than the hash; with :func:`plain_id` the names can be read from it.
    """
    norm = normalized_name(F.col("name"))
    return nodes.where(norm != "").withColumn("node_id", (id_of or graph_node_id)(F.col("node_type"), norm))


def place_nodes(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """Payload nodes with the graph node they belong to, written once: node and edge upserts read
    it several times."""
    placed = nodes.withColumn("norm", normalized_name(F.col("name"))).join(entities, ["node_type", "norm"])
    return cut(placed.drop("norm"))


def upsert_nodes(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph nodes and their further sources, from :func:`place_nodes`.

    The first mention gives name, time, document and sentence; attributes are filled first-wins;
    later mentions from another document become rows of the second frame.
    """
    fields = [c for c in ("name", "timestamp", "document_id", "source_sentence") if c in placed.columns]
    base = placed.groupBy("node_id", F.col("node_type").alias("type")).agg(
        F.min_by(F.struct(*fields), "node_seq").alias("first"),
        F.count(F.lit(1)).alias("mentions"),
        F.min("node_seq").alias("node_seq"),
    ).select("node_id", "type", "first.*", "mentions", "node_seq")
    if "attributes" in placed.columns:
        merged = merge_maps(placed, ["node_id"], "attributes", F.col("node_seq"), last_wins=False)
        base = base.join(merged, "node_id", "left")
    first_doc = base.select("node_id", F.col("document_id").alias("_doc"), F.col("node_seq").alias("_first"))
    more = placed.join(first_doc, "node_id").where(
        (F.col("node_seq") != F.col("_first"))
        & F.col("document_id").isNotNull()
        & ~F.col("document_id").eqNullSafe(F.col("_doc"))
    )
    sentence = F.col("source_sentence") if "source_sentence" in placed.columns else F.lit(None).cast("string")
    return base, more.select("node_id", "document_id", sentence.alias("sentence"), "node_seq")


def graph_node_id(node_type: Column, norm: Column) -> Column:
    """Id from type and leading name, so a second run gives the same ids."""
    key = F.to_json(F.struct(node_type.alias("t"), norm.alias("n")))
    return F.concat(F.lit("node_"), F.substring(F.sha2(key, 256), 1, 16))


def plain_id(node_type: Column, norm: Column) -> Column:
    """Type and name themselves as an id: nothing to hash, and no join that looks them up again."""
    return F.struct(node_type.alias("type"), norm.alias("name"))


def fold_nodes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing nodes with missing attributes filled in, then the incoming nodes not yet there."""
    added = incoming.select("node_id", F.col("attributes").alias("_more"))
    filled = (
        existing.join(added, "node_id", "left")
        .withColumn("attributes", overlay(F.col("_more"), F.col("attributes")))
        .drop("_more")
    )
    fresh = incoming.join(existing.select("node_id"), "node_id", "left_anti")
    return filled.unionByName(fresh, allowMissingColumns=True)


def edge_id(src: Column, relation: Column, dst: Column) -> Column:
    key = F.to_json(F.struct(src.alias("s"), relation.alias("r"), dst.alias("d")))
    return F.concat(F.lit("edge_"), F.substring(F.sha2(key, 256), 1, 16))


def link_edges(edges: DataFrame, placed: DataFrame, of_source: tuple[str, ...] = ()) -> DataFrame:
    """Edges between graph nodes: local ids to node ids, the last node of a local id counting; columns
    named in ``of_source`` are taken over from the source's node.

    Rows are placed by analysis once, see :func:`with_ends`.
    """
    node = F.col("node_id")
    return with_ends(edges, placed, {"src": node, **{c: F.col(c) for c in of_source}}, {"dst": node})


def linked_graph(edges: DataFrame, placed: DataFrame, of_node: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The nodes and the edges of :func:`link_edges` as an upsert takes them, from one pass that writes both together.

    Columns named in ``of_node`` are the nodes' own; edges take them over from their source's node.
    """
    said = {"src": F.col("node_id"), **{c: F.col(c) for c in of_node}}
    fields = ("node_seq", "node_type", "name", "timestamp", "document_id", "attributes", "source_sentence")
    keep = tuple(c for c in fields if c in placed.columns)
    rows = nodes_and_edges(edges, placed, said, {"dst": F.col("node_id")}, keep)
    taken = [c for c in EDGE_FIELDS if c in edges.columns]
    rows = cut(rows.select("_edge", "src", "relation", "dst", "edge_seq", *taken, *of_node, "_node"), dense=True)
    return (
        rows.where("not _edge").select(F.col("src").alias("node_id"), *of_node, "_node.*"),
        rows.where("_edge").select("src", "relation", "dst", "edge_seq", *taken, *of_node),
    )


def edge_rows(linked: DataFrame, *more: str) -> DataFrame:
    """Linked edges with the columns that an upsert takes, and ``more``, written once."""
    fields = [c for c in EDGE_FIELDS if c in linked.columns]
    return cut(linked.select("src", "relation", "dst", "edge_seq", *fields, *more), dense=True)


def upsert_edges(
    linked: DataFrame, digraph: bool = False, written: bool = False, buckets: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Graph edges keyed by (src, relation, dst) and their further evidence.

    With ``digraph`` only the relation seen last stands per (src, dst). ``written`` says that the
    frame is one of :func:`edge_rows`. Edges that are to lie by edge_id in ``buckets`` partitions are sent
    there as rows, once, instead of being added up elsewhere first.
    """
    key = ["src", "relation", "dst"]
    # read up to five times below: write the resolved edges once
    rows = linked if written else edge_rows(linked)
    if digraph:
        last = rows.groupBy("src", "dst").agg(F.max_by("relation", "edge_seq").alias("relation"))
        rows = rows.join(last, key, "left_semi")
    if buckets:
        # the id is made again behind the exchange, which is cheaper than to send it
        named = edge_id(*[F.col(c) for c in key])
        rows = rows.repartition(buckets, named).withColumn("edge_id", named)
        key = ["edge_id", *key]
    fields = [c for c in ("timestamp", "evidence_quote", "document_id") if c in rows.columns]
    # keys are nearly unique here, so looking up first rows by place would cost another shuffle
    base = rows.groupBy(*key).agg(
        F.min_by(F.struct(*fields), "edge_seq").alias("first"),
        F.count(F.lit(1)).alias("mentions"),
        F.min("edge_seq").alias("edge_seq"),
    ).select(*([] if buckets else [edge_id(*[F.col(c) for c in key]).alias("edge_id")]), *key, "first.*", "mentions", "edge_seq")
    if "attributes" in rows.columns:
        merged = merge_maps(rows, key, "attributes", F.col("edge_seq"), last_wins=False)
        base = base.join(merged, key, "left")
    first = base.select(*key, F.col("evidence_quote").alias("_quote"), F.col("edge_seq").alias("_first"))
    more = rows.join(first, key).where(
        (F.col("edge_seq") != F.col("_first"))
        & (F.coalesce("evidence_quote", F.lit("")) != "")
        & ~F.col("evidence_quote").eqNullSafe(F.col("_quote"))
    )
    return base, more.select("src", "relation", "dst", F.col("evidence_quote").alias("quote"), "edge_seq")


# ---- merge, statistics, hash -------------------------------------------------------------


def merge_graphs(
    nodes: DataFrame, edges: DataFrame, other_nodes: DataFrame, other_edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Left graph plus unseen node ids and unseen (src, dst) pairs of the other graph."""
    new_nodes, new_edges = merge_additions(nodes, edges, other_nodes, other_edges)
    return (
        nodes.unionByName(new_nodes, allowMissingColumns=True),
        edges.unionByName(new_edges, allowMissingColumns=True),
    )


def merge_additions(
    nodes: DataFrame, edges: DataFrame, other_nodes: DataFrame, other_edges: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """What a merge would add. Of several other edges of one pair the first counts."""
    new_nodes = other_nodes.join(nodes.select("node_id"), "node_id", "left_anti")
    pairs = other_edges.where(
        (F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != "")
    ).dropDuplicates(["src", "dst"])
    return new_nodes, pairs.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, name, value): counts per node type and relation, totals and density."""
    types = nodes.groupBy(F.coalesce("type", F.lit("unknown")).alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    relations = edges.groupBy(F.coalesce("relation", F.lit("unknown")).alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return statistics_of_counts(
        types.select(F.lit("node_type").alias("section"), "name", "n").union(
            relations.select(F.lit("relation").alias("section"), "name", "n")
        )
    )


def named_graph_statistics(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """:func:`graph_statistics` of the graph that payload edges and nodes with a ``node_id`` of type and name
    (:func:`named_nodes`) make. Nodes are read once, for the links and for the counts, and nothing is
    written; of an edge only its key goes on."""
    node = F.col("node_id")
    rows = nodes_and_edges(edges.select("analysis_id", "source_id", "relation", "target_id"), placed, {"src": node}, {"dst": node})
    kinds = rows.select("_edge", "relation", "src", "dst").distinct()
    name = F.when(F.col("_edge"), F.col("relation")).otherwise(F.col("src.type"))
    return statistics_of_counts(
        kinds.groupBy(F.when(F.col("_edge"), "relation").otherwise("node_type").alias("section"), F.coalesce(name, F.lit("unknown")).alias("name"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def statistics_of_counts(counts: DataFrame) -> DataFrame:
    """Statistics from (section, name, n): nodes of each type under 'node_type', edges of each kind under 'relation'."""
    start = counts.sparkSession.range(1).select(F.lit("graph").alias("section"), F.lit(None).cast("string").alias("name"), F.lit(0).alias("n"))
    tagged = counts.union(start)
    # group rows and grand total come from one pass; the extra row gives an empty graph its total
    totalled = tagged.groupingSets([["section", "name"], []], "section", "name").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("section") == "node_type", F.col("n")).otherwise(0)).alias("nodes"),
        F.sum(F.when(F.col("section") == "relation", F.col("n")).otherwise(0)).alias("edges"),
        F.grouping("section").alias("is_total"),
    )
    density = F.when(
        F.col("nodes") > 1, F.col("edges") / (F.col("nodes").cast("double") * (F.col("nodes") - 1))
    ).otherwise(0.0)

    def fact(section: Column, name: Column, value: Column) -> Column:
        return F.struct(section.alias("section"), name.alias("name"), value.cast("double").alias("value"))

    total = F.lit("graph")
    facts = F.when(
        F.col("is_total") == 1,
        F.array(
            fact(total, F.lit("node_count"), F.col("nodes")),
            fact(total, F.lit("edge_count"), F.col("edges")),
            fact(total, F.lit("density"), density),
        ),
    ).when(F.col("section") != "graph", F.array(fact(F.col("section"), F.col("name"), F.col("n"))))
    return totalled.select(F.inline(facts))


def undeclared_types(nodes: DataFrame, edges: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Node types and relations in use that the taxonomy (kind, name) lacks."""
    used = (
        nodes.select(F.lit("node").alias("kind"), F.col("type").alias("name"))
        .union(edges.select(F.lit("relation").alias("kind"), F.col("relation").alias("name")))
        .distinct()
    )
    return used.join(taxonomy.select("kind", "name"), ["kind", "name"], "left_anti")


def content_digest(df: DataFrame, leave_out: tuple[str, ...] = ("timestamp", "created_at")) -> DataFrame:
    """One row: order-independent hash of a frame without its clock columns, and its row count."""
    columns = [c for c in df.columns if c not in leave_out]
    maps = {f.name for f in df.schema.fields if f.dataType.typeName() in ("map", "array", "struct")}
    flat = df.select(
        *[
            (F.to_json(F.array_sort(F.map_entries(c))) if df.schema[c].dataType.typeName() == "map"
             else F.to_json(c) if c in maps else F.col(c).cast("string")).alias(c)
            for c in columns
        ]
    )
    return flat.select(row_digest(columns).alias("h")).agg(
        multiset_digest(F.col("h")).alias("content_hash"), F.count(F.lit(1)).alias("row_count")
    )


def graph_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: hash of the node and edge hashes."""
    both = content_digest(nodes).select(F.lit("nodes").alias("part"), "content_hash").union(
        content_digest(edges).select(F.lit("edges").alias("part"), "content_hash")
    )
    pick = lambda p: F.max(F.when(F.col("part") == p, F.col("content_hash")))
    return both.agg(F.sha2(F.concat_ws("|", pick("nodes"), pick("edges")), 256).alias("content_hash"))


# ---- temporal edges ----------------------------------------------------------------------


def temporal_pairs(
    events: DataFrame,
    scope: list[str],
    linked: DataFrame | None = None,
    look_ahead: int = LOOK_AHEAD,
    max_days: int = MAX_DAYS,
) -> DataFrame:
    """(scope, earlier, later, days_between) among each event's next ``look_ahead`` events.

    ``events`` is (scope, node_id, timestamp text, seq). Pairs of one day are never emitted, so
    of each day only its last events can look ahead and only its first ones can be seen. The
    rows are cut to those (a per-day row limit that Spark applies before the shuffle), which
    bounds the ordering window by the calendar: at most ``2 * look_ahead`` rows per scope and day.
    ``linked`` (src, dst) pairs, in either direction, are left out.
    """
    day = F.substring_index("timestamp", "T", 1)
    dated = (
        events.where("timestamp is not null and timestamp not in ('', 'N/A')")
        .withColumn("day", F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("date")))
        .where("day is not null")
    )
    order = ["timestamp", "seq"]
    first_w = W.partitionBy(*scope, "day").orderBy(*order)
    last_w = W.partitionBy(*scope, "day").orderBy(*[F.desc(c) for c in order])
    first = dated.withColumn("_rn", F.row_number().over(first_w)).where(F.col("_rn") <= look_ahead)
    last = dated.withColumn("_rn", F.row_number().over(last_w)).where(F.col("_rn") <= look_ahead)
    edge_rows = (
        first.withColumn("_looks", F.lit(False))
        .unionByName(last.withColumn("_looks", F.lit(True)))
        .groupBy(*scope, "node_id", "timestamp", "day", "seq")
        .agg(F.max("_looks").alias("_looks"))
    )
    w = W.partitionBy(*scope).orderBy(*order) if scope else W.partitionBy(F.lit(0)).orderBy(*order)
    ahead = F.array(
        *[
            F.lead(F.struct(F.col("node_id").alias("later"), F.col("day").alias("later_day"),
                            F.col("timestamp").alias("later_timestamp")), k).over(w)
            for k in range(1, look_ahead + 1)
        ]
    )
    pairs = (
        edge_rows.withColumn("_ahead", ahead)
        .where("_looks")
        .select(*scope, F.col("node_id").alias("earlier"), "day", "timestamp",
                F.inline(F.array_compact("_ahead")))
        .withColumn("days_between", F.datediff("later_day", "day"))
        .where((F.col("days_between") > 0) & (F.col("days_between") <= max_days))
    )
    if linked is not None:
        low, high = F.least("src", "dst"), F.greatest("src", "dst")
        known = linked.select(low.alias("_a"), high.alias("_b")).distinct()
        pairs = (
            pairs.withColumns({"_a": F.least("earlier", "later"), "_b": F.greatest("earlier", "later")})
            .join(known, ["_a", "_b"], "left_anti")
            .drop("_a", "_b")
        )
    return pairs.select(*scope, "earlier", "later", "timestamp", "later_timestamp", "days_between")


def temporal_edges(pairs: DataFrame, scope: list[str]) -> DataFrame:
    """Each pair as a ``precedes`` and a ``follows`` edge."""

    def edge(src, relation, dst, stamp):
        return F.struct(
            F.col(src).alias("src"), F.lit(relation).alias("relation"), F.col(dst).alias("dst"),
            F.col(stamp).alias("timestamp"),
        )

    return pairs.select(
        *scope, "days_between",
        F.inline(
            F.array(
                edge("earlier", "precedes", "later", "timestamp"),
                edge("later", "follows", "earlier", "later_timestamp"),
            )
        ),
    )


# ---- version log -------------------------------------------------------------------------


def version_rows(log: DataFrame) -> DataFrame:
    """Number the operations of each graph in time order."""
    from .ordered import ranks

    return ranks(log, ["graph_id"], ["timestamp", "operation"], "graph_version")


def next_version(log: DataFrame) -> DataFrame:
    return log.groupBy("graph_id").agg((F.max("graph_version") + 1).alias("graph_version"))


def provenance_info(log: DataFrame) -> DataFrame:
    return log.groupBy("graph_id").agg(
        F.min("timestamp").alias("first_created"),
        F.max("timestamp").alias("last_updated"),
        F.count(F.lit(1)).alias("update_count"),
        F.max_by("content_hash", "timestamp").alias("content_hash"),
    )
