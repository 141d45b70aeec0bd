"""Queries over the knowledge graph and equivalence sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maps import first_and_last, merge_maps
from ..operators import equivalence as eq
from ..operators import filters as fl
from ..operators import graph as g
from ..session import cut, fresh_dir
from ..sources import merkle
from ..sources import tables as t
from ..sources.graph_store import GraphStore
from .registry import ATTRIBUTES, EDGES, MENTIONS, NODES, RESOLVED, query, r6


def _unique_nodes(spark, sf, placed=False):
    """Payload nodes with a sequence that is unique per row, up to equal rows."""
    no = F.substring("local_id", 2, 20)
    return t.kg_nodes(spark, sf, placed).withColumn(
        "node_seq", F.col("node_seq") * 1000000 + F.when(no == "", F.lit(0)).otherwise(no.cast("bigint"))
    )


_UNIQ = NODES + """, uniq AS (
  SELECT *, node_seq * 1000000 + CASE WHEN length(local_id) > 1 THEN CAST(substr(local_id, 2) AS BIGINT) ELSE 0 END AS useq
  FROM kg_nodes)"""


@query("node_upsert", f"""WITH {_UNIQ}
SELECT node_type AS type, lower(arg_min(name, useq)) AS lname, arg_min(timestamp, useq) AS timestamp,
       arg_min(document_id, useq) AS document_id, CAST(count(*) AS BIGINT) AS mentions,
       arg_min(brand, useq) AS brand
FROM uniq GROUP BY node_type, lower(name)""")
def node_upsert(spark, sf):
    nodes = fl.complete_nodes(_unique_nodes(spark, sf))
    base, _more = g.upsert_nodes(cut(g.named_nodes(nodes, g.plain_id).drop("confidence")))
    return base.select(
        "type", F.lower("name").alias("lname"), "timestamp", "document_id", "mentions",
        F.try_element_at("attributes", F.lit("brand")).alias("brand"),
    )


@query("node_further_sources", f"""WITH {_UNIQ}, f AS (
  SELECT node_type, lower(name) AS lname, arg_min(document_id, useq) AS doc, min(useq) AS first FROM uniq GROUP BY ALL)
SELECT u.node_type AS type, f.lname, CAST(count(*) AS BIGINT) AS further, CAST(count(DISTINCT document_id) AS BIGINT) AS documents
FROM uniq u JOIN f ON f.node_type = u.node_type AND f.lname = lower(u.name)
WHERE useq <> first AND document_id <> doc GROUP BY u.node_type, f.lname""")
def node_further_sources(spark, sf):
    nodes = _unique_nodes(spark, sf).drop("confidence", "attributes")
    _base, more = g.upsert_nodes(cut(g.named_nodes(nodes, g.plain_id)))
    return (
        more.groupBy("node_id", "document_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("node_id").agg(F.sum("n").alias("further"), F.count("document_id").alias("documents"))
        .select("node_id.type", F.col("node_id.name").alias("lname"), "further", "documents")
    )


def _graph(spark, sf):
    """What makes a graph by equal names: edges, and nodes with type and name as ids."""
    return fl.complete_edges(t.kg_edges(spark, sf)), g.named_nodes(t.kg_nodes(spark, sf), g.plain_id)


@query("edge_upsert", f"""WITH {RESOLVED}
SELECT src_type, src_name, relation, dst_type, dst_name, CAST(count(*) AS BIGINT) AS mentions, min(edge_seq) AS edge_seq
FROM resolved GROUP BY src_type, src_name, relation, dst_type, dst_name""")
def edge_upsert(spark, sf):
    edges, _more = g.upsert_edges(g.link_edges(*_graph(spark, sf)))
    return edges.select(
        F.col("src.type").alias("src_type"), F.col("src.name").alias("src_name"), "relation",
        F.col("dst.type").alias("dst_type"), F.col("dst.name").alias("dst_name"), "mentions", "edge_seq",
    )


@query("graph_stats", f"""WITH {RESOLVED}, n AS (
  SELECT node_type, count(DISTINCT lower(name)) AS n FROM kg_nodes GROUP BY node_type),
e AS (SELECT relation, count(*) AS n FROM (
  SELECT DISTINCT src_type, src_name, relation, dst_type, dst_name FROM resolved) GROUP BY relation)
SELECT 'node_type' AS section, node_type AS name, CAST(n AS DOUBLE) AS value FROM n
UNION ALL SELECT 'relation', relation, CAST(n AS DOUBLE) FROM e
UNION ALL SELECT 'graph', 'node_count', CAST((SELECT sum(n) FROM n) AS DOUBLE)
UNION ALL SELECT 'graph', 'edge_count', CAST((SELECT sum(n) FROM e) AS DOUBLE)
UNION ALL SELECT 'graph', 'density', round((SELECT sum(n) FROM e) / (CAST((SELECT sum(n) FROM n) AS DOUBLE) * ((SELECT sum(n) FROM n) - 1)), 6)""")
def graph_stats(spark, sf):
    return g.named_graph_statistics(*_graph(spark, sf)).withColumn("value", r6("value"))


def _plain_graph(spark, sf):
    """Small-column graph for hashing and merging: one node per name, one edge per pair."""
    nodes = t.kg_nodes(spark, sf).select(
        F.concat_ws(":", "node_type", F.lower("name")).alias("node_id"), F.col("node_type").alias("type")
    ).distinct()
    lines = t.table(spark, sf, "lineitem")
    part = t.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("part:"), "p_name").alias("dst"))
    supplier = t.table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("supplier:"), F.lower("s_name")).alias("src"))
    edges = (
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("src", F.lit("supplies").alias("relation"), "dst")
        .distinct()
    )
    return nodes, edges


_PLAIN = NODES + """, pn AS (SELECT DISTINCT node_type || ':' || lower(name) AS node_id, node_type AS type FROM kg_nodes),
pe AS (SELECT DISTINCT 'supplier:' || lower(s_name) AS src, 'supplies' AS relation, 'part:' || p_name AS dst
       FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

_SUMS = "||'|'||".join(
    f"CAST(sum(CAST(('0x' || substr(h, {16 * i + 1}, 16)) AS UBIGINT)) AS VARCHAR)" for i in range(4)
)


@query("graph_hash", f"""WITH {_PLAIN},
hn AS (SELECT sha256(concat_ws('|', length(node_id) || ':' || node_id, length(type) || ':' || type)) AS h FROM pn),
he AS (SELECT sha256(concat_ws('|', length(dst) || ':' || dst, length(relation) || ':' || relation, length(src) || ':' || src)) AS h FROM pe),
rn AS (SELECT sha256({_SUMS} || '|' || count(*)) AS h FROM hn),
re AS (SELECT sha256({_SUMS} || '|' || count(*)) AS h FROM he)
SELECT sha256((SELECT h FROM rn) || '|' || (SELECT h FROM re)) AS content_hash""")
def graph_hash(spark, sf):
    return g.graph_hash(*_plain_graph(spark, sf))


@query("graph_merge", f"""WITH {_PLAIN}, own AS (
  SELECT * FROM pn WHERE type <> 'supplier'),
own_e AS (SELECT * FROM pe WHERE src < 'supplier:supplier#000000050'),
add_n AS (SELECT * FROM pn WHERE node_id NOT IN (SELECT node_id FROM own)),
add_e AS (SELECT * FROM pe WHERE NOT EXISTS (SELECT 1 FROM own_e o WHERE o.src = pe.src AND o.dst = pe.dst))
SELECT 'node' AS part, type AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM own UNION ALL SELECT * FROM add_n) GROUP BY type
UNION ALL SELECT 'edge', relation, CAST(count(*) AS BIGINT) FROM (SELECT * FROM own_e UNION ALL SELECT * FROM add_e) GROUP BY relation
UNION ALL SELECT 'added node', type, CAST(count(*) AS BIGINT) FROM add_n GROUP BY type
UNION ALL SELECT 'added edge', relation, CAST(count(*) AS BIGINT) FROM add_e GROUP BY relation""")
def graph_merge(spark, sf):
    # both are read six times below, and far shorter than the tables they come from
    nodes, edges = [cut(df) for df in _plain_graph(spark, sf)]
    own_n = nodes.where("type <> 'supplier'")
    own_e = edges.where("src < 'supplier:supplier#000000050'")
    all_n, all_e = g.merge_graphs(own_n, own_e, nodes, edges)
    new_n, new_e = g.merge_additions(own_n, own_e, nodes, edges)

    def count(df, part, kind):
        return df.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(part).alias("part"), "kind", "n"
        )

    return (
        count(all_n, "node", "type").union(count(all_e, "edge", "relation"))
        .union(count(new_n, "added node", "type")).union(count(new_e, "added edge", "relation"))
    )


@query("undeclared_types", f"""WITH {NODES}, {EDGES}
SELECT DISTINCT 'node' AS kind, node_type AS name FROM kg_nodes WHERE node_type NOT IN ('event', 'part')
UNION SELECT DISTINCT 'relation', relation FROM kg_edges WHERE relation NOT IN ('performs', 'buys')""")
def undeclared_types(spark, sf):
    taxonomy = spark.createDataFrame(
        [("node", "event"), ("node", "part"), ("relation", "performs"), ("relation", "buys")], "kind string, name string"
    )
    nodes = t.kg_nodes(spark, sf).withColumnRenamed("node_type", "type")
    return g.undeclared_types(nodes, t.kg_edges(spark, sf), taxonomy)


@query("referential_edges", f"""WITH {RESOLVED}
SELECT relation, CAST(count(*) AS BIGINT) AS n, round(sum(confidence), 6) AS confidence
FROM (SELECT e.* FROM kg_edges e JOIN (SELECT DISTINCT analysis_id || '/' || local_id AS k FROM kg_nodes WHERE node_type <> 'supplier') s
      ON s.k = e.analysis_id || '/' || source_id
      JOIN (SELECT DISTINCT analysis_id || '/' || local_id AS k FROM kg_nodes WHERE node_type <> 'supplier') d ON d.k = e.analysis_id || '/' || target_id)
GROUP BY relation""")
def referential_edges(spark, sf):
    nodes = t.kg_nodes(spark, sf).where("node_type <> 'supplier'").select(
        F.concat_ws("/", "analysis_id", "local_id").alias("node_id")
    )
    edges = t.kg_edges(spark, sf).withColumns(
        {"src": F.concat_ws("/", "analysis_id", "source_id"), "dst": F.concat_ws("/", "analysis_id", "target_id")}
    )
    return fl.edges_with_endpoints(edges, nodes).groupBy("relation").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("confidence")).alias("confidence")
    )


_STAMPED = MENTIONS + """, ranked AS (
  SELECT analysis_id, mention_seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, CAST(ts AS DATE) AS day,
         row_number() OVER (PARTITION BY analysis_id ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S'), mention_seq) AS rn
  FROM mentions)"""


def _stamped(spark, sf):
    return t.mentions(spark, sf).select(
        "analysis_id", F.col("mention_seq").alias("node_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("mention_seq").alias("seq"),
    )


@query("temporal_precedes", f"""WITH {_STAMPED}
SELECT a.analysis_id, a.mention_seq AS earlier, b.mention_seq AS later, CAST(b.day - a.day AS INTEGER) AS days_between
FROM ranked a JOIN ranked b ON a.analysis_id = b.analysis_id AND b.rn BETWEEN a.rn + 1 AND a.rn + 4
WHERE b.day - a.day BETWEEN 1 AND 30""")
def temporal_precedes(spark, sf):
    return g.temporal_pairs(_stamped(spark, sf), ["analysis_id"]).select(
        "analysis_id", "earlier", "later", "days_between"
    )


@query("temporal_edges_global", f"""WITH {MENTIONS}, r AS (
  SELECT mention_seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, CAST(ts AS DATE) AS day,
         row_number() OVER (ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S'), mention_seq) AS rn FROM mentions),
linked AS (SELECT a.mention_seq AS src, b.mention_seq AS dst FROM r a JOIN r b ON b.rn = a.rn + 1),
p AS (SELECT a.mention_seq AS a, b.mention_seq AS b, a.stamp AS sa, b.stamp AS sb, CAST(b.day - a.day AS INTEGER) AS days_between
      FROM r a JOIN r b ON b.rn BETWEEN a.rn + 1 AND a.rn + 4
      WHERE b.day - a.day BETWEEN 1 AND 30 AND NOT EXISTS (
        SELECT 1 FROM linked l WHERE (l.src = a.mention_seq AND l.dst = b.mention_seq) OR (l.src = b.mention_seq AND l.dst = a.mention_seq)))
SELECT a AS src, 'precedes' AS relation, b AS dst, sa AS timestamp, days_between FROM p
UNION ALL SELECT b, 'follows', a, sb, days_between FROM p""")
def temporal_edges_global(spark, sf):
    """Over all events as one order; neighbours count as linked already."""
    events = _stamped(spark, sf).drop("analysis_id")
    from ..operators.ordered import with_next

    linked = with_next(events.withColumn("all", F.lit(0)), ["all"], ["timestamp", "seq"], ["node_id"]).where(
        "next is not null"
    ).select(F.col("next.node_id").alias("src"), F.col("node_id").alias("dst"))
    return g.temporal_edges(g.temporal_pairs(events, [], linked), [])


@query("event_ranks", f"""WITH {MENTIONS}
SELECT mention_seq, row_number() OVER (PARTITION BY action ORDER BY ts, mention_seq) AS rank FROM mentions""")
def event_ranks(spark, sf):
    from ..operators.ordered import ranks

    m = t.mentions(spark, sf).select("mention_seq", "action", "ts")
    return ranks(m, ["action"], ["ts", "mention_seq"]).select("mention_seq", "rank")


@query("graph_versions", """
SELECT graph_id, max(v) AS graph_version, min(ts) AS first_created, max(ts) AS last_updated, CAST(count(*) AS BIGINT) AS update_count
FROM (SELECT event_type AS graph_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS v FROM events)
GROUP BY graph_id""")
def graph_versions(spark, sf):
    log = t.table(spark, sf, "events").select(
        F.col("event_type").alias("graph_id"), F.col("ts").alias("timestamp"),
        F.format_string("op%012d", "event_id").alias("operation"), F.lit(None).cast("string").alias("content_hash"),
    )
    versions = g.version_rows(log).groupBy("graph_id").agg(F.max("graph_version").alias("graph_version"))
    return versions.join(g.provenance_info(log).drop("content_hash"), "graph_id")


_VARIANTS = """names AS (
  SELECT 'customer' AS node_type, 'customer#' || c_custkey AS norm, c_custkey AS ord FROM customer
  UNION ALL SELECT 'supplier', 'supplier#' || s_suppkey, s_suppkey FROM supplier
  UNION ALL SELECT 'part', lower(p_name), min(p_partkey) FROM part GROUP BY lower(p_name)),
pairs AS (
  SELECT a.node_type, a.norm AS earlier_name, b.norm AS later_name
  FROM names a JOIN names b ON a.node_type = b.node_type AND (a.ord < b.ord)
  WHERE (contains(a.norm, b.norm) OR contains(b.norm, a.norm))
    AND greatest(length(a.norm), length(b.norm)) / least(length(a.norm), length(b.norm)) <= 1.5)"""


def _variants(spark, sf):
    """Names with unpadded numbers: many contain one another."""

    def names(table, kind, name, key):
        return t.table(spark, sf, table).select(
            F.lit(kind).alias("node_type"), name.alias("name"), F.col(key).alias("seq")
        )

    number = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    return (
        names("customer", "customer", number("Customer#", "c_custkey"), "c_custkey")
        .union(names("supplier", "supplier", number("Supplier#", "s_suppkey"), "s_suppkey"))
        .union(names("part", "part", F.col("p_name"), "p_partkey"))
    )


@query("entity_match_pairs", f"WITH {_VARIANTS} SELECT * FROM pairs")
def entity_match_pairs(spark, sf):
    return g.name_pairs(_variants(spark, sf).withColumnRenamed("seq", "node_seq"))


@query("entity_resolution", f"""WITH {_VARIANTS}, lists AS (
  SELECT node_type, list(norm ORDER BY ord) AS ns FROM names GROUP BY node_type),
leads AS (
  SELECT node_type, list_reduce(ns, lambda acc, x: CASE WHEN len(list_filter(string_split(acc, chr(10)), lambda l:
      (contains(l, x) OR contains(x, l)) AND greatest(length(l), length(x)) / least(length(l), length(x)) <= 1.5)) > 0
      THEN acc ELSE acc || chr(10) || x END) AS acc FROM lists),
lead AS (SELECT node_type, unnest(string_split(acc, chr(10))) AS leader FROM leads),
lo AS (SELECT l.node_type, l.leader, n.ord FROM lead l JOIN names n ON n.node_type = l.node_type AND n.norm = l.leader)
SELECT n.node_type, n.norm, arg_min(l.leader, l.ord) AS leader
FROM names n JOIN lo l ON l.node_type = n.node_type AND (
  l.leader = n.norm OR ((contains(l.leader, n.norm) OR contains(n.norm, l.leader))
  AND greatest(length(l.leader), length(n.norm)) / least(length(l.leader), length(n.norm)) <= 1.5))
GROUP BY n.node_type, n.norm""")
def entity_resolution(spark, sf):
    # the sequence has to be unique over all types
    place = F.when(F.col("node_type") == "customer", 0).when(F.col("node_type") == "supplier", 1).otherwise(2)
    nodes = _variants(spark, sf).withColumn("node_seq", F.col("seq") * 3 + place)
    found = g.resolve_entities(nodes)
    ids = g.exact_entities(nodes).select("node_id", F.col("norm").alias("leader"))
    return found.join(ids, "node_id").select("node_type", "norm", "leader")


def _first_and_last(spark, sf):
    nodes = _unique_nodes(spark, sf).withColumn("lname", F.lower("name"))
    return first_and_last(nodes, ["node_type", "lname"], "attributes", F.col("node_seq"))


@query("attributes_first_wins", f"""WITH {ATTRIBUTES}
SELECT node_type, lname, arg_min(value, seq) FILTER (WHERE attribute = 'kind') AS kind,
       arg_max(value, seq) FILTER (WHERE attribute = 'kind') AS last_kind
FROM attrs GROUP BY node_type, lname""")
def attributes_first_wins(spark, sf):
    """First and last kind of each node, null for nodes of types that have none."""
    kind = F.lit("kind")
    return _first_and_last(spark, sf).select(
        "node_type", "lname", F.try_element_at("first", kind).alias("kind"), F.try_element_at("last", kind).alias("last_kind")
    )


@query("attributes_first_wins_all", f"""WITH {ATTRIBUTES}
SELECT node_type, lname, attribute, arg_min(value, {{s: seq, v: value}}) AS value, arg_max(value, {{s: seq, v: value}}) AS last_value
FROM attrs GROUP BY node_type, lname, attribute""")
def attributes_first_wins_all(spark, sf):
    """First and last value of every attribute of nodes of all types."""
    each = _first_and_last(spark, sf).select("node_type", "lname", F.explode("first").alias("attribute", "value"), "last")
    return each.select(
        "node_type", "lname", "attribute", "value", F.try_element_at("last", F.col("attribute")).alias("last_value")
    )


# ---- equivalence sets --------------------------------------------------------------------


def _members(spark, sf):
    nodes = t.kg_nodes(spark, sf).withColumn("domain", F.substring("document_id", 1, 5))
    return eq.instances(nodes)


@query("equivalence_sets", f"""WITH {NODES}
SELECT node_type AS entity_type, lower(name) AS canonical_name, CAST(count(*) AS BIGINT) AS instance_count,
       round(sum(confidence), 6) AS aggregate_weight, CAST(0.0 AS DOUBLE) AS cross_source_variance,
       round(var_pop(confidence), 6) AS confidence_variance
FROM kg_nodes GROUP BY node_type, lower(name)""")
def equivalence_sets(spark, sf):
    return eq.equivalence_sets(_members(spark, sf)).drop("set_id").withColumns(
        {"aggregate_weight": r6("aggregate_weight"), "confidence_variance": r6("confidence_variance")}
    )


@query("corroboration", f"""WITH {NODES}
SELECT node_type, lower(name) AS canonical_name, CAST(count(*) AS BIGINT) AS corroboration_count,
       CAST(count(DISTINCT substr(document_id, 1, 5)) AS BIGINT) AS source_diversity
FROM kg_nodes GROUP BY node_type, lower(name)""")
def corroboration(spark, sf):
    return eq.corroboration(_members(spark, sf)).withColumnRenamed("entity_type", "node_type")


_EVIDENCE = NODES + ", " + EDGES + """, dst AS (
  SELECT DISTINCT analysis_id, local_id, node_type AS dst_type, lower(name) AS dst_name FROM kg_nodes),
evidence AS (
  SELECT s.node_type AS src_type, lower(s.name) AS src_name, d.dst_type, d.dst_name, e.confidence
  FROM kg_edges e JOIN kg_nodes s ON s.analysis_id = e.analysis_id AND s.local_id = e.source_id
  JOIN dst d ON d.analysis_id = e.analysis_id AND d.local_id = e.target_id)"""


@query("weighted_relationships", f"""WITH {_EVIDENCE}
SELECT src_type, src_name, dst_type, dst_name, CAST(count(*) AS BIGINT) AS supporting_instances,
       round(sum(confidence), 6) AS total_weight, round(avg(confidence), 6) AS confidence
FROM evidence GROUP BY src_type, src_name, dst_type, dst_name""")
def weighted_relationships(spark, sf):
    found = eq.weighted_relationships(eq.relationship_evidence(_members(spark, sf), t.kg_edges(spark, sf)))
    return found.select(
        *eq.PAIR_KEY, "supporting_instances", r6("total_weight").alias("total_weight"),
        r6("confidence").alias("confidence"),
    )


@query("relationship_lookup", f"""WITH {_EVIDENCE}
SELECT src_name, dst_name, CAST(count(*) AS BIGINT) AS supporting_instances,
       round(sum(confidence), 6) AS total_weight, round(avg(confidence), 6) AS confidence
FROM evidence WHERE (src_name = 'supplier#000000001' AND dst_name = 'red widget') OR (src_name = 'red widget' AND dst_name = 'supplier#000000001')
GROUP BY src_name, dst_name""")
def relationship_lookup(spark, sf):
    return eq.relationship(
        _members(spark, sf), t.kg_edges(spark, sf), "Red Widget", "Supplier#000000001"
    ).withColumns({"total_weight": r6("total_weight"), "confidence": r6("confidence")})


@query("entity_lookup", f"""WITH {NODES}
SELECT node_type AS entity_type, lower(name) AS canonical_name, CAST(count(*) AS BIGINT) AS instance_count,
       round(sum(confidence), 6) AS aggregate_weight
FROM kg_nodes WHERE lower(name) = 'red widget' GROUP BY node_type, lower(name)""")
def entity_lookup(spark, sf):
    return eq.entity(_members(spark, sf), "RED widget").select(
        "entity_type", "canonical_name", "instance_count", r6("aggregate_weight").alias("aggregate_weight")
    )


@query("provenance_chain", f"""WITH {NODES}
SELECT node_type, lower(name) AS canonical_name, n.analysis_id, local_id AS kg_node_id, o_orderstatus AS article_title,
       round(confidence, 6) AS confidence_score, CAST(count(*) AS BIGINT) AS n
FROM kg_nodes n JOIN orders ON n.analysis_id = 'an_' || o_orderkey GROUP BY ALL""")
def provenance_chain(spark, sf):
    members = _members(spark, sf)
    analyses = t.table(spark, sf, "orders").select(
        F.concat(F.lit("an_"), F.col("o_orderkey").cast("string")).alias("analysis_id"),
        F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("url"),
        F.col("o_orderdate").alias("published"), F.col("o_orderdate").alias("analyzed_at"),
    )
    chain = eq.provenance_chain(members, analyses).withColumnRenamed("entity_type", "node_type")
    return chain.groupBy(
        "node_type", "canonical_name", "analysis_id", "kg_node_id", "article_title",
        r6("confidence_score").alias("confidence_score"),
    ).agg(F.count(F.lit(1)).alias("n"))


# ---- stored graph ------------------------------------------------------------------------

_SPLIT = "1995-06-17"  # orders before this day are stored first, the others are folded in


def _stored(spark, sf):
    """All orders in a stored graph, in two batches; they are linked once, as an edge stays within its order."""
    # as many buckets as the session has partitions: a bucket is one task's work, written and read
    store = GraphStore(spark, fresh_dir(spark, "graph"), max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    turn = F.when(F.col("timestamp") < _SPLIT, 1).when(F.col("timestamp") >= _SPLIT, 2)
    # order lines are sent by analysis and then become nodes and edges, which are linked where they lie
    nodes = g.named_nodes(_unique_nodes(spark, sf, placed=True)).withColumn("part", turn)
    placed, linked = g.linked_graph(fl.complete_edges(t.kg_edges(spark, sf, placed=True)), nodes, ("part",))
    for batch in (1, 2):
        of = F.col("part") == batch
        store.upsert(batch, placed.where(of), linked.where(of).drop("part"), written=True)
    return store


_TURNS = _UNIQ + f""", turned AS (
  SELECT *, {{t: CASE WHEN timestamp < '{_SPLIT}' THEN 1 ELSE 2 END, s: useq}} AS pos FROM uniq)"""


@query("graph_store_nodes", f"""WITH {_TURNS}
SELECT node_type AS type, lower(arg_min(name, pos)) AS lname, arg_min(timestamp, pos) AS timestamp,
       arg_min(document_id, pos) AS document_id, CAST(count(*) AS BIGINT) AS mentions, arg_min(brand, pos) AS brand
FROM turned GROUP BY node_type, lower(name)""")
def graph_store_nodes(spark, sf):
    return _stored(spark, sf).nodes().select(
        "type", F.lower("name").alias("lname"), "timestamp", "document_id", "mentions",
        F.try_element_at("attributes", F.lit("brand")).alias("brand"),
    )


@query("graph_store_edges", f"""WITH {RESOLVED}, day AS (
  SELECT 'an_' || o_orderkey AS analysis_id, CASE WHEN strftime(o_orderdate, '%Y-%m-%d') < '{_SPLIT}' THEN 1 ELSE 2 END AS turn FROM orders),
f AS (SELECT src_type, src_name, relation, dst_type, dst_name, count(*) AS n, min({{t: turn, s: edge_seq}}) AS pos
      FROM resolved JOIN day USING (analysis_id) GROUP BY src_type, src_name, relation, dst_type, dst_name)
SELECT src_type, src_name, relation, dst_type, dst_name, CAST(n AS BIGINT) AS mentions, CAST(pos.t AS INTEGER) AS turn, CAST(pos.s AS BIGINT) AS place FROM f""")
def graph_store_edges(spark, sf):
    store = _stored(spark, sf)
    ends = store.nodes().select("node_id", "type", F.lower("name").alias("name"))
    return (
        store.edges().join(ends.toDF("src", "src_type", "src_name"), "src")
        .join(ends.toDF("dst", "dst_type", "dst_name"), "dst")
        .select("src_type", "src_name", "relation", "dst_type", "dst_name", "mentions", "turn", "place")
    )


@query("graph_store_sources", f"""WITH {_TURNS}, f AS (
  SELECT node_type, lower(name) AS lname, arg_min(document_id, pos) AS doc, min(pos) AS first FROM turned GROUP BY ALL)
SELECT u.node_type AS type, f.lname, CAST(count(*) AS BIGINT) AS further, CAST(count(DISTINCT document_id) AS BIGINT) AS documents
FROM turned u JOIN f ON f.node_type = u.node_type AND f.lname = lower(u.name)
WHERE pos <> first AND document_id <> doc GROUP BY u.node_type, f.lname""")
def graph_store_sources(spark, sf):
    store = _stored(spark, sf)
    names = store.nodes().select("node_id", "type", F.lower("name").alias("lname"))
    return (
        store.sources().groupBy("node_id")
        .agg(F.count(F.lit(1)).alias("further"), F.count_distinct("document_id").alias("documents"))
        .join(names, "node_id").drop("node_id")
    )


_SNAPSHOTS = """a AS (SELECT l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part, l_quantity AS quantity,
    l_returnflag AS flag FROM lineitem WHERE l_shipdate < DATE '1998-01-01'),
b AS (SELECT l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part,
    CASE WHEN l_suppkey = 7 THEN l_quantity + 1 ELSE l_quantity END AS quantity, l_returnflag AS flag
  FROM lineitem WHERE l_shipdate >= DATE '1992-03-01'),
ka AS (SELECT order_key, line, array_agg((part, quantity, flag) ORDER BY part, quantity, flag) AS v FROM a GROUP BY ALL),
kb AS (SELECT order_key, line, array_agg((part, quantity, flag) ORDER BY part, quantity, flag) AS v FROM b GROUP BY ALL)"""


@query("snapshot_changes", f"""WITH {_SNAPSHOTS}
SELECT coalesce(ka.order_key, kb.order_key) AS order_key, coalesce(ka.line, kb.line) AS line,
       CASE WHEN ka.v IS NULL THEN 'added' WHEN kb.v IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM ka FULL JOIN kb ON ka.order_key = kb.order_key AND ka.line = kb.line WHERE ka.v IS DISTINCT FROM kb.v""")
def snapshot_changes(spark, sf):
    """Changes between the order lines as shipped before 1998 and a later state, from two stored hash trees."""
    lines = t.table(spark, sf, "lineitem")
    columns = ["l_orderkey AS order_key", "l_linenumber AS line", "l_partkey AS part"]
    old = lines.where("l_shipdate < DATE '1998-01-01'").selectExpr(*columns, "l_quantity AS quantity", "l_returnflag AS flag")
    quantity = "CASE WHEN l_suppkey = 7 THEN l_quantity + 1 ELSE l_quantity END AS quantity"
    new = lines.where("l_shipdate >= DATE '1992-03-01'").selectExpr(*columns, quantity, "l_returnflag AS flag")
    left, right = fresh_dir(spark, "snapshot"), fresh_dir(spark, "snapshot")
    merkle.write_snapshot(old, ["order_key", "line"], left)
    merkle.write_snapshot(new, ["order_key", "line"], right)
    return merkle.changes(spark, left, right, ["order_key", "line"])
