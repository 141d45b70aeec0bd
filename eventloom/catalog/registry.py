"""Registered queries: name -> Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, as in the SQL."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- shared SQL: the domain frames of sources/tables.py ------------------------------------

MENTIONS = """mentions AS (
  SELECT event_id AS mention_seq, 'an_' || user_id AS analysis_id,
         'doc_' || (event_id % 200) AS document_id, 'User ' || user_id AS actor,
         event_type AS action, 'User ' || user_id || ' ' || event_type AS name,
         strftime(ts, '%Y-%m-%d') AS date_raw,
         'loc ' || json_extract_string(props, '$.k') AS location,
         'src' || (user_id % 10) AS source_name,
         CASE user_id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'center' WHEN 2 THEN 'right' END AS source_bias,
         value / 500 AS confidence, ts
  FROM events)"""

SIGNED = MENTIONS + """, signed AS (
  SELECT *, lower(replace(actor, ' ', '_')) AS sig_actor,
         CASE WHEN lower(action) IN ('detained', 'taken into custody', 'apprehended') THEN 'arrested'
              WHEN lower(action) IN ('dismissed', 'removed', 'terminated') THEN 'fired'
              WHEN lower(action) IN ('approved', 'enacted', 'adopted') THEN 'passed'
              ELSE lower(action) END AS sig_action,
         date_raw AS sig_date, lower(replace(location, ' ', '_')) AS sig_location
  FROM mentions)"""

ORDER_MENTIONS = """order_mentions AS (
  SELECT o_orderkey * 2 + i AS mention_seq, 'an_' || o_orderkey AS analysis_id,
         'doc_' || o_custkey AS document_id, 'Order ' || o_orderpriority AS name,
         strftime(o_orderdate, '%Y-%m') AS date_raw
  FROM orders, (VALUES (0), (1)) AS copies(i)
  WHERE i = 0 OR o_orderstatus = 'F')"""

NODES = """kg_nodes AS (
  SELECT 'an_' || l_orderkey AS analysis_id, 'doc_' || o_custkey AS document_id,
         l_orderkey * 100 + l_linenumber * 2 + 2 AS node_seq, 'p' || l_partkey AS local_id,
         'part' AS node_type, p_name AS name, 1 - l_discount AS confidence,
         strftime(o_orderdate, '%Y-%m-%d') AS timestamp, p_brand AS brand, p_type AS kind
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT 'an_' || l_orderkey, 'doc_' || o_custkey, l_orderkey * 100 + l_linenumber * 2 + 3,
         's' || l_suppkey, 'supplier', s_name, 1 - l_discount, strftime(o_orderdate, '%Y-%m-%d'), NULL, NULL
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT 'an_' || o_orderkey, 'doc_' || o_custkey, o_orderkey * 100, 'e', 'event',
         'Order ' || o_orderpriority, 1.0, strftime(o_orderdate, '%Y-%m-%d'), NULL, NULL
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT 'an_' || o_orderkey, 'doc_' || o_custkey, o_orderkey * 100 + 1, 'c', 'customer', c_name,
         0.5 + (o_custkey % 50) / 100, strftime(o_orderdate, '%Y-%m-%d'), NULL, NULL
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

EDGES = """kg_edges AS (
  SELECT 'an_' || l_orderkey AS analysis_id, l_orderkey * 100 + l_linenumber * 2 + 2 AS edge_seq,
         'c' AS source_id, 'buys' AS relation, 'p' || l_partkey AS target_id,
         1 - l_discount AS confidence, l_returnflag || l_linestatus AS evidence_quote
  FROM lineitem
  UNION ALL
  SELECT 'an_' || l_orderkey, l_orderkey * 100 + l_linenumber * 2 + 3, 's' || l_suppkey, 'supplies',
         'p' || l_partkey, 1 - l_discount, l_returnflag || l_linestatus
  FROM lineitem
  UNION ALL
  SELECT 'an_' || o_orderkey, o_orderkey * 100, 'c', 'performs', 'e', 1.0, o_orderpriority
  FROM orders)"""

# every attribute of every payload node, a row each; seq is the place of the node, unique per node
ATTRIBUTES = NODES + """, attrs AS (
  SELECT analysis_id, node_type, lower(name) AS lname, node_seq * 1000000 + CAST(substr(local_id, 2) AS BIGINT) AS seq,
         'brand' AS attribute, brand AS value FROM kg_nodes WHERE node_type = 'part'
  UNION ALL
  SELECT analysis_id, node_type, lower(name), node_seq * 1000000 + CAST(substr(local_id, 2) AS BIGINT), 'kind', kind
  FROM kg_nodes WHERE node_type = 'part'
  UNION ALL
  SELECT 'an_' || l_orderkey, 'supplier', lower(s_name), (l_orderkey * 100 + l_linenumber * 2 + 3) * 1000000 + l_suppkey,
         'flag', l_returnflag
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT 'an_' || o_orderkey, 'event', 'order ' || lower(o_orderpriority), o_orderkey * 100 * 1000000, 'status', o_orderstatus
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT 'an_' || o_orderkey, 'customer', lower(c_name), (o_orderkey * 100 + 1) * 1000000, 'segment', c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

RESOLVED = NODES + ", " + EDGES + """, ids AS (
  SELECT analysis_id, local_id, min(node_type) AS node_type, min(lower(name)) AS lname
  FROM kg_nodes GROUP BY ALL),
resolved AS (
  SELECT e.*, s.node_type AS src_type, s.lname AS src_name, d.node_type AS dst_type, d.lname AS dst_name
  FROM kg_edges e
  JOIN ids s ON s.analysis_id = e.analysis_id AND s.local_id = e.source_id
  JOIN ids d ON d.analysis_id = e.analysis_id AND d.local_id = e.target_id)"""

ARTICLES = """articles AS (
  SELECT doc_id, text AS content, source, lang,
         CASE WHEN doc_id % 20 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) END AS published,
         doc_id % 3 = 0 AS via_google_news, doc_id % 5 = 0 AS via_gdelt, doc_id % 7 = 0 AS via_gov_api
  FROM documents)"""
