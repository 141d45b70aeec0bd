import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAMPLE = [
    "event_weight", "signature_candidates", "unified_nodes", "doc_event_clusters", "doc_actor_links", "actor_sequence",
    "edge_upsert", "graph_hash", "temporal_edges_global", "entity_resolution", "weighted_relationships", "url_dedup",
    "attributes_first_wins_all", "event_node_attributes_all", "citation_all_kinds", "circuit_breaker", "content_budget", "citation_exact", "vector_typed_topk", "hmac_verify", "json_recovery",
]


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SAMPLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["sig_action", "sig_location"]


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, db, sf, name):
    df = entry.queries()[name](spark, sf)
    cur = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    want = in_order([tuple(r[columns.index(c)] for c in sorted(columns)) for r in cur.fetchall()])
    got = in_order([tuple(r[c] for c in sorted(columns)) for r in df.collect()])
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == pytest.approx(y, abs=1.001e-6) if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)


def in_order(rows):
    """Sorted by what is no double: doubles of the two engines may differ in the last decimal shown."""
    return sorted(rows, key=lambda r: (repr([x for x in r if not isinstance(x, float)]), repr(r)))
