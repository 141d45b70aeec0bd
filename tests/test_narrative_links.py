"""Links of narratives come once without a shuffle of the links."""

from eventloom.operators import document_events as doc

EVENTS = [(1, "Bob votes bob twice"), (1, "votes votes no"), (1, "  "), (1, None), (2, "Bob votes"), (1, "a b"), (1, "Bob votes bob twice")]
STORIES = [(1, "Why BOB votes"), (1, "why bob votes"), (1, "No votes"), (2, "none"), (3, "Bob"), (1, "twice"), (1, "")]


def frames(spark):
    nodes = [(d, "narrative", n) for d, n in STORIES] + [(1, "actor", "Bob")]
    return (spark.createDataFrame(nodes, "document_id int, node_type string, name string"),
            spark.createDataFrame(EVENTS, "document_id int, name string"))


def test_links_are_distinct(spark):
    got = [(r.document_id, r.src_name, r.dst_name) for r in doc.narrative_links(*frames(spark)).collect()]
    want = {(d, s, e) for d, s in STORIES for f, e in EVENTS if d == f and e
            for w in [w for w in e.lower().split() if w][:3] if w in s.lower()}
    assert set(got) == want and len(got) == len(want)


def test_links_are_not_shuffled(spark):
    plan = doc.narrative_links(*frames(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]
