import itertools

import pytest
from fixtures import EVENT, analyses_frame, edge, node, two_stage_rows
from pyspark.sql import functions as F

from eventloom.operators import document_events as doc
from eventloom.operators import events as ev
from eventloom.operators import ordered
from eventloom.plans import aggregation as agg


@pytest.mark.parametrize(
    "dedupe, entries, actor, event, analyses", [(False, 6, 5.5, 5.1, 6), (True, 3, 2.75, 2.55, 3)]
)
def test_two_stage_aggregation(spark, dedupe, entries, actor, event, analyses):
    result = agg.aggregate_events(analyses_frame(spark, two_stage_rows()), dedupe)
    groups = result.groups.collect()
    assert {g.event_key for g in groups} == {"climate executive order signing_2025-01-24"}
    assert sum(g.n_mentions for g in groups) == entries
    weights = {(r.node_type, r.lname): round(r.weight, 6) for r in result.event_nodes.collect()}
    assert weights == {("actor", "president biden"): actor, ("event", EVENT.lower()): event}
    assert [round(r.weight, 6) for r in result.event_edges.collect()] == [event]
    member = result.members.first()
    assert (member.contributing_analyses, member.documents) == (analyses, 3)
    assert tuple(result.stats.first()) == (2, 1, 1, 3)
    names = {r.name for r in result.nodes.collect()}
    assert names == {"President Biden", EVENT}


def test_aggregation_lineage_is_order_free(spark):
    rows = two_stage_rows()
    ids = []
    for order in (rows, rows[::-1]):
        a = analyses_frame(spark, order)
        record, parts = agg.aggregation_lineage(a, agg.aggregate_events(a))
        ids.append(record.first().aggregation_id)
        assert parts.count() == 6
    assert ids[0] == ids[1]


def document_rows():
    article = {"document_id": "d1", "source": "S", "title": "News", "published": "2025-01-24"}
    return [
        {
            "analysis_id": "a1", "article": article,
            "facts_data": {"events": [{"name": "President signs executive order", "date": "2025-01-24", "actors": ["President"],
                                       "description": "President signed EO limiting protests"}]},
            "kg_payload": {"nodes": [node(1, "actor", "President"), node(2, "target", "Protesters")], "edges": [edge(1, "targets", 2)]},
        },
        {
            "analysis_id": "a2", "article": article,
            "kg_payload": {
                "nodes": [node(1, "narrative", "Maintaining public order"),
                          node(2, "event", "Executive order signed", timestamp="2025-01-24", attributes={"actor": "President"})],
                "edges": [edge(1, "justifies", 2)],
            },
        },
    ]


def test_document_aggregation(spark):
    g = agg.aggregate_documents(analyses_frame(spark, document_rows()))
    events = g.events.collect()
    assert len(events) == 1 and events[0].source_count == 2
    assert events[0].name == "President signs executive order"
    assert events[0].description == "President signed EO limiting protests"
    assert {r.node_type for r in g.nodes.collect()} == {"event", "actor", "narrative", "target"}
    edges = {(e.src_name, e.relation, e.dst_name) for e in g.edges.collect()}
    assert edges == {
        ("President", "performs", "President signs executive order"),
        ("President", "targets", "Protesters"),
        ("Maintaining public order", "justifies", "President signs executive order"),
    }


def test_headline_mention(spark):
    rows = [{"analysis_id": "a", "article": {"document_id": "d", "title": "Governor signs bill", "published": "2025-02-01"}}]
    m = ev.extract_mentions(analyses_frame(spark, rows), titles=True, normalize=True).first()
    assert (m.name, m.actors, m.action, m.date_raw) == ("Governor signs bill", ["Governor"], "signs", "2025-02-01")


def test_missing_dates_differ_between_facts_and_graph(spark):
    rows = [{"analysis_id": "a", "document_id": "d", "facts_data": {"events": [{"name": "X"}]},
             "kg_payload": {"nodes": [node(1, "event", "X")], "edges": []}}]
    m = ev.extract_mentions(analyses_frame(spark, rows))
    assert {r.date_raw for r in m.collect()} == {"", "N/A"}


OBS = "event string, source_name string, source_bias string, date_raw string"


@pytest.mark.parametrize(
    "rows, weight, diversity, consistency, confidence, sources",
    [
        ([("A", "left", "2025-04-01"), ("B", "right", "2025-04-01")], 2.0, 1.0, 1.0, 1.0, 2),
        ([("A", "left", "d1"), ("B", "left", "d1"), ("C", "right", "d2")], 1.0, 0.666667, 0.5, 0.722222, 3),
        ([("A", None, "d1")], 0.0, 0.0, 1.0, 0.666667, 1),
        ([("A", "left", "d1"), (None, "left", None)], 0.5, 0.5, 0.5, 0.666667, 2),
        ([("A", "left", None), ("A", "", None)], 1.0, 0.5, 1.0, 0.833333, 1),
    ],
)
def test_event_weight(spark, rows, weight, diversity, consistency, confidence, sources):
    got = ev.event_weights(spark.createDataFrame([("e", *r) for r in rows], OBS), ["event"]).first()
    assert round(got.weight, 6) == weight and round(got.source_diversity, 6) == diversity
    assert got.temporal_consistency == consistency and round(got.confidence_score, 6) == confidence
    assert got.unique_sources == sources


def signed(spark, rows):
    return ev.with_signature(spark.createDataFrame(rows, "mention_seq long, actor string, action string, date_raw string, location string"))


def test_signature_match_and_candidates(spark):
    new = signed(spark, [(1, "Bob", "arrested", "2025-01-01", "NY"), (2, "Bob", "arrested", "2025-01-02", "NY"), (3, "Bob", "arrested", "2025-01-01", "")])
    old = signed(spark, [(9, "bob", "detained", "2025-01-01", "ny"), (8, "bob", "detained", "2025-01-01", "")]).select(
        F.col("mention_seq").cast("string").alias("event_id"), *ev.SIGNATURE_PARTS, "signature", F.col("mention_seq").alias("last_updated")
    )
    hits = ev.signature_matches(new, old).select("mention_seq", "matched_event_id").collect()
    assert [tuple(h) for h in hits] == [(1, "9")]
    near = ev.signature_candidates(new.withColumnRenamed("mention_seq", "new_id"), old)
    assert {(r.new_id, r.event_id, r.differs_in) for r in near.collect()} == {
        (1, "8", "sig_location"), (2, "9", "sig_date"), (3, "9", "sig_location"), (3, "8", "sig_location"),
    }
    many = spark.range(10_000).select(
        F.col("id").alias("new_id"), F.lit("a").alias("sig_actor"), F.lit("b").alias("sig_action"),
        F.col("id").cast("string").alias("sig_date"), F.lit("c").alias("sig_location"),
    )
    stored = many.withColumn("event_id", F.col("new_id").cast("string")).drop("new_id")
    assert ev.signature_candidates(many, stored).count() == 2 * 9_999
    obs = ev.attach_observations(new.withColumnRenamed("mention_seq", "observation_id"), old)
    got = {r.observation_id: (r.event_id, r.is_new) for r in obs.collect()}
    assert got[1] == ("9", False) and got[2][1] and got[3][1] and got[2][0] != got[3][0]


PAIR = "name1 string, date1 string, location1 string, description1 string, name2 string, date2 string, location2 string, description2 string"


@pytest.mark.parametrize(
    "pair, threshold, score",
    [
        (("Protest in Washington", "2025-06-01", "Washington DC, USA", "Mass protest",
          "Protest rally Washington", "2025-06-01", "Washington, DC, USA", "Large protest"), 0.7, 0.780667),
        (("Court ruling", "2025-06-01", "NY, USA", None, "Court ruling", "2025-06-02", "NY, USA", None), 0.7, 0.78),
        (("Election results", "2025-06-01", "CA, USA", None, "Election results", "2025-06-10", "CA, USA", None), 0.8, None),
        (("Same", "2025-06-01", "NY", None, "Same", "2025-06-01", "NY", None), 0.8, None),
    ],
)
def test_event_similarity(spark, pair, threshold, score):
    got = ev.score_pairs(spark.createDataFrame([pair], PAIR), threshold).first()
    assert (None if got is None else round(got.score, 6)) == score


def mentions_frame(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "mention_seq long, document_id string, actors array<string>, action string, date_raw string, location string, name string, description string",
    )


MENTIONS = [
    ("d", ["A"], "x", "2025-01-01", "L", "n0", ""),
    ("d", ["a", "B"], "X", "2025-01-01", "M", "n1", "later"),
    ("d", ["C"], "y", "", "L", "n2", ""),
    ("d", ["C"], "z", "2025-01-02", "L", "n3", ""),
    ("d", ["C"], "z", "2025-01-03", "L", "n4", ""),
    ("d", [], "q", "2025-01-01", "", "n5", ""),
    ("d", [], "Q", "", "", "n6", ""),
    ("e", ["A"], "x", "2025-01-01", "L", "n7", ""),
    ("d", ["B"], "w", "2025-01-01", "M", "n8", ""),
    ("d", [], "", "2025-01-01", "L", "n9", ""),
]


def brute_match(a, b):
    if a[0] != b[0] or (a[3] and b[3] and a[3] != b[3]):
        return False
    score = float(bool({x.lower() for x in a[1]} & {x.lower() for x in b[1]}))
    score += float(bool(a[2]) and bool(b[2]) and a[2].lower() == b[2].lower()) + 0.5 * (a[4] == b[4])
    return score >= 1.5


def test_document_matches_equal_brute_force(spark):
    m = mentions_frame(spark, MENTIONS)
    n = len(MENTIONS)
    want = {i: min([j for j in range(i) if brute_match(MENTIONS[i], MENTIONS[j])] + [i]) for i in range(n)}
    assert {r.mention_seq: r.first_seq for r in doc.first_matches(m).collect()} == want
    root = list(range(n))
    for _ in range(n):
        for i, j in itertools.combinations(range(n), 2):
            if brute_match(MENTIONS[i], MENTIONS[j]):
                root[i] = root[j] = min(root[i], root[j])
    got = {r.mention_seq: r.cluster for r in doc.clusters(m).collect()}
    assert got == dict(enumerate(root))
    merged = {r.cluster: r for r in doc.merged_events(m, doc.clusters(m)).collect()}
    assert merged[0].description == "later" and merged[0].source_count == root.count(0)


def test_links_inside_documents(spark):
    nodes = spark.createDataFrame(
        [("d", "actor", "Bob"), ("d", "actor", "bob"), ("d", "narrative", "The LAW is law"), ("e", "actor", "Bob")],
        "document_id string, node_type string, name string",
    )
    events = spark.createDataFrame([("d", "Bobby law passes here now")], "document_id string, name string")
    assert [(r.src_name, r.dst_name) for r in doc.actor_links(nodes, events).collect()] == [("Bob", "Bobby law passes here now")]
    assert [r.src_name for r in doc.narrative_links(nodes, events).collect()] == ["The LAW is law"]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_blocked_ranks_and_next(spark, parts):
    rows = [("hot" if i % 3 else f"k{i % 5}", (i * 7) % 101, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, id int").repartition(parts)
    ranks = {r.id: r["rank"] for r in ordered.ranks(df, ["k"], ["o", "id"]).collect()}
    nexts = {r.id: (r.next.id if r.next else None) for r in ordered.with_next(df, ["k"], ["o", "id"], ["id"]).collect()}
    for key in {r[0] for r in rows}:
        line = [i for _o, i in sorted((o, i) for k, o, i in rows if k == key)]
        for place, i in enumerate(line):
            assert ranks[i] == place + 1
            assert nexts[i] == (line[place + 1] if place + 1 < len(line) else None)
