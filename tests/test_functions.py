import hashlib
import hmac
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from eventloom.functions import citing, dates, fuzzy, hashing, maps, recovery, text


def one(spark, **cols):
    """Evaluate columns over one row."""
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def values(spark, rows, ddl, **cols):
    df = spark.createDataFrame(rows, ddl)
    return [tuple(r) for r in df.select(*[c.alias(k) for k, c in cols.items()]).collect()]


def test_signature(spark):
    row = one(
        spark,
        s=text.event_signature(
            text.normalize_actor(F.lit("Judge Patricia Dugan")), text.normalize_action(F.lit("taken into custody")),
            dates.normalize_date(F.lit("April 1, 2025")), text.normalize_location(F.lit("Washington DC")),
        ),
        title_inside=text.normalize_actor(F.lit("Judgeson Mr. X")),
        none=text.normalize_actor(F.lit(None).cast("string")),
    )
    assert row.s == "patricia_dugan|arrested|2025-04-01|washington_dc"
    assert row.title_inside == "son_x"
    assert row.none == ""


def test_signature_similarity(spark):
    sim = text.signature_similarity
    row = one(
        spark, full=sim(F.lit("a|b|c|d"), F.lit("a|b|c|d")), three=sim(F.lit("a|b|c|d"), F.lit("a|b|c|x")),
        empty_part=sim(F.lit("a|b|c|"), F.lit("a|b|c|")), missing=sim(F.lit(""), F.lit("a|b|c|d")),
    )
    assert (row.full, row.three, row.empty_part, row.missing) == (1.0, 0.75, 0.75, 0.0)


def test_date_inputs(spark):
    got = values(
        spark, [("January 20, 2025",), ("2025-02-15",), ("2025-04",), ("2026",), ("2025-13",), ("soon",), ("Mon, 03 Mar 2025 10:00:00 GMT",)],
        "d string", day=F.to_date(dates.parse_date_string(F.col("d"))).cast("string"),
    )
    assert [g[0] for g in got] == ["2025-01-20", "2025-02-15", "2025-04-01", "2026-01-01", None, None, "2025-03-03"]


def test_entry_date_order(spark):
    df = spark.createDataFrame(
        [("January 20, 2025", None, "https://x.gov/documents/2025/03/05/t"), (None, "2025-02-15", "https://x.gov/2025/03/05/"),
         (None, None, "https://example.gov/documents/2025/03/05/test"), (None, None, "https://x.gov/2025/13/45/a")],
        "fr_citation_date string, dc_date string, link string",
    )
    got = [str(r[0])[:10] for r in df.select(dates.entry_date(df.columns)).collect()]
    assert got == ["2025-01-20", "2025-02-15", "2025-03-05", "None"]


def test_scores(spark):
    loc, tmp = text.location_score, dates.temporal_score
    row = one(
        spark, same=loc(F.lit("NY, USA"), F.lit("ny , usa")), two=loc(F.lit("A, NY, USA"), F.lit("B, NY, USA")),
        last=loc(F.lit("Washington DC, USA"), F.lit("Washington, DC, USA")), none=loc(F.lit(""), F.lit("x")),
        d0=tmp(F.lit("2025-06-01"), F.lit("2025-06-01")), d1=tmp(F.lit("2025-06-01"), F.lit("2025-06-02")),
        d2=tmp(F.lit("2025-06-03"), F.lit("2025-06-01")), d9=tmp(F.lit("2025-06-01"), F.lit("2025-06-10")), na=tmp(F.lit("N/A"), F.lit("N/A")),
    )
    assert list(row) == [1.0, 0.6, 0.3, 0.0, 1.0, 0.8, 0.6, 0.0, 0.0]


def test_paragraph_dedup_marks_each_repeat(spark):
    row = one(spark, x=text.dedup_paragraphs(F.lit("A b\n\nc\n\na B\n\nd\n\nAB")))
    assert row.x.split("\n\n") == ["A b", "c", text.REPEAT_MARKER, "d", text.REPEAT_MARKER]


def test_fit_content(spark):
    long = "One two three. One two three. Four five. Six seven eight nine ten"
    row = one(spark, short=text.fit_content(F.lit("a. b. a"), 100), cut=text.fit_content(F.lit(long), 30), none=text.fit_content(F.lit("x" * 40), 10))
    assert row.short == "a. b. a"
    assert row.cut == "One two three. Four five."
    assert row.none == "x" * 10 + "..."


def test_indicators_and_scores(spark):
    got = values(
        spark, [("calm",), ("An autocratic style",), ("Elite capture, power concentration, democratic erosion",)], "t string",
        level=text.concern_level(text.indicators(F.col("t"))),
    )
    assert [g[0] for g in got] == ["LOW", "MEDIUM", "HIGH"]
    got = values(
        spark, [("Manipulation has a score of 7.5",), ("Score: 3",), ("it is 8 / 10",), ("nothing",)], "t string",
        s=text.manipulation_score(F.col("t")),
    )
    assert [g[0] for g in got] == [7.5, 3.0, 8.0, 0.0]


def test_titles_and_hosts(spark):
    got = values(
        spark,
        [("<title> A &amp; b</title>",), ('<meta property="og:title" content="Og"><title>x</title>',),
         ("<meta content='C' property='og:title'>",), ("",)],
        "h string", t=text.html_title(F.col("h")),
    )
    assert [g[0] for g in got] == ["A & b", "Og", "C", "Untitled"]
    row = one(
        spark, host=text.url_host(F.lit("https://www.a.com/x/big-news_story.html?q=1")),
        q=text.recovery_query(F.lit("https://www.a.com/x/big-news_story.html?q=1"), F.lit("A")),
        q2=text.recovery_query(F.lit("https://a.com/x/"), F.lit("A")), id=text.article_id(F.lit("u"), F.lit(5)),
    )
    assert row.host == "a.com" and row.q == "site:www.a.com big news story" and row.q2 == "site:a.com A"
    assert row.id == hashlib.md5(b"u").hexdigest()[:12] + "_5"


def test_actor_helpers(spark):
    none = F.lit(None).cast("array<string>")
    row = one(
        spark, listed=text.primary_actor(F.array(F.lit("A"), F.lit("B")), F.lit("")),
        told=text.primary_actor(none, F.lit("The FBI arrested Bob")), unknown=text.primary_actor(none, F.lit("x")),
        node=text.node_actor(F.create_map(F.lit("primary_actor"), F.lit('["Z","Y"]'))), title=text.title_actor(F.lit("Gov signs bill signs")),
    )
    assert list(row) == ["A", "The FBI", "Unknown", "Z", "Gov"]


def test_validation(spark):
    rounds = "array<struct<name string, response string, error string>>"
    full = [("fact_extraction", "{}", None), ("article_analysis", "ok", None), ("node_extraction", "[]", None)]
    got = spark.createDataFrame(
        [("TESTING", full), ("PRODUCTION", full), ("PRODUCTION", full[:2]), ("PRODUCTION", full[:2] + [("node_extraction", "ERROR: x", "x")])],
        f"status string, rounds {rounds}",
    ).select(text.validation(F.col("status"), F.lit(True), F.col("rounds")).alias("v")).select("v.status", "v.reason").collect()
    assert [g.status for g in got] == ["REVIEW", "VALID", "FAILED", "FAILED"]
    assert got[3].reason == "Failed validation checks: required_fields, no_llm_errors"


def test_prompt_and_tokens(spark):
    row = one(
        spark, p=text.render_prompt("{{x}} {a}-{b}", {"a": F.lit("{b}"), "b": F.lit(None).cast("string")}),
        tiny=text.output_budget(F.lit("x" * 40000), F.lit(2000), F.lit(4096)), big=text.output_budget(F.lit("x"), F.lit(2000), F.lit(32768)),
        think=text.strip_reasoning(F.lit("hm </think> yes </think> no")),
    )
    assert (row.p, row.tiny, row.big, row.think) == ("{x} {b}-", 512, 2000, "yes </think> no")


def test_node_text(spark):
    row = one(
        spark, t=text.node_text(
            F.lit("actor"), F.lit("Bob"), F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit("[1]"), F.lit("b"), F.lit("x")), F.lit("He ran."),
        ),
    )
    assert row.t == "Type: actor Name: Bob b: x z: 1 Context: He ran."


@pytest.mark.parametrize(
    "answer, as_list, as_dict",
    [
        ('```json\n[{"a":1}]\n```', '[{"a":1}]', '{"a":1}'),
        ('Sure: [{"node_type":"x","name":"y"}] ok', '[{"node_type":"x","name":"y"}]', '{"node_type":"x","name":"y"}'),
        ('[{"a":1}', '[{"a":1}]', '{"a":1}'),
        ('JSON: {"a": 1', None, '{"a": 1}'),
        ("none", None, None),
        ('"node_type": "actor", "name": "Q" rest', '[{"node_type":"actor","name":"Q","attributes":{}}]', None),
    ],
)
def test_json_recovery(spark, answer, as_list, as_dict):
    row = one(spark, l=recovery.recover_json(F.lit(answer), "list"), d=recovery.recover_json(F.lit(answer), "dict"))
    assert (row.l, row.d) == (as_list, as_dict)


def test_maps(spark):
    df = spark.createDataFrame([("k", 1, {"a": "1", "b": "1"}), ("k", 2, {"a": "2", "c": "2"})], "k string, s int, m map<string,string>")
    last = maps.merge_maps(df, ["k"], "m", F.col("s"), True).first().m
    first = maps.merge_maps(df, ["k"], "m", F.col("s"), False).first().m
    assert last == {"a": "2", "b": "1", "c": "2"} and first == {"a": "1", "b": "1", "c": "2"}
    row = one(spark, o=maps.overlay(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"))))
    assert row.o == {"a": "2"}
    row = one(
        spark, l=maps.list_or_map(F.lit('[{"id":1}]'), "struct<id string>"), m=maps.list_or_map(F.lit('{"x":{"id":2}}'), "struct<id string>"),
    )
    assert row.l[0].id == "1" and row.m[0].id == "2"


def test_hashing(spark):
    key = hashing.derive_key("s", b"salt")
    want = hmac.new(key, "häß".encode(), hashlib.sha256).hexdigest()
    row = one(spark, a=hashing.hmac_sha256(F.lit("häß"), key), b=hashing.hmac_sha256_private(F.lit("häß"), key))
    assert row.a == want and row.b == want
    row = one(spark, j=hashing.joined_id(F.array(F.lit("b"), F.lit("a"))))
    assert row.j == hashlib.sha256(b"a:b").hexdigest()


def test_multiset_digest_ignores_order_and_sees_change(spark):
    def digest(rows):
        df = spark.createDataFrame(rows, "a string, b string")
        return df.select(hashing.row_digest(df.columns).alias("h")).agg(hashing.multiset_digest(F.col("h"))).first()[0]

    base = [("x", "1"), ("y", None), ("y", None)]
    assert digest(base) == digest(base[::-1])
    assert digest(base) != digest(base[:2])
    assert digest([("x", "12")]) != digest([("x1", "2")])


def test_citation_steps(spark):
    src = "Hello World. The quick-brown Fox, jumps.\n\nThen Dr Smith aaaa"
    row = one(
        spark, e=citing.exact_match(F.lit("hello"), F.lit(src)), n=citing.normalized_match(F.lit("quick brown fox jumps"), F.lit(src)),
        p=citing.partial_entity_match(F.lit("Bob Smith"), F.lit(src)), o=citing.all_occurrences(F.lit("AA"), F.lit(src), 5),
        miss=citing.normalized_match(F.lit("!!"), F.lit(src)),
    )
    assert tuple(row.e) == (0, 5, 1.0, "exact")
    assert src[row.n.pos : row.n.pos + row.n.len] == "quick-brown Fox, jumps" and row.n.confidence == 0.9
    assert src[row.p.pos : row.p.pos + row.p.len] == "Smith"
    first = src.index("aaaa")
    assert row.o == [first, first + 1, first + 2] and row.miss is None
    s = one(spark, s=citing.span(F.lit(src), F.lit(first), F.lit(2), F.lit(1.0), F.lit("exact"))).s
    assert (s.paragraph_num, s.sentence_num, s.source_text) == (2, 3, "aa")
    assert s.context == src[max(0, first - 50) : first + 52]


def brute_window(quote, source):
    clean = quote.strip('"\n ')
    best, at = 0.0, -1
    for i in range(len(source) - len(clean) + 1):
        r = SequenceMatcher(None, clean.lower(), source[i : i + len(clean)].lower()).ratio()
        if r > 0.85 and r > best:
            best, at = r, i
            if r > 0.9:
                break
    return None if at < 0 else (at, len(clean), best)


@pytest.mark.parametrize("quote", ["quick brown fix jump", '"lazy dogs sleeps"', "zzzz", "THE QUICK", "a" * 300])
def test_fuzzy_window_equals_brute_force(quote):
    source = "The quick brown fox jumped over it while lazy dog sleeps; the quick brawn fox jumps."
    assert fuzzy.best_window(quote, source) == brute_window(quote, source)
