"""Spans that the trees add: secrets, undone writings; clean texts stay clean."""

import random

import pytest

from eventloom.llm import pii

GIVEN = list(pii.GENERATORS)


@pytest.fixture(scope="module")
def added(spark):
    draw = random.Random(3)
    hexed = lambda n: "".join(draw.choices("0123456789abcdef", k=n))
    rows = {}
    for i in range(120):
        rows[i] = f'and token = "{hexed(40)}" of it'
        rows[200 + i] = f"write to user{i}@mail{i % 7}.example.com soon"
        rows[400 + i] = f"call +1 (2{i % 90 + 10}) 555-{1000 + i} now"
        rows[600 + i] = f"the host 10.{i}.7.{i + 3} was"
        rows[1000 + i] = f"plain words of version {i}.2 in state-of-the-art-tools{i} and page {i * 1000003} end"
    rows[800] = f"left lying {hexed(40)} here"  # a secret nobody names
    rows[801] = "write to anna.b (at) mail3 (dot) example (dot) com soon"
    rows[802] = "call (245) 555-1009 now"
    rows[803] = "the host 10[.]3[.]7[.]9 was"
    rows[804], rows[805] = None, ""
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    return rows, {r.doc_id: r for r in pii.find(docs).collect()}


def spans(rows, r):
    return [(GIVEN[k - len(pii.KINDS)], rows[r.doc_id][s:e]) for s, k, e in r.added]


def test_secrets(added):
    rows, found = added
    hit = sum([g for g, _ in spans(rows, found[i])] == ["secret"] or bool(found[i].base) for i in range(120))
    assert hit >= 118
    assert [g for g, _ in spans(rows, found[800])] == ["secret"] and spans(rows, found[800])[0][1] in rows[800]


def test_writings_undone_are_labelled(spark):
    texts = {
        1: "write to anna.b (at) mail3 (dot) example (dot) com soon", 2: "anna at example dot com", 3: "call (245) 555-1009 now",
        4: "00442079460958 rings", 5: "host 10[.]3[.]7[.]9 was", 6: "card 4111.1111.1111.1111 paid", 7: "look at home. Then dot",
        8: "card 4111.1111.1111.1112 paid", 9: "host 10[.]3[.]7[.]900", 10: "wait (245) 5-1009000001 on",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    scanned = {r.row: any(c.label and not c.held for c in r.candidates) for r in pii.scan(docs, docs["doc_id"], docs["text"]).collect()}
    assert [i for i in texts if scanned[i]] == [1, 2, 3, 4, 5, 6]


def test_clean_texts_stay(added):
    rows, found = added
    assert all(not found[i].added and not found[i].base for i in range(1000, 1120))
    assert found[804].base == found[804].added == found[805].base == found[805].added == []


def test_base_spans_stay(added):
    rows, found = added
    assert all(len(found[i].base) == 1 for i in [*range(200, 320), *range(400, 520), *range(600, 720)])
