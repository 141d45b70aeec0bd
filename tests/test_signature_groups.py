"""Candidates by three agreeing parts: nearest known signature, and the groups themselves."""

import duckdb
import pytest

import __spark_entry__ as entry
from eventloom.operators import events as ev

PARTS = "sig_actor string, sig_action string, sig_date string, sig_location string"


def _run(spark, order):
    """``order``: e.g. 'k0 n1', k known, n new, b both; the number is the date."""
    rows = [(x, x[0], ("a", "fired", f"2024-01-{int(x[1:]):02d}", "rome")) for x in order.split()]
    new = spark.createDataFrame([(x, *p) for x, side, p in rows if side in "nb"], f"new_id string, {PARTS}")
    known = spark.createDataFrame([(x, *p) for x, side, p in rows if side in "kb"], f"event_id string, {PARTS}")
    return new, known


def _pairs(spark, order):
    return sorted((r.new_id, r.event_id) for r in ev.signature_candidates(*_run(spark, order)).collect())


def test_new_ones_between_are_skipped(spark):
    got = _pairs(spark, "k0 n1 n2 n3 k4")
    assert got == [(n, k) for n in ("n1", "n2", "n3") for k in ("k0", "k4")]


def test_long_run_across_blocks(spark):
    got = _pairs(spark, " ".join(["k0", *[f"n{i}" for i in range(1, 29)], "k29"]))
    assert got == sorted((f"n{i}", k) for i in range(1, 29) for k in ("k0", "k29"))


def test_known_itself_is_no_candidate(spark):
    assert _pairs(spark, "k1 n2 b3 n4") == [("b3", "k1"), ("n2", "b3"), ("n2", "k1"), ("n4", "b3")]


def test_groups_hold_all_members(spark):
    got = ev.signature_groups(*_run(spark, "k0 n1 n2 b3")).where("differs_in = 'sig_date'").collect()
    assert {(r.sig_actor, r.sig_action, r.sig_date, r.sig_location) for r in got} == {("a", "fired", None, "rome")}
    assert sorted((r.odd_part[-2:], r.new_id, r.event_id) for r in got) == [
        ("00", None, "k0"), ("01", "n1", None), ("02", "n2", None), ("03", "b3", "b3"),
    ]


@pytest.mark.parametrize("name", ["signature_groups", "signature_candidates_all"])
def test_whole_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, sf).select(columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_every_hour_is_asked_about(spark, sf):
    rows = entry.queries()["signature_candidates_all"](spark, sf).select("new_id").distinct()
    hours = entry.queries()["recent_events"](spark, sf).join(rows.withColumnRenamed("new_id", "event_id"), "event_id")
    assert {int(r.last_updated[11:13]) % 3 for r in hours.collect()} == {0, 1, 2}
