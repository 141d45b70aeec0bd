"""Fuzzy event pairs equal all pairs, scored one by one."""

import datetime as dt
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest

from eventloom.functions import fuzzy
from eventloom.operators import fuzzy_pairs as fp

DDL = "event_id long, name string, description string, date string, location string"


def ratio(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    m = SequenceMatcher(None, a, b)
    return m.ratio() if m.quick_ratio() > 0.2 else 0.2


def gap_score(a, b):
    try:
        gap = (dt.datetime.fromisoformat(a) - dt.datetime.fromisoformat(b)).total_seconds() // 86400
    except (TypeError, ValueError):
        return 0.0
    return {0: 1.0, 1: 0.8, 2: 0.6}.get(abs(gap), 0.0)


def place_score(a, b):
    if not (a or "").strip() or not (b or "").strip():
        return 0.0
    x, y = ([p.strip().lower() for p in s.split(",")] for s in (a, b))
    if x == y:
        return 1.0
    if len(x) > 1 and len(y) > 1 and x[-2:] == y[-2:]:
        return 0.6
    return 0.3 if x[-1] == y[-1] else 0.0


def brute(rows, threshold):
    first = {}
    for r in sorted(rows):
        first.setdefault(r[1:], r[0])
    classes = sorted((i, *fields) for fields, i in first.items())
    found = {}
    for i, a in enumerate(classes):
        for b in classes[i + 1 :]:
            low = [(x or "").lower() for x in (a[1], b[1], a[2], b[2])]
            if threshold <= 0.8 and low[0] == low[1] != "" and low[2] == low[3] != "":
                continue
            rest = 0.1 * gap_score(a[3], b[3]) + 0.1 * place_score(a[4], b[4])
            name = ratio(low[0], low[1])
            if 0.6 * name + 0.2 + rest < threshold - 1e-6:
                continue
            description = ratio(low[2], low[3])
            score = 0.6 * name + 0.2 * description + 0.1 * gap_score(a[3], b[3]) + 0.1 * place_score(a[4], b[4])
            if score >= threshold:
                found[a[0], b[0]] = round(score, 9)
    return found, len(classes)


def events(count, seed=1):
    draw = random.Random(seed)
    words = "court rules on budget vote senate mayor strike signs bill protest in rome paris judge arrests leader of union talks end".split()
    places = ["Rome, Italy", "rome , italy", "Milan, Italy", "Paris, France", "Lyon, Rhone, France", "France", "", None, "Oslo"]
    names = [" ".join(draw.choices(words, k=draw.randrange(1, 6))) for _ in range(count // 5)] + ["", None, "É", "aaaa", "aaab"]
    told = [" ".join(draw.choices(words, k=draw.randrange(2, 9))) for _ in range(12)] + ["", None]

    def changed(text):
        if not text or draw.random() < 0.5:
            return text
        i = draw.randrange(len(text))
        return (text[:i] + draw.choice(["", "x", "Q", " the"]) + text[i + draw.randrange(0, 4) :])

    rows = []
    for i in range(count):
        day = dt.date(2025, 1, 1) + dt.timedelta(days=draw.randrange(6))
        date = draw.choice([day.isoformat(), day.isoformat(), f"{day}T{draw.randrange(24):02d}:30:00", "", "N/A", "soon", None])
        rows.append((i, changed(draw.choice(names)), changed(draw.choice(told)), date, draw.choice(places)))
    return rows + [(count + i, *rows[i][1:]) for i in range(10)]


@pytest.mark.parametrize("threshold", [0.8, 0.7])
def test_equals_all_pairs(spark, threshold):
    rows = events(500)
    classes, members = fp.event_classes(spark.createDataFrame(rows, DDL).repartition(3))
    want, count = brute(rows, threshold)
    assert classes.count() == count
    got = {(r.id1, r.id2): round(r.score, 9) for r in fp.fuzzy_event_pairs(classes, threshold).collect()}
    assert got == want and len(want) > 1
    belongs = {r.event_id: r.class_id for r in members.collect()}
    assert len(belongs) == len(rows) and all(belongs[i] == min(j for j in belongs if rows[j][1:] == rows[i][1:]) for i in belongs)
    if threshold == 0.8:
        assert fp.candidates(classes, threshold).count() < 0.25 * count * (count - 1) / 2


def test_empty_and_nameless(spark):
    classes, members = fp.event_classes(spark.createDataFrame([], DDL))
    assert fp.fuzzy_event_pairs(classes).collect() == [] and members.collect() == []
    rows = [(1, None, "d", "2025-01-01", "X"), (2, "", "d", "2025-01-01", "X"), (3, None, "d", "2025-01-02", "X")]
    assert fp.fuzzy_event_pairs(fp.event_classes(spark.createDataFrame(rows, DDL))[0]).collect() == []
    with pytest.raises(ValueError, match="threshold"):
        fp.candidates(classes, 0.3)


def test_characters_in_common_are_counted_without_tokens(spark):
    names = ["", "a", "aab", "abb", "é𝄞𝄞 e", "e 𝄞é", "line\nline", "ne\nli", "$1.*", ".*$"]
    pairs = [(a, b, len(a), len(b)) for a in names for b in names]
    df = spark.createDataFrame(pairs, "lname_a string, lname_b string, length_a int, length_b int")
    for ratio in (0.3, 2 / 3, 5 / 6, 1.0):
        want = [(a, b) for a, b, n, m in pairs if 2 * sum((Counter(a) & Counter(b)).values()) >= ratio * (n + m) - fp.EASE]
        held = df.where(fp._share_enough(ratio))
        assert sorted(tuple(r)[:2] for r in held.collect()) == sorted(want)
        assert "array_position" not in held._jdf.queryExecution().analyzed().toString()


def test_characters_are_counted_behind_the_join(spark):
    classes, _ = fp.event_classes(spark.createDataFrame(events(40), DDL))
    plan = fp.near_pairs(classes, fp.ordered_names(classes), 2 / 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("aggregate(") < plan.index("Aggregate [") < plan.index("Join Inner")


def test_all_pairs_of_events_are_found(spark, monkeypatch):
    """Events of one class, of equal name and description, and behind the first of a class; ids that come twice or lack."""
    monkeypatch.setattr(fp, "DEALT", 3)
    monkeypatch.setattr(fp, "LEAST", 8)
    rows = events(120, 3)
    rows += [(300 + i, "Budget vote in Rome", "The senate votes", f"2025-01-0{1 + i % 5}", "Rome, Italy") for i in range(10)]
    rows += [(320 + i, *row[1:]) for i, row in enumerate(rows[-4:])]
    want = {}
    for i, a in enumerate(sorted(rows, key=lambda r: r[0])):
        for b in sorted(rows, key=lambda r: r[0])[i + 1 :]:
            low = [(x or "").lower() for x in (a[1], b[1], a[2], b[2])]
            score = 0.6 * ratio(low[0], low[1]) + 0.2 * ratio(low[2], low[3]) + 0.1 * gap_score(a[3], b[3]) + 0.1 * place_score(a[4], b[4])
            if score >= 0.8:
                want[a[0], b[0]] = round(score, 9)
    held = spark.createDataFrame([*rows, rows[0], (None, *rows[-1][1:])], DDL).repartition(3)
    classes, _ = fp.event_classes(held)
    got = [(r.id1, r.id2, round(r.score, 9)) for r in fp.fuzzy_event_pairs(classes, events=held).collect()]
    assert {(a, b): score for a, b, score in got} == want and len(got) == len(want)
    assert len(want) > len(fp.fuzzy_event_pairs(classes).collect()) + 50


def test_registered_pairs_hold_members_and_told_pairs(spark, tmp_path):
    from eventloom.catalog import QUERIES

    rows = [(i, f"https://a.b.example.com/{url}", "<title>Senate votes on the budget</title>") for i, url in ((0, "x"), (30, "x"), (45, "x"), (60, "y"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["fuzzy_event_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r.id1, r.id2) for r in got) == [(0, 30), (0, 45), (0, 60), (30, 45), (30, 60), (45, 60)]


def test_matched_characters_are_those_of_the_library():
    draw = random.Random(5)
    for letters in ("ab c", "aé𝄞\0 xyz", "".join(map(chr, range(0x4E00, 0x4E00 + 4000)))):
        text = lambda: "".join(draw.choices(letters, k=draw.choice([0, 1, 5, 40, 63, 64, 210])))
        left = [text() for _ in range(200)]
        right = [text() if draw.random() < 0.5 else x[: draw.randrange(50)] + "q" + x[-9:] for x in left]
        want = [sum(m.size for m in SequenceMatcher(None, x, y).get_matching_blocks()) for x, y in zip(left, right)]
        assert fuzzy.matched(left, right).tolist() == want
        for need in (0.5, 0.8):  # what is passed over has too few
            found = {(i, j) for i, places in fuzzy.alike(right, left, lambda some, at: need) for j in places}
            reach = {i for i, (x, y, n) in enumerate(zip(left, right, want)) if x and y and 2 * n >= need * (len(x) + len(y))}
            assert all((i, i) in found for i in reach) and len(found) < 0.7 * 200 * 200
