"""A version is valid only if its whole chain is."""

from eventloom.operators import lineage as ln

DDL = "package string, version string, hash string, previous_version string, previous_hash string, genesis boolean"


def chain(package, count, broken=()):
    rows = [(package, "v001", "h1", None, None, True)]
    for n in range(2, count + 1):
        rows.append((package, f"v{n:03d}", f"h{n}", f"v{n - 1:03d}", "no" if n in broken else f"h{n - 1}", False))
    return rows


def valid(spark, rows):
    found = ln.valid_versions(spark.createDataFrame(rows, DDL)).collect()
    return {(r.package, int(r.version[1:])): r.valid for r in found}


def test_chains(spark):
    rows = chain("whole", 37) + chain("broken", 20, {7}) + [r for r in chain("gap", 6) if r[1] != "v003"]
    rows += chain("twice", 3) + chain("twice", 3)[1:2] + [("lone", "v004", "h", None, None, False)]
    got = valid(spark, rows)
    assert all(got["whole", n] for n in range(1, 38))
    assert [n for n in range(1, 21) if got["broken", n]] == [1, 2, 3, 4, 5, 6]
    assert {n: got["gap", n] for n in (1, 2, 4, 5, 6)} == {1: True, 2: True, 4: False, 5: False, 6: False}
    assert got["twice", 3] and not got["lone", 4] and len(got) == 37 + 20 + 5 + 3 + 1


def test_rings_and_nothing(spark):
    ring = [("r", "v001", "a", "v002", "b", False), ("r", "v002", "b", "v001", "a", False)]
    assert valid(spark, ring) == {("r", 1): False, ("r", 2): False}
    assert valid(spark, []) == {}
