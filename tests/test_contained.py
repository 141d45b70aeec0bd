"""What the substring join carries."""

from eventloom.operators.matching import contained_pairs

NEEDLES = ["User 1", "User 12", "é", "zz top", "view", "", "User 1"]
HAYS = ["User 12 view", "User 3 view", "an é", "ZZ top", "", "zz to", "viewview"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_substrings_that_begin_as_needles_are_joined(spark):
    needles = spark.createDataFrame([(i % 2, x) for i, x in enumerate(NEEDLES * 2)], "d int, needle string")
    hays = spark.createDataFrame([(d, x) for d in (0, 1, 2) for x in HAYS], "d int, hay string")
    found = contained_pairs(needles, hays, ["d"], "needle", "hay")
    want = {(d, n, h) for d in (0, 1) for n in NEEDLES if n for h in HAYS if n in h}
    got = [tuple(r) for r in found.select("d", "needle", "hay").collect()]
    assert set(got) == want and len(got) == len(want)
    assert "_begins" in plan(found)
