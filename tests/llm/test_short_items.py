"""Benchmark items of a few words are found inside longer documents."""

from eventloom.llm import decontaminate


def test_short_items(spark):
    five = "one two three four five".split()
    docs = [(i, " ".join(["before", *five[:i], "other", *five[i + 1 :], "after"])) for i in range(5)]
    docs += [(10, "a long text with red in it"), (11, "some blue sky here today"), (12, "x green old hill y z"), (13, "green hill old and more words")]
    items = [("five", " ".join(five)), ("one", "red"), ("two", "blue sky"), ("three", "green old hill")]
    got = decontaminate.overlaps(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    ).collect()
    want = [(i, "five", 0.8) for i in range(5)] + [(10, "one", 1.0), (11, "two", 1.0), (12, "three", 1.0)]
    assert sorted(map(tuple, got)) == sorted(want)
