"""Statistics of texts do not depend on how long the text is."""

import pytest

from eventloom.llm import quality


def test_statistics_count_over_the_whole_text():
    words = [f"w{i % 7}" if i % 3 else f"x{i % 500}" for i in range(150_001)]
    got = dict(zip(quality.STATISTICS, quality.statistics(" ".join(words))))
    n = len(words)
    assert got["distinct"] == pytest.approx(len(set(words)) / n)
    assert got["top_share"] == pytest.approx(max(words.count(w) for w in set(words)) / n)
    assert got["distinct_pairs"] == pytest.approx(len(set(zip(words, words[1:]))) / n)
    assert got["equal_neighbours"] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / n)
