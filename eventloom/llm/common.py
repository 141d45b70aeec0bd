"""Helpers shared by the operators: label folds, free column names, word memo, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import cut

WORDS_AT_ONCE = 1_000_000  # characters of text whose words are held as Python objects at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text (fold 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def free(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name in taken:
        name += "_"
    return name


def slices(texts: Iterable[str | None], most: int = WORDS_AT_ONCE) -> Iterator[list[str]]:
    """Consecutive texts (null as empty) in lists of about ``most`` characters; no text is split."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


class Memo(dict):
    """word -> row of ``values``; unknown words are scored together by ``score``.

    Python workers see each frequent word many times, so per-word work is done once per worker.
    The memo starts afresh when it holds ``most`` words: memory is bounded, results are the same.
    """

    def __init__(self, score: Callable[[list[str]], np.ndarray], most: int = 400_000):
        super().__init__()
        self.score, self.most, self.new, self.values = score, most, [], None

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        """One row of ``values`` for each word."""
        if len(self) > self.most:
            self.clear()
            self.values = None
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            scored, self.new = self.score(self.new), []
            self.values = scored if self.values is None else np.concatenate([self.values, scored])
        return self.values[at]


_HELD: dict = {}


def in_worker(key, build: Callable):
    """What a worker process keeps between tasks under ``key``; it keeps one such thing at a time, so
    stages that follow one another in the same workers do not add up their memory."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def starts_of(counts: list[int]) -> np.ndarray:
    """0 and the running totals: where each text's words begin in the joined list."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` (rows) between consecutive starts; 0 where there are none."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def union_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of 0..n-1 by the links (a, b): labels sink along links and
    along themselves until nothing changes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b) of bigints: (node, root), root the smallest node reachable.

    Every node with a link appears once. Alternating large-star and small-star steps (Kiveris et
    al., 2014): a step joins links with the smallest neighbour of their ends and keeps at most as
    many links as before. Minima combine before the shuffle, the join on a hub is one that the
    adaptive planner splits, and each round is a written table, so a lost executor costs one round
    at most. Ends when a round changes nothing, whatever the number of rounds. Null ends are no links.
    """
    edges = cut(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        # every larger neighbour of a node is tied to the node's smallest neighbour
        large = edges.join(low, edges["v"] == low["k"]).select("u", F.col("m").alias("v"))
        large = cut(large.filter("u <> v").distinct())
        # every smaller neighbour of a node, and the node, are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, large["u"] == low["k"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(low.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
    tied = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return tied.union(edges.select(F.col("v"), F.col("v")).distinct())


def sample(rows: DataFrame, key: str, about: int) -> DataFrame:
    """All rows, or the share of them that gives about ``about`` rows: those whose key hashes low.

    Chosen row by row after one count, so nothing is sorted or brought together; the same rows in
    every run.
    """
    share = about / max(rows.count(), 1)
    return rows if share >= 1 else rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))


LABELS_BROADCAST = 2_000_000  # rows of 16 bytes: 32 MB


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold_: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """text, y (0 or 1), fold and id of the documents with a label; of several labels the largest.

    Labels are broadcast when their counted rows fit ``LABELS_BROADCAST``; beyond, Spark shuffles both.
    """
    y = labels.filter(labels[label].isin(0, 1)).groupBy(labels["doc_id"].alias("labelled_id")).agg(F.max(label).alias("y"))
    if labels.count() <= LABELS_BROADCAST:
        y = F.broadcast(y)
    narrow = docs.select(docs[doc_id].alias("id"), F.coalesce(docs[text], F.lit("")).alias("text"), fold_.alias("fold"))
    return narrow.join(y, narrow["id"] == y["labelled_id"]).select("id", "text", "fold", F.col("y").cast("int").alias("y"))
