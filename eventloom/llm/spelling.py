"""Spelling variants: words one edit apart, found in k-d trees over letter counts.

One inserted or deleted letter changes a word's letter counts by 1 in all (L1 distance), one replaced
letter by 2. So the words of each length stand in a k-d tree over their letter counts, and each word
is a range query against the trees of its own length (radius 2), the next shorter and the next longer
one (radius 1). Boxes farther away than the radius are pruned; what a leaf leaves within the radius is
verified letter by letter.

How the trees are spread over tasks. The upper part of each length's tree is fitted on the driver to a
sample of at most about ``SAMPLE`` words; its leaves are cells. A word is a point of the one cell that
it falls into and a query to every cell whose box is within the radius, so the sample decides how even
the cells are, never what is found. Each cell's own tree is built in the task that holds it.

``noisy_words`` counts the words of documents, ``near_pairs`` finds the pairs, ``variants`` names each
word's form and root.

Scale: word counts combine before the shuffle, so a word that makes up a third of a corpus costs one row
a task. A cell with more than ``CELL`` points (anagrams have equal counts, so no tree can part them)
is cut into blocks of points and slices of queries, each pair of which is a group of its own; groups are
dealt to tasks by hash. A word has at most 90 letters for each place to be near to, so near pairs
are linear in the words. Roots are found by pointer doubling over written tables: a form has at least
twice the count of its word, so paths are short and have no circles.

Defined results: null and empty texts have no words; a null doc_id counts as the empty text where
letters are dropped. Repeated rows and ids count as often as they stand there. Ties between near words
of equal count go to the smallest in code-point order. Empty tables give empty results. Very
long words are words like others. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StructType

from eventloom.llm.common import sample, table
from eventloom.session import cut

# Fixed values of the words.
RUN = "[a-zÀ-ÿ]+"  # after lower-casing A-Z
DROPS = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3

LETTERS = 26 + 64
SAMPLE = 100_000  # words that the upper trees are fitted to
CELL = 16_384  # points of a cell that one task holds at a time
LEAF = 12  # points of a leaf
PAIRS = 100_000  # pairs of a query and a point that are compared at a time
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(97, 123), *range(0xC0, 0x100)]] = np.arange(LETTERS)


def noisy_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n: the runs of letters, of which every 97th by hash lost a letter."""
    low = F.translate(docs[text], ascii_uppercase, ascii_lowercase)
    runs = docs.select(
        F.coalesce(docs[doc_id].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"({RUN})"), 1)).alias("run")
    )
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % DROPS == 0, shorter).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).filter(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= LEAST_COUNT)


def spelled(words: list[str]) -> np.ndarray:
    """Letters of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """How often each letter occurs, up to 127: counts that are cut off are never farther apart."""
    n, length = letters.shape
    total = np.zeros((n, LETTERS), np.int8)
    step = max(1, 2_000_000 // max(length, LETTERS))
    for a in range(0, n, step):
        part = _LETTER[letters[a : a + step]] + np.arange(len(letters[a : a + step]))[:, None] * LETTERS
        total[a : a + step] = np.minimum(np.bincount(part.ravel(), minlength=len(part) * LETTERS), 127).reshape(-1, LETTERS)
    return total


class Tree:
    """k-d tree. Node 0 is the root; ``low`` and ``high`` are boxes; a leaf holds ``order[first:last]``."""

    def __init__(self, points: np.ndarray, leaf: float, open_boxes: bool):
        """``open_boxes``: boxes are what splits leave of the whole space, not what the points take of it."""
        self.order = np.arange(len(points))
        self.dim, self.split, self.left, self.right, self.first, self.last, low, high = ([] for _ in range(8))
        whole = (np.zeros(points.shape[1], np.int8), np.full(points.shape[1], 127, np.int8))
        waiting = [(0, len(points), *whole, -1, False)]
        while waiting:
            first, last, lo, hi, parent, is_right = waiting.pop()
            node = len(self.dim)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            held = points[self.order[first:last]]
            if not open_boxes and last > first:
                lo, hi = held.min(axis=0), held.max(axis=0)
            dim, split = self._cut(held) if last - first > leaf else (-1, 0)
            for column, value in zip((self.dim, self.split, self.left, self.right, self.first, self.last, low, high), (dim, split, -1, -1, first, last, lo, hi)):
                column.append(value)
            if dim < 0:
                continue
            right = held[:, dim] >= split
            mine = self.order[first:last]
            self.order[first:last] = np.concatenate([mine[~right], mine[right]])
            middle = last - int(right.sum())
            up, down = hi.copy(), lo.copy()
            up[dim], down[dim] = split - 1, split
            waiting += [(middle, last, down, hi, node, True), (first, middle, lo, up, node, False)]
        for name in ("dim", "split", "left", "right", "first", "last"):
            setattr(self, name, np.array(getattr(self, name), np.int64))
        self.low, self.high = np.array(low, np.int8), np.array(high, np.int8)

    @staticmethod
    def _cut(held: np.ndarray) -> tuple[int, int]:
        """Letter and count that halve the points best; letter -1 if all points are equal."""
        dim = int(held.std(axis=0).argmax())
        values = held[:, dim]
        split = int(np.median(values)) + 1
        if split > values.max():
            split -= 1
        if split <= values.min():
            split = int(values.min()) + 1
        return (dim, split) if values.min() < values.max() else (-1, 0)

    def leaves(self, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Queries (rows of ``asked``) and leaves whose box is within the radius."""
        query, node = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        while len(query):
            near = np.concatenate([
                self._apart(asked[query[a : a + PAIRS]], node[a : a + PAIRS]) <= radius for a in range(0, len(query), PAIRS)
            ])
            query, node = query[near], node[near]
            leaf = self.dim[node] < 0
            if leaf.any():
                yield query[leaf], node[leaf]
            query, node = query[~leaf], node[~leaf]
            query, node = np.concatenate([query, query]), np.concatenate([self.left[node], self.right[node]])

    def _apart(self, asked: np.ndarray, node: np.ndarray) -> np.ndarray:
        inside = np.clip(asked, self.low[node], self.high[node])
        return np.abs(asked - inside).sum(axis=1, dtype=np.int32)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point falls into."""
        node = np.zeros(len(points), np.int64)
        while (inner := self.dim[node] >= 0).any():
            at = node[inner]
            right = points[inner, self.dim[at]] >= self.split[at]
            node[inner] = np.where(right, self.right[at], self.left[at])
        return node


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters ``a`` and ``b``, of lengths that differ by one at most, are one edit apart."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    short, long = (a, b) if a.shape[1] < b.shape[1] else (b, a)
    head = np.cumprod(short == long[:, :-1], axis=1, dtype=np.int8).sum(axis=1)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1)
    return head + tail >= short.shape[1]


def _radius(length: int, of: int) -> int:
    return 2 if length == of else 1


class Cells:
    """Upper trees by length. A cell is ``length << 32 | leaf``; a length without a tree is one cell."""

    def __init__(self, words: list[str], share: float):
        by_length: dict[int, list[str]] = {}
        for word in words:
            by_length.setdefault(len(word), []).append(word)
        self.trees = {
            n: Tree(letter_counts(spelled(held)), max(1.0, CELL * share), True)
            for n, held in by_length.items() if len(held) > CELL * share
        }

    def of(self, words: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """Own cell of each word, and the cells that it has to ask."""
        home, asks = np.zeros(len(words), np.int64), [[] for _ in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            counts = letter_counts(spelled([words[i] for i in at]))
            tree = self.trees.get(length)
            home[at] = (length << 32) + (0 if tree is None else tree.home(counts))
            for other in (length - 1, length, length + 1):
                tree = self.trees.get(other)
                found = [(np.arange(len(at)), np.zeros(len(at), np.int64))] if tree is None else tree.leaves(counts, _radius(length, other))
                for query, leaf in found:
                    for q, cell in zip(at[query].tolist(), ((other << 32) + leaf).tolist()):
                        asks[q].append(cell)
        return home, asks


class Block:
    """Points of one group and their tree, over the letters that they use."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.n = np.array(words, object), np.array(counts, np.int64)
        self.letters = spelled(words)
        self.length = self.letters.shape[1]
        vectors = letter_counts(self.letters)
        self.used = vectors.any(axis=0)
        self.vectors = vectors[:, self.used]
        self.tree = Tree(self.vectors, LEAF, False)

    def near(self, words: list[str]) -> Iterator[pd.DataFrame]:
        """Pairs of each word (all of one length) and a point one edit away."""
        letters = spelled(words)
        counts = letter_counts(letters)
        radius, asked = _radius(letters.shape[1], self.length), counts[:, self.used]
        spent = counts[:, ~self.used].sum(axis=1, dtype=np.int32)
        rows, step = np.flatnonzero(spent <= radius), 2_048
        tree, most = self.tree, max(1, min(PAIRS, 20_000_000 // self.length))
        for a in range(0, len(rows), step):
            part = rows[a : a + step]
            for query, leaf in tree.leaves(asked[part], radius):
                size = tree.last[leaf] - tree.first[leaf]
                ends = np.cumsum(size)
                for b, e in _runs(ends, most):
                    q, inside = np.repeat(part[query[b:e]], size[b:e]), size[b:e]
                    place = np.arange(len(q)) - np.repeat(np.cumsum(inside) - inside, inside)
                    p = tree.order[np.repeat(tree.first[leaf[b:e]], inside) + place]
                    apart = np.abs(asked[q] - self.vectors[p]).sum(axis=1, dtype=np.int32) + spent[q]
                    close = apart <= radius
                    q, p = q[close], p[close]
                    true = one_edit(letters[q], self.letters[p])
                    if true.any():
                        q, p = q[true], p[true]
                        yield pd.DataFrame({"word": [words[i] for i in q], "near": self.words[p], "near_n": self.n[p]})


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes (running totals ``ends``) sum to about ``most``."""
    at = 0
    while at < len(ends):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, stop
        at = stop


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (cell, block, slice, asks): a group's points, then its queries."""
    key, points, block = None, [], None
    for batch in batches:
        names = ["cell", "block", "slice", "asks"]
        runs = batch[names].ne(batch[names].shift()).any(axis=1).cumsum()
        for _, rows in batch.groupby(runs, sort=False):
            first = rows.iloc[0]
            now = (first["cell"], first["block"], first["slice"])
            if now != key:
                key, points, block = now, [], None
            if not first["asks"]:
                points.append(rows[["word", "n"]])
                continue
            if not points and block is None:
                continue
            if block is None:
                held = pd.concat(points)
                points, block = [], Block(held["word"].tolist(), held["n"].tolist())
            words = rows["word"].tolist()
            by_length: dict[int, list[str]] = {}
            for word in words:
                by_length.setdefault(len(word), []).append(word)
            for same in by_length.values():
                yield from block.near(same)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near and near_n of all words one edit apart, each pair in both directions.

    ``words`` has distinct ``word`` (letters of ``RUN``) and ``n``; it is read several times.
    """
    total = words.count()
    some = [r.word for r in sample(words.select("word"), "word", SAMPLE).collect()]
    sent = words.sparkSession.sparkContext.broadcast(Cells(some, len(some) / max(total, 1)))

    @pandas_udf(StructType().add("home", LongType()).add("asks", ArrayType(LongType())))
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            home, asks = sent.value.of(batch.tolist())
            yield pd.DataFrame({"home": home, "asks": asks})

    rows = cut(words.select("word", "n", placed("word").alias("p")))
    points = rows.select("word", "n", F.col("p.home").alias("cell"), F.lit(False).alias("asks"))
    queries = rows.select("word", "n", F.explode("p.asks").alias("cell"), F.lit(True).alias("asks"))
    weight = F.greatest(F.char_length("word"), F.lit(LETTERS)) / F.lit(LETTERS)  # long words count as several
    sizes = (
        points.union(queries).groupBy("cell")
        .agg(F.sum(F.when(~F.col("asks"), weight)).alias("points"), F.sum(F.when(F.col("asks"), weight)).alias("queries"))
        .filter("points is not null and queries is not null")
        .select(
            F.col("cell").alias("at"), (F.col("points") + F.col("queries")).alias("size"),
            F.ceil(F.col("points") / CELL).cast("int").alias("blocks"), F.ceil(F.col("queries") / (16 * CELL)).cast("int").alias("slices"),
        )
    )
    sizes = cut(sizes)
    tasks = max(1, int((sizes.agg(F.sum("size")).first()[0] or 0) // (6 * CELL)))
    hashed = F.xxhash64("word")
    each = lambda n: F.sequence(F.lit(0), n - 1)
    own = lambda n: F.array(F.pmod(hashed, n).cast("int"))
    dealt = (
        points.union(queries).join(sizes, F.col("cell") == F.col("at"))
        .withColumn("block", F.explode(F.when(F.col("asks"), each(F.col("blocks"))).otherwise(own(F.col("blocks")))))
        .withColumn("slice", F.explode(F.when(F.col("asks"), own(F.col("slices"))).otherwise(each(F.col("slices")))))
        .select("word", "n", "cell", "block", "slice", "asks", F.pmod(F.xxhash64("cell", "block", "slice"), F.lit(tasks)).alias("task"))
    )
    groups = dealt.repartition("task").sortWithinPartitions("cell", "block", "slice", "asks")
    return groups.mapInPandas(_search, "word string, near string, near_n long")


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of distinct words with their counts."""
    words = cut(words.select("word", "n"))
    best = near_pairs(words).groupBy(F.col("word").alias("w")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    enough = -F.col("best.less") >= 2 * F.col("n")
    found = cut(
        words.join(best, words["word"] == best["w"], "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(found.filter("form is not null").select("word", F.col("form").alias("up")))
    return found.join(roots.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("up", "word").alias("root")
    )


def _roots(links: DataFrame) -> DataFrame:
    """word and the last word that its links (word, up) lead to, path lengths doubling in each round."""
    links = cut(links)
    while True:
        on = links.select(F.col("word").alias("middle"), F.col("up").alias("farther"))
        joined = cut(links.join(on, links["up"] == on["middle"], "left").select(
            "word", F.coalesce("farther", "up").alias("up"), F.col("farther").isNotNull().alias("moved")
        ))
        links = joined.select("word", "up")
        if joined.filter("moved").isEmpty():
            return links


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(noisy_words(table(spark, sf_dir, "documents")))
