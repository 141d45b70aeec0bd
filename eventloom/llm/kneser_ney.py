"""Class-conditional, interpolated Kneser-Ney models of character n-grams within words.

A word is read as ``<word>`` with marks at both ends. For each class and order, an n-gram's
probability is its discounted count plus the share of the discount times the probability of the
n-gram without its first character; counts below the highest order are numbers of distinct left
neighbours (Kneser and Ney, 1995), grams at a word's start count once. With ``shared``, orders up to
it pool all classes, so that rare expressions fall back on the same counts in every class. Characters
that no class has seen have a quarter of the lowest probability of the first order's smoothing.

Training is Spark's work throughout. One pass over all texts of all classes: a task counts the distinct
words it holds, adds up n-grams by their hash of ``bits`` bits (64: the full hash, so different grams
are not merged) and sends them when it holds ``HELD`` or ends; grams are summed by key after a map-side
combine. Left neighbours, sums by context and back-off weights are aggregates, probabilities are joins
of one order with the next lower one. A context or a suffix joins as many rows as there are characters.
The model has one row for each distinct gram: it grows with the corpus as its grams do.

The finished model is sorted by order and hash, dealt by range, and written as array files (hashes, then
log-probabilities and log back-off weights of each class) of at most ``FILE_ROWS`` grams to the shared
folder. The driver gets one small row for each file and never a gram. Workers map the files into memory
where the folder is one of the machine, else they read whole files and keep ``FILES_HELD`` of them.
A task that is run again writes files of new names, and only those of finished tasks are listed.

Scoring looks up all n-grams of many words together by binary search.
"""

from __future__ import annotations

import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import slices
from eventloom.session import cut, fresh_dir

MIX = np.uint64(0x9E3779B97F4A7C15)
DISCOUNT = 0.75
FLUSH = 200_000  # distinct words that a task counts before it adds them up
HELD = 1_000_000  # grams that a task adds up before it sends them
FILE_ROWS = 500_000
FILES_HELD = 8  # files that a worker holds where it cannot map them
VALUES = 200_000  # words scored at once, times classes


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _hash(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Keys of the ``order``-grams that end at each character; meaningless where a word is shorter."""
    h = np.zeros(len(codes), np.uint64)
    for back in range(order):
        h[back:] = (h[back:] ^ codes[: len(codes) - back].astype(np.uint64) + np.uint64(back + 1)) * MIX
        h ^= h >> np.uint64(29)
    return (h * MIX >> np.uint64(64 - bits)).astype(np.int64)


def _laid_out(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all marked words in a row, each one's position in its word and its word."""
    marked = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return codes, np.arange(len(codes)) - first, word


def count_grams(texts: DataFrame, classes: int, order: int, bits: int) -> DataFrame:
    """``texts`` (text, cls): partial rows n, slot, cls, count, suffix, context, to be summed.

    ``suffix`` is the slot of the gram without its first character, ``context`` without its last.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = [Counter() for _ in range(classes)]
        held: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}  # (n, class): slots, counts, suffixes, contexts

        def add() -> None:
            for c, counter in enumerate(counts):
                words = list(counter)
                for at in range(0, len(words), 100_000):
                    some = words[at : at + 100_000]
                    codes, place, word = _laid_out(some)
                    times = np.fromiter((counter[w] for w in some), np.int64, len(some))[word]
                    slots = [_hash(codes, n, bits) for n in range(1, order + 1)]
                    for n in range(1, order + 1):
                        here = np.flatnonzero(place >= max(n - 1, 1))
                        up, back = (slots[n - 2][here], slots[n - 2][here - 1]) if n > 1 else (np.full(len(here), -1),) * 2
                        new = (slots[n - 1][here], times[here], up, back)
                        both = [np.concatenate(x) for x in zip(held[n, c], new)] if (n, c) in held else new
                        slot, first, of = np.unique(both[0], return_index=True, return_inverse=True)
                        total = np.zeros(len(slot), np.int64)
                        np.add.at(total, of, both[1])
                        held[n, c] = (slot, total, both[2][first], both[3][first])
                counter.clear()

        def send() -> Iterator[pd.DataFrame]:
            for (n, c), arrays in held.items():
                for at in range(0, len(arrays[0]), 100_000):
                    slot, count, up, back = (x[at : at + 100_000] for x in arrays)
                    yield pd.DataFrame({"n": n, "slot": slot, "cls": c, "count": count, "suffix": up, "context": back})
            held.clear()

        for batch in batches:
            for c, texts_of in batch.groupby("cls")["text"]:
                for some in slices(texts_of):
                    for text in some:
                        counts[int(c)].update(words_of(text))
                    if sum(map(len, counts)) > FLUSH:
                        add()
                        if sum(len(x[0]) for x in held.values()) > HELD:
                            yield from send()
        add()
        yield from send()

    return texts.select("text", "cls").mapInPandas(task, "n int, slot long, cls int, count long, suffix long, context long")


def _each(stem: str, classes: int) -> list[str]:
    return [f"{stem}{c}" for c in range(classes)]


def used_counts(texts: DataFrame, classes: int, order: int, bits: int, shared: int) -> DataFrame:
    """n, slot, suffix, context and u0, u1, ...: the counts that the model of each class uses."""
    u, k = _each("u", classes), _each("k", classes)
    of = lambda c: F.sum(F.when(F.col("cls") == c, F.col("count")).otherwise(0))
    counts = cut(
        count_grams(texts, classes, order, bits)
        .groupBy("n", "slot")
        .agg(F.max("suffix").alias("suffix"), F.max("context").alias("context"), *[of(c).alias(u[c]) for c in range(classes)])
    )
    left = (
        counts.filter("n > 1")
        .groupBy((F.col("n") - 1).alias("left_n"), F.col("suffix").alias("left_slot"))
        .agg(*[F.sum((F.col(a) > 0).cast("long")).alias(b) for a, b in zip(u, k)])
    )

    def use(c: int) -> Column:
        # grams at a word's start have no left neighbour
        lower = F.when(F.col(k[c]) > 0, F.col(k[c])).otherwise(F.least(F.col(u[c]), F.lit(1)))
        return F.when(F.col("n") == order, F.col(u[c])).otherwise(lower).cast("double").alias(u[c])

    joined = counts.join(left, (counts["n"] == left["left_n"]) & (counts["slot"] == left["left_slot"]), "left")
    each = joined.select("n", "slot", "suffix", "context", *[use(c) for c in range(classes)])
    pooled = sum((F.col(c) for c in u[1:]), F.col(u[0]))
    return cut(each.select("n", "slot", "suffix", "context", *[F.when(F.col("n") <= shared, pooled).otherwise(F.col(c)).alias(c) for c in u]))


def fit(texts: DataFrame, classes: int, order: int, bits: int, shared: int = 0) -> Model:
    """Model of ``texts`` (text, cls from 0), written to the shared folder."""
    u, s, b, p, low = (_each(stem, classes) for stem in ("u", "s", "b", "p", "low"))
    used = used_counts(texts, classes, order, bits, shared)
    first = used.filter("n = 1").agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0.0)) for c in u]).first()
    size = max(first[0], 1) + 1
    sums = (
        used.filter("n > 1")
        .groupBy((F.col("n") - 1).alias("of_n"), F.col("context").alias("of"))
        .agg(*[F.sum(c).alias(d) for c, d in zip(u, s)], *[F.sum((F.col(c) > 0).cast("long")).alias(d) for c, d in zip(u, b)])
    )
    weight = [F.when(F.col(c) > 0, DISCOUNT * F.col(d) / F.col(c)).otherwise(1.0).alias(d) for c, d in zip(s, b)]
    contexts = cut(sums.select("of_n", "of", *s, *weight))
    one = [((F.col(c) + 1) / F.lit(float(first[1 + i] + size))).alias(p[i]) for i, c in enumerate(u)]
    orders = [cut(used.filter("n = 1").select("slot", *one))]
    for n in range(2, order + 1):
        lower = orders[-1].select(F.col("slot").alias("low_slot"), *[F.col(c).alias(d) for c, d in zip(p, low)])
        grams = used.filter(F.col("n") == n).join(contexts.filter(F.col("of_n") == n - 1), F.col("context") == F.col("of"))
        grams = grams.join(lower, F.col("suffix") == F.col("low_slot"), "left")
        share = [
            F.when(
                F.col(u[c]) > 0,
                F.greatest(F.col(u[c]) - DISCOUNT, F.lit(0.0)) / F.col(s[c]) + F.col(b[c]) * F.coalesce(F.col(low[c]), F.lit(1 / size)),
            ).alias(p[c])
            for c in range(classes)
        ]
        orders.append(cut(grams.select("slot", *share)))
    gone = F.lit(float("-inf"))
    logs = [F.coalesce(F.log(c), gone).alias(c) for c in p] + [F.coalesce(F.log(c), F.lit(0.0)).alias(c) for c in b]
    probable = None
    for n, of_order in enumerate(orders, 1):
        some = of_order.select(F.lit(n).alias("n"), "slot", *p)
        probable = some if probable is None else probable.union(some)
    both = probable.join(contexts, (F.col("n") == F.col("of_n")) & (F.col("slot") == F.col("of")), "full")
    rows = cut(both.select(F.coalesce("n", "of_n").alias("n"), F.coalesce("slot", "of").alias("slot"), *logs))
    return Model(order, bits, classes, float(-np.log(size * 4)), _write(rows, p + b))


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as Spark itself would complete it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


def _write(rows: DataFrame, values: list[str]) -> dict[int, list[tuple[int, int, str]]]:
    """Files of each order, by their lowest hash: (that hash, number of grams, path)."""
    folder = _qualified(rows.sparkSession, fresh_dir(rows.sparkSession, "grams"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)

        def put(n: int, held: list[pd.DataFrame]) -> pd.DataFrame:
            slots = np.concatenate([x["slot"].to_numpy(np.int64) for x in held])
            name = f"{uuid.uuid4().hex}.grams"
            with files.open_output_stream(f"{base}/{name}") as out:
                out.write(slots.astype("<i8").tobytes())
                for x in held:
                    out.write(np.ascontiguousarray(x[values].to_numpy("<f8")).tobytes())
            return pd.DataFrame({"n": [n], "first": slots[:1], "grams": [len(slots)], "name": [name]})

        held: list[pd.DataFrame] = []
        now, size = 0, 0
        for batch in batches:
            for n, part in batch.groupby("n", sort=True):
                if held and (n != now or size + len(part) > FILE_ROWS):
                    yield put(now, held)
                    held, size = [], 0
                held.append(part)
                now, size = int(n), size + len(part)
        if held:
            yield put(now, held)

    ordered = rows.repartitionByRange("n", "slot").sortWithinPartitions("n", "slot")
    listed: dict[int, list[tuple[int, int, str]]] = {}
    for r in ordered.mapInPandas(task, "n int, first long, grams long, name string").collect():
        listed.setdefault(r.n, []).append((r.first, r.grams, f"{folder}/{r.name}"))
    return {n: sorted(x) for n, x in listed.items()}


@dataclass
class Model:
    order: int
    bits: int
    classes: int
    floor: float  # log-probability of a character that no class has seen
    files: dict[int, list[tuple[int, int, str]]]
    mapped: bool = True
    _open: OrderedDict = field(default_factory=OrderedDict, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_open": OrderedDict()}

    def _arrays(self, path: str, grams: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of a file, and its log-probabilities and log back-off weights."""
        if path in self._open:
            self._open.move_to_end(path)
            return self._open[path]
        files, at = pafs.FileSystem.from_uri(path)
        if self.mapped and isinstance(files, pafs.LocalFileSystem):
            raw = np.memmap(at, np.uint8, "r")
        else:
            with files.open_input_file(at) as file:
                raw = np.frombuffer(file.read(), np.uint8)
            while len(self._open) >= FILES_HELD:
                self._open.popitem(last=False)
        found = raw[: 8 * grams].view("<i8"), raw[8 * grams :].view("<f8").reshape(grams, 2 * self.classes)
        self._open[path] = found
        return found

    def _find(self, n: int, slots: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of each gram, and whether the model has it."""
        values, known = np.zeros((len(slots), 2 * self.classes)), np.zeros(len(slots), bool)
        some = np.flatnonzero(wanted)
        files = self.files.get(n, [])
        if not len(some) or not files:
            return values, known
        keys, place = np.unique(slots[some], return_inverse=True)
        found, ok = np.zeros((len(keys), 2 * self.classes)), np.zeros(len(keys), bool)
        borders = np.searchsorted(keys, np.array([first for first, _, _ in files], np.int64))
        for (_, grams, path), low, high in zip(files, borders, [*borders[1:], len(keys)]):
            if low == high:
                continue
            have, rows = self._arrays(path, grams)
            at = np.minimum(np.searchsorted(have, keys[low:high]), grams - 1)
            hit = np.flatnonzero(have[at] == keys[low:high])
            found[low + hit], ok[low + hit] = rows[at[hit]], True
        values[some], known[some] = found[place], ok[place]
        return values, known

    def score(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word under each class and, last, its number of predicted characters."""
        out, step = np.zeros((len(words), self.classes + 1)), max(1, VALUES // self.classes // 2)
        for at in range(0, len(words), step):
            out[at : at + step] = self._score(words[at : at + step])
        return out

    def _score(self, words: list[str]) -> np.ndarray:
        codes, place, word = _laid_out(words)
        total = np.full((len(codes), self.classes), self.floor)
        before, before_ok = None, None
        for n in range(1, self.order + 1):
            far = place >= n - 1
            values, ok = self._find(n, _hash(codes, n, self.bits), far)
            if n > 1:
                # a class that has not seen the gram backs off by the weight of its context
                seen = np.flatnonzero(before_ok[:-1] & far[1:])
                total[seen + 1] += before[seen, self.classes :]
            higher = ok[:, None] & np.isfinite(values[:, : self.classes])
            total = np.where(higher, values[:, : self.classes], total)
            before, before_ok = values, ok
        scored = np.flatnonzero(place >= 1)
        out = np.zeros((len(words), self.classes + 1))
        for c in range(self.classes):
            out[:, c] = np.bincount(word[scored], total[scored, c], len(words))
        out[:, -1] = np.bincount(word[scored], minlength=len(words))
        return out
