"""Target-distribution importance resampling over hashed word windows.

A text's features are its words and pairs of consecutive words. The tokenizers library's Regex Split
(a pre-tokenizer; nothing is trained) over the text with A-Z lowered returns the words with their
offsets, and each window of one or two neighbouring offsets is a feature, hashed by CRC-32 into
``BUCKETS`` buckets. Histograms of the documents and of a target give each bucket's gain: the floored
thousandfold log ratio of its smoothed shares. A document's weight is the floored mean gain of its
features. Adding Gumbel noise from a hash of the id and taking the highest scores draws documents
without replacement in proportion to exp(weight / 1000) (Xie et al., 2023).

Words never hold ASCII white space, so the Split runs once over each distinct stretch between white
space, many of them joined by line feeds; a worker remembers stretches (bounded memo), and a text's
windows are those of its stretches' words in a row.

Scale: texts are read and split once; a written table keeps two bytes for each feature. Histograms are
added up inside tasks, then by Spark; the ``BUCKETS`` sums go to the driver and the gains back to the
tasks, whatever the input. Weights come from the written table. The drawn rows are ranked by range
blocks (``ranks``), so no task orders more than its block.

Defined results: null and empty texts and texts without words have no features and weight 0. Null ids
hash as the empty text and lose ties; rows that tie in score and id are ordered by their features'
number, wholly equal ones in any order. Repeated rows count as often as they stand there. Empty
documents give an empty result; an empty target gives all buckets the same share. Other columns are
not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, LongType, StructType

from eventloom.llm.common import in_worker, slices, starts_of, table
from eventloom.operators.ordered import ranks
from eventloom.session import cut

# Fixed values of the features, gains and draw.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SCALE = 1_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25

MEMO = 300_000  # stretches that a worker remembers


class Words:
    """Words of texts, as places in a store of their bytes and checksums."""

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.word: list[bytes] = []
        self.before: list[int] = []  # checksum of the word and a space
        self.alone = np.zeros(0, np.uint32)

    def learn(self, new: list[bytes]) -> None:
        """Split stretches that are not known yet."""
        from tokenizers import PreTokenizedString

        joined = b"\n".join(new)
        split = PreTokenizedString(joined.decode())
        self.split.pre_tokenize(split)
        spans = [span for _, span, _ in split.get_splits(offset_referential="original", offset_type="byte")]
        words = [joined[a:b] for a, b in spans]
        starts = np.cumsum([0, *(len(s) + 1 for s in new)])
        owner = np.searchsorted(starts, np.array([a for a, _ in spans], np.int64), "right") - 1
        count = np.bincount(owner, minlength=len(new)).astype(np.int64)
        self.first = np.concatenate([self.first, len(self.word) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.word += words
        self.before += [zlib.crc32(w + b" ") for w in words]
        self.alone = np.concatenate([self.alone, np.fromiter(map(zlib.crc32, words), np.uint32, len(words))])

    def features(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Number of words, and buckets (words, then pairs) of each text."""
        if len(self.at) > MEMO:
            self.clear()
        lists = [t.encode("utf-8", "replace").lower().split() for t in texts]  # ASCII case, ASCII white space
        flat = [s for x in lists for s in x]
        new = [s for s in dict.fromkeys(flat) if s not in self.at]
        if new:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self.learn(new)
        at = np.fromiter(map(self.at.__getitem__, flat), np.int64, len(flat))
        count = self.count[at]
        ends = np.cumsum(count)
        places = np.repeat(self.first[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        starts = np.concatenate([[0], ends])[starts_of([len(x) for x in lists])]
        listed = places.tolist()
        left = map(self.before.__getitem__, listed[:-1])
        right = map(self.word.__getitem__, listed[1:])
        pairs = np.fromiter(map(zlib.crc32, right, left), np.uint32, max(len(listed) - 1, 0))
        one = (self.alone[places] % BUCKETS).astype("<u2")
        two = (pairs % BUCKETS).astype("<u2")
        spans = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
        return np.diff(starts), [np.concatenate([one[a:b], two[a : max(b - 1, a)]]) for a, b in spans]


@pandas_udf(StructType().add("n_words", LongType()).add("buckets", BinaryType()))
def _features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    words = in_worker("importance", Words)
    for batch in batches:
        counts, packed = [np.zeros(0, np.int64)], []
        for texts in slices(batch):
            n, buckets = words.features(texts)
            counts.append(n)
            packed += [b.tobytes() for b in buckets]
        yield pd.DataFrame({"n_words": np.concatenate(counts), "buckets": pd.Series(packed, dtype=object)})


def features(text: Column) -> Column:
    """Struct of ``n_words`` and ``buckets``: the bucket of each feature, as packed unsigned 16-bit integers."""
    return _features(text)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for packed in batch["buckets"]:
            total += np.bincount(np.frombuffer(packed, "<u2"), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": at, "n": total[at]})


def histogram(packed: DataFrame) -> np.ndarray:
    """Features of all rows (column ``buckets``) by bucket: at most ``BUCKETS`` rows reach the driver."""
    counts = packed.select("buckets").mapInPandas(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS, np.int64)
    for row in counts.collect():
        total[row.bucket] = row.n
    return total


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed shares of each bucket."""
    above = (target + 1.0) * (float(documents.sum()) + BUCKETS)
    below = (documents + 1.0) * (float(target.sum()) + BUCKETS)
    return np.floor(SCALE * np.log(above / below)).astype(np.int64)


def _weight(gain: np.ndarray) -> Callable[[Column], Column]:
    @pandas_udf(LongType())
    def weight(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = [np.frombuffer(packed, "<u2") for packed in batch]
            yield pd.Series([int(gain[b].sum()) // len(b) if len(b) else 0 for b in found], dtype=np.int64)

    return weight


def noise(doc_id: Column) -> Column:
    """Floored thousandfold Gumbel noise from a hash of the id."""
    hashed = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of ``docs``."""
    kept = docs.select(docs[doc_id].alias("doc_id"), features(docs[text]).alias("f"))
    kept = cut(kept.select("doc_id", "f.n_words", "f.buckets"))
    wanted = target.select(features(target[target_text]).alias("f")).select("f.buckets")
    weight = _weight(gains(histogram(kept), histogram(wanted)))
    weighed = kept.select(
        "doc_id", "n_words", (F.octet_length("buckets") / 2).cast("long").alias("n_features"), weight("buckets").alias("weight")
    )
    return weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id")))


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (as of ``scored``) and ``rank``: 1, 2, 3 ... in the order of the draw, null if not drawn."""
    rows = cut(rows)
    enough = F.col("n_words") >= least_words
    able = rows.filter(enough).withColumns({"_low": -F.col("score"), "_no_id": F.col("doc_id").isNull()})
    wanted = able.count() * percent // 100
    placed = ranks(able, [], ["_low", "_no_id", "doc_id", "n_features"]).drop("_low", "_no_id")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return placed.unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn rows of ``docs``, with all their columns; rows of one id are drawn with the best of them."""
    chosen = drawn(scored(docs, target, doc_id, text), percent).filter("rank is not null")
    chosen = chosen.select(F.col("doc_id").alias("_chosen")).distinct()
    return docs.join(chosen, docs[doc_id].eqNullSafe(chosen["_chosen"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; the target is the benchmark."""
    rows = drawn(scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
