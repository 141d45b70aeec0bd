"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become words (lower case, split at everything that is neither letter nor digit). Each mask
of ``MASKS`` looks at some positions of a window and ignores the others; equal hashes of the looked-
at words join windows of benchmark items and of documents. A hit fixes an alignment of item and
document; the words of both are then compared position by position, and the pair counts if some
``WINDOW`` aligned words in a row (fewer where the item is shorter) agree in a share of ``SHARE`` or
more. Substituted words are thus tolerated both in the seed and in the check.

Scale: a document's words are hashed once; windows are exploded next to the array of word hashes
inside generated code and meet the benchmark in one hash join, so nothing but hits leaves the scan
stage when the benchmark's seeds are small. They are broadcast only when their counted rows fit
``BROADCAST_ROWS``; beyond, Spark shuffles both sides (splitting hot seeds). A hit carries only the
aligned slice of the document, as long as the item, never the document. Hits reduce to one row per
document and item before and after the shuffle.

Defined results: null or empty texts and items have no windows; an item with fewer words than the
widest mask is compared with the masks that fit, and one of 5 words with masks for each inner word; one
with fewer words than the narrowest mask is found whole anywhere in a document. Repeated items and repeated rows give equal findings; rows with the same
id (null included) are reported together with the best overlap. Empty tables give empty results.
Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import free, table
from eventloom.session import cut

MASKS = ("1111", "110011", "1010101", "11010001")  # 1: the word counts, 0: it is ignored
WINDOW = 13
SHARE = 0.8
BROADCAST_ROWS = 2_000_000  # seeds of 40 bytes: 80 MB

#: Only for items of so many words: one of 5 may differ anywhere in one word, shorter ones must agree whole.
MASKS_OF = {1: ("1",), 2: ("11",), 3: ("111",), 5: ("11011", "10111", "11101")}

NARROWEST = min(len(m) for m in MASKS)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seed(hashes: Column, at: Column, mask: str, salt: int) -> Column:
    """Hash of the words that ``mask`` looks at in the window starting at ``at`` (from 0)."""
    looked = [F.get(hashes, at + i) for i, bit in enumerate(mask) if bit == "1"]
    return F.xxhash64(F.lit(salt), *looked)


def seeds(frame: DataFrame, hashes: str, *kept: str, lengths: tuple[int, ...] = (), whole: bool = False) -> DataFrame:
    """One row for each mask and window: the kept columns, ``at`` and ``seed``.

    Texts shorter than the narrowest mask have one window, hashed whole. The masks of ``MASKS_OF`` for
    ``lengths`` are used too, with ``whole`` only on texts of just that length.
    """
    n = F.size(hashes)
    narrowest = min([NARROWEST, *lengths])
    windows = frame.select(
        hashes, *kept, F.explode(F.sequence(F.lit(0), F.greatest(n - narrowest, F.lit(0)))).alias("at")
    )
    h, at = F.col(hashes), F.col("at")
    short = F.when((n > 0) & (n < NARROWEST) & (at == 0), F.xxhash64(F.lit(-1), h))
    each = [
        F.when(at + len(m) <= n, seed(h, at, m, k)) if k else F.coalesce(short, F.when(at + len(m) <= n, seed(h, at, m, k)))
        for k, m in enumerate(MASKS)
    ]
    extra = [m for length in lengths for m in MASKS_OF[length]]
    for m in extra:
        fits = n == len(m) if whole else at + len(m) <= n
        each.append(F.when(fits & (at + len(m) <= n), seed(h, at, m, int("2" + m))))
    exploded = windows.select(hashes, *kept, "at", F.explode(F.array(*each)).alias("seed"))
    return exploded.filter("seed is not null")


def agreement(words: Column, other: Column) -> Column:
    """Largest share of equal positions in any ``WINDOW`` neighbouring positions of two aligned arrays."""
    same = F.zip_with(words, other, lambda x, y: F.when(x == y, 1).otherwise(0))
    width = F.least(F.size(words), F.lit(WINDOW))
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - width + 1),
        lambda start: F.aggregate(F.slice(same, start, width), F.lit(0), lambda a, b: a + b),
    )
    return F.array_max(windows) / width


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, overlap (``SHARE`` to 1): one row for each document and item that overlap."""
    wanted = cut(items.select(items[item_id].alias("item_id"), word_hashes(items[text]).alias("item_words")))
    lengths = wanted.select(F.size("item_words").alias("n")).filter(F.col("n").isin(*MASKS_OF)).distinct().collect()
    lengths = tuple(sorted(r.n for r in lengths))
    of_items = seeds(wanted, "item_words", "item_id", lengths=lengths, whole=True).select(
        "item_id", "item_words", F.col("at").alias("item_at"), F.col("seed").alias("item_seed")
    )
    of_items = cut(of_items)
    if of_items.count() <= BROADCAST_ROWS:
        of_items = F.broadcast(of_items)
    of_docs = seeds(docs.select(docs[doc_id].alias("doc_id"), word_hashes(docs[text]).alias("words")), "words", "doc_id", lengths=lengths)
    m, shift = F.size("item_words"), F.col("at") - F.col("item_at")
    nothing = lambda n: F.array_repeat(F.lit(None).cast("long"), F.greatest(n, F.lit(0)))
    # the document's words under the item, as many; positions outside the document agree with nothing
    under = F.slice(
        F.concat(nothing(-shift), F.slice("words", F.greatest(shift, F.lit(0)) + 1, m), nothing(m)), F.lit(1), m
    )
    # the slice is cut inside the join's generated code; the share is tested after the maximum, so
    # that neither the whole document nor the test becomes part of the join
    hits = of_docs.join(of_items, of_docs["seed"] == of_items["item_seed"]).select(
        "doc_id", "item_id", "item_words", under.alias("under")
    )
    shares = hits.select("doc_id", "item_id", agreement(F.col("under"), F.col("item_words")).alias("overlap"))
    best = shares.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"))
    return best.filter(F.col("overlap") >= SHARE)


def decontaminate(docs: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item. Decided by text, so ids may be null or repeated."""
    mark = free(docs, "text_hash")
    marked = docs.withColumn(mark, F.sha2(F.coalesce(docs[text], F.lit("")).cast("binary"), 256))
    found = cut(overlaps(marked, items, doc_id=mark, item_id=item_id, text=text).select("doc_id").distinct())
    return marked.join(found, marked[mark] == found["doc_id"], "left_anti").drop(mark)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
