"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

``fingerprints`` gives each document its 64-bit SimHash; ``linked`` finds all fingerprints that
differ in ``ERRORS`` bits at most; ``near_duplicates`` names components; ``deduplicate`` keeps one
document of each.

How the trie is spread over tasks. Two fingerprints with at most two differing bits agree on at
least one of three 21-bit chunks. So each distinct fingerprint enters three tries, in each with
another chunk rotated to the top, and a trie's traversal never leaves a node at depth 21: the
sub-tries below depth 21 are independent and are what the shuffle deals out. Below them node pairs
descend together, bit by bit, and are pruned when their differing bits exceed the budget.

Scale: exact copies are one fingerprint before any comparison, so a group of copies costs nothing.
Each distinct fingerprint is shuffled three times. A sub-trie with more than ``BLOCK`` fingerprints
(near copies crowd there) is cut into blocks of about that size and each pair of blocks is a task of
its own, so no task holds an unbounded group. A task returns a spanning forest of its links, not
the links: at most one row per fingerprint and task. Components run over written tables.

Defined results: a null or empty text has fingerprint zero and is linked like any other. Repeated
rows and repeated or null ids are rows like others (a null id is never the smallest; a component of
null ids alone has a null component). An empty table gives an empty result. Other columns of the
input are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from eventloom.llm.common import components, free, table, union_roots
from eventloom.session import cut

# Fixed values of the fingerprint.
SEED = 42
SHINGLE = 3
BITS = 64
ERRORS = 2

CHUNK = BITS // (ERRORS + 1)  # bits that a trie's top chunk agrees on
BLOCK = 8_192  # fingerprints of a sub-trie that one task compares with one another
HELD = 100_000  # fingerprints of whole sub-tries that a task traverses together
SHINGLES_AT_ONCE = 1 << 16


def simhash(text: str | None) -> int:
    """Unsigned SimHash of one text; memory is bounded by the words, not by the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case, ASCII white space
    if not words:
        return 0
    total = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, total, SHINGLES_AT_ONCE):
        hashes = np.array(
            [
                xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED)
                for i in range(at, min(total, at + SHINGLES_AT_ONCE))
            ],
            ">u8",
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


@pandas_udf(LongType())
def _simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([simhash(t) for t in batch], np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> Column:
    """Fingerprint of ``docs[text]`` as a signed bigint with the same bits."""
    return _simhash(docs[text])


def hexed(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def trie_pairs(group: np.ndarray, prints: np.ndarray, depth: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints of one group that differ in at most ``errors`` bits.

    ``prints`` (uint64) is sorted within each group, and a group's fingerprints agree above
    ``depth``: a trie node is a range of the array. All node pairs descend a level at a time.
    """
    n = len(prints)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], n] if n else starts
    many = ends - starts > 1
    a_lo, a_hi = starts[many], ends[many]
    b_lo, b_hi, spent = a_lo, a_hi, np.zeros(len(a_lo), np.int64)
    found_a, found_b = [], []
    while len(a_lo):
        single = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        i, j = a_lo[single], b_lo[single]
        close = (np.bitwise_count(prints[i] ^ prints[j]) <= errors) & (i != j)
        found_a.append(i[close])
        found_b.append(j[close])
        a_lo, a_hi, b_lo, b_hi, spent = (x[~single] for x in (a_lo, a_hi, b_lo, b_hi, spent))
        if depth == BITS or not len(a_lo):
            break
        ones = np.r_[0, np.cumsum((prints >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)]
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        own = a_lo == b_lo  # a node with itself: its two children meet once
        parts = [
            (a_lo, a_mid, b_lo, b_mid, spent, spent >= 0),
            (a_mid, a_hi, b_mid, b_hi, spent, spent >= 0),
            (a_lo, a_mid, b_mid, b_hi, spent + 1, spent < errors),
            (a_mid, a_hi, b_lo, b_mid, spent + 1, (spent < errors) & ~own),
        ]
        kept = [
            [x[ok] for x in part]
            for *part, allowed in parts
            for ok in [allowed & (part[1] > part[0]) & (part[3] > part[2])]
        ]
        a_lo, a_hi, b_lo, b_hi, spent = (np.concatenate(x) for x in zip(*kept))
        alone = (a_lo == b_lo) & (a_hi - a_lo == 1)
        a_lo, a_hi, b_lo, b_hi, spent = (x[~alone] for x in (a_lo, a_hi, b_lo, b_hi, spent))
        depth += 1
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (sub, i, j, turned) -> spanning forests of the links in each group."""

    def forest(held: pd.DataFrame) -> pd.DataFrame:
        group = held.groupby(["sub", "i", "j"], sort=False).ngroup().to_numpy()
        turned = held["turned"].to_numpy().astype(np.uint64)
        order = np.lexsort((turned, group))
        a, b = trie_pairs(group[order], turned[order], CHUNK, ERRORS)
        label = union_roots(len(order), a, b)
        tied = np.flatnonzero(label != np.arange(len(order)))
        prints = held["print"].to_numpy()[order]
        return pd.DataFrame({"a": prints[tied], "b": prints[label[tied]]})

    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        size += len(batch)
        if size < HELD:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = rows.iloc[-1]
        open_ = ((rows["sub"] == last["sub"]) & (rows["i"] == last["i"]) & (rows["j"] == last["j"])).to_numpy()
        if not open_.all():
            yield forest(rows[~open_].reset_index(drop=True))
            rows = rows[open_].reset_index(drop=True)
        held, size = [rows], len(rows)
    if held:
        yield forest(pd.concat(held, ignore_index=True))


def linked(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints connected by ``ERRORS`` differing bits.

    ``prints`` has one bigint column ``print`` with distinct values.
    """
    turns = [F.struct(F.lit(c).cast("long").alias("trie"), _rotated(F.col("print"), c * CHUNK).alias("turned")) for c in range(ERRORS + 1)]
    tries = prints.select("print", F.explode(F.array(*turns)).alias("t")).select(
        "print",
        "t.turned",
        F.shiftleft("t.trie", CHUNK).bitwiseOR(F.shiftrightunsigned("t.turned", BITS - CHUNK)).alias("sub"),
    )
    crowded = tries.groupBy("sub").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("turned"), blocks).cast("int")
    dealt = (
        tries.join(crowded, "sub")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("print", "turned", "sub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    return (
        dealt.repartition("sub", "i", "j")
        .sortWithinPartitions("sub", "i", "j")
        .mapInPandas(_forests, "a long, b long")
    )


def _rotated(c: Column, by: int) -> Column:
    return F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, BITS - by)) if by else c


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id (smallest doc_id linked)."""
    rows = cut(docs.select(docs[doc_id].alias("doc_id"), fingerprints(docs, text).alias("print")))
    return _with_component(rows).select("doc_id", hexed(F.col("print")).alias("fingerprint"), "component_id")


def _with_component(rows: DataFrame) -> DataFrame:
    """``rows`` (with doc_id and print), their component's root and its smallest doc_id."""
    firsts = rows.groupBy("print").agg(F.min("doc_id").alias("first"))
    roots = cut(components(linked(firsts.select("print"))))
    placed = cut(
        firsts.join(roots, firsts["print"] == roots["node"], "left")
        .select("print", "first", F.coalesce("root", "print").alias("root"))
    )
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    names = placed.join(named, "root").select(F.col("print").alias("p"), "root", "component_id")
    return rows.join(names, rows["print"] == names["p"]).drop("p")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that represent their component: that of the smallest doc_id.

    Of equal ids in one component the row whose text has the smallest hash stays, of wholly equal
    rows one. A component without ids keeps the row whose text has the smallest hash.
    """
    mark = free(docs, "text_hash")
    hashed = F.sha2(F.coalesce(docs[text], F.lit("")).cast("binary"), 256)
    rows = cut(
        docs.select(docs[doc_id].alias("doc_id"), fingerprints(docs, text).alias("print"), hashed.alias("hash"))
    )
    kept = _with_component(rows).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("kept")
    )
    kept = cut(
        kept.select("kept.doc_id", "kept.hash")
        .join(rows.groupBy(F.col("doc_id").alias("d"), F.col("hash").alias("h")).agg(F.count("*").alias("n")),
              F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")))
        .select("doc_id", "hash", (F.col("n") > 1).alias("repeated"))
    )
    marked = docs.withColumn(mark, hashed)
    same = lambda k: marked[doc_id].eqNullSafe(k["doc_id"]) & (marked[mark] == k["hash"])
    single, repeated = kept.filter("not repeated"), kept.filter("repeated")
    once = marked.join(single, same(single), "left_semi")
    if not repeated.isEmpty():  # else the texts need not be read and shuffled a second time
        once = once.union(marked.join(repeated, same(repeated), "left_semi").dropDuplicates([doc_id, mark]))
    return once.drop(mark)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
