"""Word-piece token counts by the linear longest-match automaton.

Greedy longest-match-first word pieces (a word starts with an initial piece and goes on with
continuing ones) are counted without building them: a trie of both kinds of pieces gets failure
links, and each link carries the number of pieces that are complete when it is taken (Song et al.,
2021). Matching reads each byte of a word once.

Pieces come from a byte-level vocabulary file whose path is a parameter: entries that start with the
mark of a space are initial pieces, all others continuing pieces. A word whose pieces do not reach
its end is one unknown token, as word-piece tokenizers count it. Words are runs of letters and
digits, and single other characters; white space is dropped.

Scale: one scan, no shuffle. The vocabulary is read on the driver and broadcast: its size is that of
the file. A worker counts each frequent word once (``Memo``, bounded); a long text is held as one
string, its words about ``WORDS_AT_ONCE`` characters of text at a time.

Defined results: null and empty texts have zero words and tokens; rows stay rows, whatever their ids;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from eventloom.llm.common import Memo, in_worker, slices, starts_of, sums, table

WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
TYPE = "n_words long, n_tokens long, n_unknown long"


def unbyte() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable bytes stand for themselves, the others
    for the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Initial and continuing pieces of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    of = unbyte()
    pieces = [bytes(of[c] for c in piece) for piece in vocabulary]
    return [p[1:] for p in pieces if p[:1] == b" " and len(p) > 1], [p for p in pieces if p[:1] != b" "]


class LongestMatch:
    """Trie of initial pieces (below node 0) and continuing pieces (below node 1) with failure links."""

    START, GO_ON, NONE = 0, 1, -1

    def __init__(self, initial: list[bytes], continuing: list[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((self.START, initial), (self.GO_ON, continuing)):
            for p in pieces:
                at = root
                for byte in p:
                    if byte not in self.next[at]:
                        self.next[at][byte] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    at = self.next[at][byte]
                piece[at] = True
        self.fail, self.popped = [self.NONE] * len(piece), [0] * len(piece)
        waiting = deque([self.START, self.GO_ON])
        while waiting:
            above = waiting.popleft()
            for byte, node in self.next[above].items():
                if piece[node]:
                    self.fail[node], self.popped[node] = self.GO_ON, 1
                else:
                    at, count = self.fail[above], self.popped[above]
                    while at != self.NONE and byte not in self.next[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at != self.NONE:
                        self.fail[node], self.popped[node] = self.next[at][byte], count
                waiting.append(node)

    def count(self, word: bytes) -> int:
        """Number of pieces of a word, 0 if it is unknown."""
        step, fail, popped = self.next, self.fail, self.popped
        at, count = self.START, 0
        for byte in word:
            while byte not in step[at]:
                count += popped[at]
                at = fail[at]
                if at == self.NONE:
                    return 0
            at = step[at][byte]
        while at != self.GO_ON:
            count += popped[at]
            at = fail[at]
            if at == self.NONE:
                return 0
        return count

    def rows(self, words: list[str]) -> np.ndarray:
        """Tokens and unknown tokens of each word."""
        counts = np.array([self.count(w.encode("utf-8", "surrogatepass")) for w in words], np.int64)
        return np.stack([np.maximum(counts, 1), counts == 0], axis=1).astype(np.int64)


def token_counts(spark: SparkSession, path: str, text: Column) -> Column:
    """Struct of n_words, n_tokens and n_unknown of a text column."""
    pieces = spark.sparkContext.broadcast(read_pieces(path))

    @pandas_udf(TYPE)
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = in_worker(("token counts", path), lambda: Memo(LongestMatch(*pieces.value).rows))
        for batch in batches:
            parts = [np.zeros((0, 3), np.int64)]
            for texts in slices(batch):
                lists = [WORD.findall(t) for t in texts]
                starts = starts_of([len(x) for x in lists])
                words = [w for x in lists for w in x]
                found = sums(memo.rows(words), starts) if words else np.zeros((len(texts), 2))
                parts.append(np.column_stack([np.diff(starts), found]).astype(np.int64))
            yield pd.DataFrame(np.concatenate(parts), columns=["n_words", "n_tokens", "n_unknown"])

    return counted(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every document."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counted = token_counts(spark, public_tokenizers.path("byte_bpe_50k.json"), F.col("text"))
    return docs.select("doc_id", counted.alias("c")).select("doc_id", "c.*")
