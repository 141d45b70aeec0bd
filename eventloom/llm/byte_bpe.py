"""Byte-level BPE encoding and decoding by longest matches and backtracking.

The ids are those that merging by rank gives, found without merging. A text is split by the
pattern; each match is encoded by itself. A match that is a token is that token. In any other, the
bytes stand as Latin-1 characters for an Aho-Corasick automaton over all tokens, one run of which
tells the longest token that starts at each byte. From the left, the longest token is taken; it
stays if its end is not known as a dead end and if it is compatible with the token before it, else
its longest proper prefix among the tokens is tried, and when none is left the token before it is
taken back and its end is a dead end. No byte is a token's end twice, so the work is linear in the
bytes. Two tokens are compatible if merging their bytes leaves exactly these two: their merges are
undone from the highest rank down, and no two parts that ever touch at the border may form a token of
a lower rank than what is undone. The answers are remembered per pair (van Antwerpen and
Neubeck, 2024).

The vocabulary is a file of base64 tokens and ranks; its path is a parameter. It must hold every
byte, and every longer token must be merged from two tokens of lower rank, which is checked while the
parts of each are looked for.

The pattern's letters, digits and spaces are those of the tiktoken library, whose Unicode tables may be
of another version than Python's. In texts with a character that Python's tables don't know, or one
beyond the basic plane, each such character is replaced by a plain one of the class that the
library's own splitting shows (asked once per character), and the borders found are used on the text.

Scale: one scan, no shuffle. The vocabulary is read and its parts are found on the driver, then
broadcast (50,256 tokens in the file used here). Frequent matches are encoded once per worker (bounded
memo); a worker holds one text and its ids at a time besides, and sends results back in small batches.

Defined results: null and empty texts have no ids and decode to the empty text. Decoding gives the
bytes of the text back. Unknown ids in ``decode`` have no bytes; bytes that are no UTF-8 read as
U+FFFD in ``decode``. Repeated rows, ties and repeated ids are rows like others; an empty table gives an
empty result; other columns stay as they are and are not looked at.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

from eventloom.llm.common import in_worker, table

MEMO = 250_000  # matches that a worker remembers
LONG = 64  # characters from which a match is not remembered
PAIRS = 1_000_000  # pairs whose compatibility a worker remembers
ROWS = 500  # rows of a batch on its way back
NONE = -1


class Vocabulary:
    """Tokens by rank, their ranks, and the two parts each is merged from (itself twice for a byte)."""

    def __init__(self, ranks: dict[bytes, int], parts: list[tuple[int, int]] | None = None):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * len(ranks)
        for token, rank in ranks.items():
            if not 0 <= rank < len(ranks):
                raise ValueError("ranks must be 0, 1, 2 ...")
            self.tokens[rank] = token
        self.known: dict[tuple[int, int], bool] = {}
        self.parts = parts or self._parts()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as file:
            entries = [line.split() for line in file if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in entries})

    def __reduce__(self):
        return Vocabulary, (self.ranks, self.parts)

    def _parts(self) -> list[tuple[int, int]]:
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} bytes")
        self.parts = [(i, i) for i in range(len(self.tokens))]
        for rank, token in enumerate(self.tokens):
            if len(token) == 1:
                continue
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut], rank), self.ranks.get(token[cut:], rank)
                if a < rank and b < rank and self.compatible(a, b, rank):
                    self.parts[rank] = (a, b)
                    break
            else:
                raise ValueError(f"token {rank} is not merged from two tokens of lower rank")
        self.known.clear()
        return self.parts

    def compatible(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether merging the bytes of tokens a and b, by ranks under ``below``, ends with a and b."""
        known = self.known.get((a, b)) if below is None else None
        if known is not None:
            return known
        left, right, limit = a, b, len(self.tokens) if below is None else below
        tokens, ranks, parts, good = self.tokens, self.ranks, self.parts, True
        while True:
            joined = ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < limit:
                good = False
                break
            # undo the later of the two last merges: what touches the border then is a part of it
            whole_left, whole_right = parts[left][1] == left, parts[right][0] == right
            if whole_left and whole_right:
                break
            if whole_right or (not whole_left and left > right):
                limit, left = left, parts[left][1]
            else:
                # of equal ranks the left one is merged first: the border's own may still come before
                limit, right = right + 1, parts[right][0]
        if below is None:
            if len(self.known) > PAIRS:
                self.known.clear()
            self.known[a, b] = good
        return good


class Splitter:
    """Borders of the pattern's matches, with the classes of characters that the library uses."""

    # plain stand-ins that take part in no other alternative of a pattern than their class
    LETTER, DIGIT, SPACE, OTHER = "a", "1", "\t", "!"

    def __init__(self, pattern: str):
        self.text, self.pattern = pattern, regex.compile(pattern)
        unknown = "".join(re.escape(chr(c)) for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn")
        self.odd = re.compile(f"[{unknown}\U00010000-\U0010ffff]")
        self.stand_ins: dict[int, str] = {}
        self.library = None

    def matches(self, text: str) -> list[str]:
        if text.isascii() or not self.odd.search(text):
            return self.pattern.findall(text)
        for c in set(self.odd.findall(text)):
            if ord(c) not in self.stand_ins:
                self.stand_ins[ord(c)] = self._class(c)
        plain = text.translate(self.stand_ins)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]

    def _class(self, c: str) -> str:
        """The stand-in that the library keeps in one match with ``c``: a vocabulary in which only a
        last byte and a following stand-in merge shows where it splits."""
        if self.library is None:
            import tiktoken

            ranks = {bytes([b]): b for b in range(256)}
            for follower in (self.LETTER, self.DIGIT, self.SPACE, self.OTHER):
                ranks |= {bytes([b, ord(follower)]): len(ranks) + b for b in range(256)}
            self.library = tiktoken.Encoding("classes", pat_str=self.text, mergeable_ranks=ranks, special_tokens={})
        for follower in (self.LETTER, self.DIGIT, self.SPACE, self.OTHER):
            if self.library.encode_ordinary(c + follower)[-1] >= 256:
                return follower
        return self.OTHER


class Codec:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.splitter = vocabulary, Splitter(pattern)
        self.length = [len(t) for t in vocabulary.tokens]
        self.automaton = ahocorasick.Automaton()
        for rank, token in enumerate(vocabulary.tokens):
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.prefix: dict[int, int] = {}
        self.memo: dict[str, bytes] = {}

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or NONE."""
        found = self.prefix.get(token)
        if found is None:
            raw, ranks = self.vocabulary.tokens[token], self.vocabulary.ranks
            ranked = (ranks[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in ranks)
            found = self.prefix[token] = next(ranked, NONE)
        return found

    def match_ids(self, raw: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.vocabulary.ranks.get(raw)
        if whole is not None:
            return [whole]
        length, compatible, shorter = self.length, self.vocabulary.compatible, self.shorter
        longest = [NONE] * (len(raw) + 1)
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # ends ascend, so the longest comes last
        alive, taken, at, token = bytearray(b"\1") * (len(raw) + 1), [], 0, longest[0]
        while at < len(raw):
            while token != NONE:
                end = at + length[token]
                if alive[end] and (not taken or compatible(taken[-1], token)):
                    break
                token = shorter(token)
            if token != NONE:
                taken.append(token)
                at, token = end, longest[end]
            else:
                alive[at] = 0
                token = taken.pop()
                at -= length[token]
        return taken

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        memo, found = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        for match in self.splitter.matches(text or ""):
            packed = memo.get(match)
            if packed is None:
                packed = np.array(self.match_ids(match.encode("utf-8", "replace")), "<u4").tobytes()
                if len(match) < LONG:
                    memo[match] = packed
            found.append(packed)
        return b"".join(found)

    def decode(self, ids: np.ndarray | None) -> bytes:
        tokens = self.vocabulary.tokens
        return b"" if ids is None else b"".join([tokens[i] for i in ids.tolist() if 0 <= i < len(tokens)])


def _small(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.iloc[at : at + ROWS]


class ByteBpe:
    """Column functions of one vocabulary file."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        sent = spark.sparkContext.broadcast(Vocabulary.read(path))

        def codec() -> Codec:
            return in_worker(("byte bpe", path, pattern), lambda: Codec(sent.value, pattern))

        @pandas_udf(ArrayType(IntegerType()))
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in _small(batches):
                yield pd.Series([np.frombuffer(codec().encode(t), "<i4") for t in batch], dtype=object)

        @pandas_udf(StringType())
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in _small(batches):
                yield pd.Series([codec().decode(ids).decode("utf-8", "replace") for ids in batch], dtype=object)

        @pandas_udf("packed binary, decoded binary")
        def transcode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in _small(batches):
                packed = [codec().encode(t) for t in batch]
                decoded = [codec().decode(np.frombuffer(p, "<u4")) for p in packed]
                yield pd.DataFrame({"packed": packed, "decoded": decoded}, dtype=object)

        self._encode, self._decode, self._transcode = encode, decode, transcode

    def encode(self, text: Column) -> Column:
        """array<int> of ids."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """Text of an array<int> of ids."""
        return self._decode(ids)

    def transcode(self, text: Column) -> Column:
        """Struct of ``packed`` (ids as little-endian unsigned 32-bit integers) and of ``decoded``, the
        bytes that the ids stand for."""
        return self._transcode(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded bytes, of every document."""
    import public_tokenizers

    codec = ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", codec.transcode(docs["text"]).alias("c")).select(
        "doc_id",
        (F.octet_length("c.packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("c.packed", 256).alias("ids_sha256"),
        F.sha2("c.decoded", 256).alias("decoded_sha256"),
    )
