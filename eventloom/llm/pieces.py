"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a one-pass Viterbi search.

Pieces and scores come from a model file whose path is a parameter. A text gets a space in front and
its spaces become the mark U+2581. At each position the automaton reports all pieces that end
there, longest first; each relaxes the best score of the position. A character that no
piece covers costs ``UNKNOWN`` below the lowest score and is written as byte pieces. Of equal scores
the longest last piece stays. The result is the segmentation with the highest sum of scores.

No piece has the mark after another character, so the best segmentation of a text is that of its
parts, cut before each run of marks; frequent parts are searched once per worker (bounded memo).
``Codec`` checks this of the model and takes the text as one part where it does not hold.

Scale: one scan, no shuffle. The pieces are read on the driver and broadcast (32,000 in the model
used here, the size of the file in any case). Encoding and decoding share one Python worker, which
sends its rows back ``ROWS`` at a time.

Defined results: null and empty texts have no ids and decode to the empty text. Decoding gives the
text back, but for the mark itself, which reads as a space. Repeated rows and ids are rows like
others, an empty table gives an empty result, other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

from eventloom.llm.common import in_worker, table

MARK = "▁"
UNKNOWN = 10.0
MEMO = 250_000  # parts that a worker remembers
ROWS = 1_000


def read_model(path: str) -> dict:
    """Pieces (text, score, id), byte pieces (byte -> id) of a model file, as plain values."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain, of_byte = [], {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            of_byte[int(piece[3:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            plain.append((piece, model.get_score(i), i))
    return {"path": path, "pieces": plain, "bytes": of_byte, "unknown": model.unk_id()}


class Codec:
    def __init__(self, model: dict):
        self.automaton = ahocorasick.Automaton()
        for piece, score, i in model["pieces"]:
            self.automaton.add_word(piece, (len(piece), score, i))
        self.automaton.make_automaton()
        self.lowest = min(score for _, score, _ in model["pieces"]) - UNKNOWN
        self.of_byte, self.unknown = model["bytes"], model["unknown"]
        self.written = {i: piece.encode() for piece, _, i in model["pieces"]}
        self.written |= {i: bytes([b]) for b, i in self.of_byte.items()}
        apart = all(MARK not in piece.lstrip(MARK) for piece, _, _ in model["pieces"])
        self.part = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if apart else "(?s:.+)")
        self.memo: dict[str, bytes] = {}

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, found = self.memo, []
        for part in self.part.findall(MARK + text.replace(" ", MARK)):
            ids = memo.get(part)
            if ids is None:
                ids = self.best(part).tobytes()
                if len(part) < 64:
                    memo[part] = ids
            found.append(ids)
        return np.frombuffer(b"".join(found), np.int32)

    def best(self, part: str) -> np.ndarray:
        """Ids of the best segmentation of one part."""
        n = len(part)
        score, came, by = [0.0] + [None] * n, [0] * (n + 1), [None] * (n + 1)
        done, alone = 0, False  # positions up to ``done`` are settled; ``alone``: a one-character piece ends at done + 1

        def settle(until: int) -> None:
            nonlocal done, alone
            while done < until:
                if not alone:
                    cost = score[done] + self.lowest
                    if score[done + 1] is None or cost > score[done + 1]:
                        score[done + 1], came[done + 1], by[done + 1] = cost, done, None
                done, alone = done + 1, False

        for end, (length, gain, i) in self.automaton.iter(part):
            settle(end)
            total = score[end + 1 - length] + gain
            if score[end + 1] is None or total > score[end + 1]:
                score[end + 1], came[end + 1], by[end + 1] = total, end + 1 - length, i
            alone |= length == 1
        settle(n)
        ids, at = [], n
        while at:
            if by[at] is not None:
                ids.append(by[at])
            else:
                raw = part[came[at] : at].encode("utf-8", "replace")
                ids.extend(self.of_byte.get(b, self.unknown) for b in reversed(raw))
            at = came[at]
        return np.array(ids[::-1], np.int32)

    def decode(self, ids) -> str:
        if ids is None:
            return ""
        raw = b"".join([self.written.get(i, b"") for i in ids.tolist()])
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def _codec(model) -> Codec:
    return in_worker(("pieces", model.value["path"]), lambda: Codec(model.value))


def _rows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.iloc[at : at + ROWS]


class Pieces:
    """Column functions of one model."""

    def __init__(self, spark: SparkSession, path: str):
        model = spark.sparkContext.broadcast(read_model(path))

        @pandas_udf(ArrayType(IntegerType()))
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in _rows(batches):
                yield pd.Series([_codec(model).encode(t) for t in batch], dtype=object)

        @pandas_udf(StringType())
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in _rows(batches):
                yield pd.Series([_codec(model).decode(ids) for ids in batch], dtype=object)

        @pandas_udf("ids array<int>, decoded string")
        def transcode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in _rows(batches):
                ids = [_codec(model).encode(t) for t in batch]
                yield pd.DataFrame({"ids": ids, "decoded": [_codec(model).decode(x) for x in ids]})

        self._encode, self._decode, self._transcode = encode, decode, transcode

    def encode(self, text: Column) -> Column:
        """array<int> of piece ids."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """Text of an array of piece ids."""
        return self._decode(ids)

    def transcode(self, text: Column) -> Column:
        """Struct of ids and of the text that they decode to."""
        return self._transcode(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_hash (xxhash64 of the ids) and whether decoding gives the text back."""
    import public_tokenizers

    codec = Pieces(spark, public_tokenizers.path("piece_bpe_32k.model"))
    encoded = table(spark, sf_dir, "documents").select("doc_id", "text", codec.transcode(F.col("text")).alias("c"))
    return encoded.select(
        "doc_id",
        F.size("c.ids").cast("long").alias("n_tokens"),
        F.xxhash64("c.ids").alias("ids_hash"),
        (F.col("c.decoded") == F.translate(F.coalesce("text", F.lit("")), MARK, " ")).alias("decoded"),
    )
