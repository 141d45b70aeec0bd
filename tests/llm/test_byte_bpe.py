"""Byte-level BPE by backtracking: the tiktoken library's ids, plain merging, round trips, edge cases."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from eventloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "\n\n\t ", "Hello, world!", "it's I'll we've 'sss", "a" * 3_000, " " * 700, "ab" * 900, "12345 678",
    "naïve Größe l'été", "тест проверки", "的一是不了人我在", "\U0001f600\U0001f9d1‍\U0001f680", "x\x1cy\x85z\xa0w　v",
    "a՘b ࢏1 \U000323af\U0001d7ce!", "tail  \n", "\u0000\u0001", "<|endoftext|>",
]


def random_texts(n=400):
    draw = random.Random(5)
    kinds = ["abcdefghij", "aeinrst", "  \n\t'sredvlm", "的一是不了人", "éüñçßàабвгд", "0123456789", "!?.,-_()[]{}", "՘\U0001d7ce"]
    return ["".join(draw.choice(draw.choice(kinds)) for _ in range(draw.randrange(1, 90))) for _ in range(n)]


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_ids_and_bytes_of_a_frame(spark, library):
    texts = TEXTS + random_texts()
    rows = [(i, t, "p", "d") for i, t in enumerate(texts)] + [(3, texts[9], "p", "d"), (None, texts[4], "p", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, packed string, decoded string")
    codec = byte_bpe.ByteBpe(spark, PATH, public_tokenizers.PATTERN)
    coded = docs.withColumn("c", codec.transcode(docs["text"])).withColumn("ids", codec.encode(docs["text"]))
    got = coded.withColumn("again", codec.decode(F.col("ids"))).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert r.ids == ids and r.again == (r.text or "")
        assert bytes(r.c.packed) == np.array(ids, "<u4").tobytes() and bytes(r.c.decoded) == (r.text or "").encode()
    assert docs.limit(0).select(codec.encode(docs["text"])).collect() == []


def test_unknown_ids_have_no_bytes(spark):
    codec = byte_bpe.ByteBpe(spark, PATH, public_tokenizers.PATTERN)
    frame = spark.createDataFrame([([-1, 60_000],), (None,), ([255],)], "ids array<int>")
    assert [r[0] for r in frame.select(codec.decode(F.col("ids"))).collect()][:2] == ["", ""]


def merged(ranks, raw):
    """Plain merging by rank, the leftmost of the lowest first."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_small_vocabularies_equal_plain_merging(seed):
    """Vocabularies trained on nothing: random merges over three letters, all short words over them."""
    draw = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 256 + 25:
        pool = [t for t in ranks if set(t) <= set(b"abc")]
        token = draw.choice(pool) + draw.choice(pool)
        if token not in ranks and len(token) < 9 and len(merged(ranks, token)) == 2:
            ranks[token] = len(ranks)
    codec = byte_bpe.Codec(byte_bpe.Vocabulary(ranks), r"(?s).+")
    words = [""]
    for _ in range(8):
        words += [w + c for w in words for c in "abc" if len(w) == len(words[-1])]
    words += ["".join(draw.choices("abc", k=60)) for _ in range(300)]
    for w in words[1:]:
        assert codec.match_ids(w.encode()) == ([ranks[w.encode()]] if w.encode() in ranks else merged(ranks, w.encode())), w


def test_every_unknown_character_splits_as_in_the_library(library):
    splitter = byte_bpe.Splitter(public_tokenizers.PATTERN)
    odd = [chr(c) for c in range(0x80, 0x33000, 7) if not 0xD800 <= c < 0xE000 and splitter.odd.match(chr(c))]
    text = "".join(f"ab{c}12{c}  {c}!?{c}\n" for c in odd)
    ids = library.encode_ordinary(text)
    codec = byte_bpe.Codec(byte_bpe.Vocabulary.read(PATH), public_tokenizers.PATTERN)
    assert codec.encode(text) == np.array(ids, "<u4").tobytes()


def test_vocabularies_out_of_order_are_refused(tmp_path):
    ranks = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="not merged from"):
        byte_bpe.Vocabulary(ranks | {b"abc": 256, b"ab": 257})
    path = tmp_path / "few.tiktoken"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="lacks 255 bytes"):
        byte_bpe.Vocabulary.read(str(path))


def test_query(spark, sf, library):
    got = {r.doc_id: r for r in byte_bpe.query(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = library.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
