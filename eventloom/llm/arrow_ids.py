"""Token ids as Arrow files of fixed-size lists.

Every text is encoded, an end id is appended, and the ids of all documents in ascending doc_id order
form one long sequence, cut into files. A file holds record batches with two columns:
``ids`` (fixed-size list of ``LENGTH`` unsigned 16- or 32-bit integers) and ``mask`` (as many bits,
false for the filling at the end of a file). Buffers are not compressed, so a reader that maps the file
reaches any equal-length sequence or mask without copying. Beside it stands an index file with
doc_id, start (within the file) and n_tokens of each document.

Encoding is the tokenizers library's. A text is split by the pre-tokenizer's pattern, and each
distinct split is encoded once per worker (bounded memo): the model works on splits alone, so the ids
are those of the whole text. Texts with a special token's string, or with characters on which the
pattern's Unicode tables may differ, go to the library whole.

Scale: one range shuffle by doc_id, of texts; encoding and writing follow in the same task, so its
sampling does not encode anything twice. A file is written batch by
batch; a worker holds one batch. Files are named by partition and appear by renaming, so a task that
runs again after a lost executor replaces its file with the same one. The list of files (one row for
each partition) is a written table; first ids of files are running totals over that list.

The folder is a file system URI that pyarrow can open on every executor (a mounted folder, or an
object store), below ``spark.checkpoint.dir`` by default.

Defined results: null and empty texts are the end id alone. Null ids come first; repeated ids keep all
rows, ordered by text. An empty table gives no files. Other columns are not looked at.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.common import in_worker, table
from eventloom.llm.token_counts import unbyte
from eventloom.session import cut, fresh_dir

LENGTH = 1_024  # ids of a sequence
ROWS = 256  # sequences of a record batch
MEMO = 600_000  # splits that a worker remembers
KNOWN = 0x2080  # texts with characters from here on go to the library whole
# Characters below ``KNOWN`` on which the library's Unicode tables and Python's may differ (a test compares the others).
ODD = "\x1c-\x1f\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u180e\u1c89\u1c8a"


def _class(kind: str) -> str:
    """Characters below ``KNOWN`` of a Unicode category, for a bracket expression."""
    return "".join(re.escape(chr(c)) for c in range(KNOWN) if unicodedata.category(chr(c))[0] == kind)


class Encoder(dict):
    """split -> packed ids, by the library's model; unknown splits are encoded when first asked for."""

    def __init__(self, content: str, end: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(content)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters, numbers = _class("L"), _class("N")
        # the pre-tokenizer's published pattern
        self.split = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+"
        )
        self.odd = re.compile(f"[{ODD}{chr(KNOWN)}-\U0010ffff]|" + "|".join(map(re.escape, self.special)))
        self.alphabet = {byte: character for character, byte in unbyte().items()}
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4")
        self.end = np.array([end], self.type).tobytes()

    def __missing__(self, split: str) -> bytes:
        tokens = self.model.tokenize(split.encode().decode("latin-1").translate(self.alphabet))
        packed = self[split] = np.array([t.id for t in tokens], self.type).tobytes()
        return packed

    def encode(self, texts) -> list[bytes]:
        """Ids of each text with the end id, packed."""
        if len(self) > MEMO:
            self.clear()
        found = []
        for text in texts:
            text = text or ""
            if self.odd.search(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                packed = np.array(ids, self.type).tobytes()
            else:
                packed = b"".join(map(self.__getitem__, self.split.findall(text)))
            found.append(packed + self.end)
        return found


def _small(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_ids(
    docs: DataFrame, folder: str, path: str, end: int, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH
) -> DataFrame:
    """Encode and write ``docs`` in doc_id order; one row per file: part, n_ids, n_docs."""
    with open(path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    narrow = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context, encoder = TaskContext.get(), in_worker(("ids", len(sent.value), end), lambda: Encoder(sent.value, end))
        kind = encoder.type
        part, attempt = context.partitionId(), context.taskAttemptId()
        files, base = _place(folder)
        files.create_dir(base, recursive=True)
        item = pa.from_numpy_dtype(kind)
        schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        about = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        names = [f"{base}/{stem}-{part:06d}.arrow" for stem in ("ids", "docs")]
        drafts = [f"{name}.{attempt}" for name in names]
        held, size, start, n_docs = [], 0, 0, 0

        def put(writer, ids: np.ndarray) -> None:
            mask = np.ones(len(ids) + -len(ids) % length, bool)
            mask[len(ids) :] = False
            ids = np.concatenate([ids, np.zeros(len(mask) - len(ids), ids.dtype)])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), length) for x in (ids, mask)]
            writer.write_batch(pa.record_batch(columns, schema=schema))

        with files.open_output_stream(drafts[0]) as out, files.open_output_stream(drafts[1]) as index:
            with pa.ipc.new_file(out, schema) as writer, pa.ipc.new_file(index, about) as entries:
                for batch in _small(batches):
                    packed = encoder.encode(batch["text"])
                    counts = np.array([len(p) for p in packed], np.int64) // kind.itemsize
                    starts = start + np.concatenate([[0], np.cumsum(counts)])
                    ids = pa.array(batch["doc_id"].astype("Int64"), pa.int64(), from_pandas=True)
                    entries.write_batch(pa.record_batch([ids, pa.array(starts[:-1]), pa.array(counts)], schema=about))
                    start, n_docs = int(starts[-1]), n_docs + len(batch)
                    for p in packed:
                        held.append(np.frombuffer(p, kind))
                        size += len(held[-1])
                        if size >= length * ROWS:
                            joined = np.concatenate(held)
                            full = size - size % length
                            put(writer, joined[:full])
                            held, size = [joined[full:]], size - full
                if size:
                    put(writer, np.concatenate(held))
        for draft, name in zip(drafts, names):
            files.move(draft, name)
        yield pd.DataFrame({"part": [part], "n_ids": [start], "n_docs": [n_docs]})

    return cut(ordered.mapInPandas(write, "part long, n_ids long, n_docs long"))


def read_ids(files_written: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    ids_crc32 is the unsigned crc32 of the document's ids as little-endian 32-bit integers.
    """
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = cut(files_written.select("part", F.coalesce(before, F.lit(0)).alias("first")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _place(folder)
        for batch in batches:
            for part, first in zip(batch["part"], batch["first"]):
                name = f"{part:06d}.arrow"
                with files.open_input_file(f"{base}/docs-{name}") as index, files.open_input_file(f"{base}/ids-{name}") as file:
                    sequences, entries = pa.ipc.open_file(file), pa.ipc.open_file(index)
                    held, at, next_batch = np.zeros(0, "<u4"), 0, 0  # ids from ``at`` on
                    for i in range(entries.num_record_batches):
                        about = entries.get_batch(i)
                        starts, counts = about.column("start").to_numpy(), about.column("n_tokens").to_numpy()
                        crcs = np.zeros(len(starts), np.int64)
                        for k, (start, count) in enumerate(zip(starts.tolist(), counts.tolist())):
                            crc = 0
                            while count:
                                while start >= at + len(held):
                                    got, at = sequences.get_batch(next_batch), at + len(held)
                                    next_batch += 1
                                    mask = got.column("mask").flatten().to_numpy(zero_copy_only=False)
                                    held = got.column("ids").flatten().to_numpy()[mask].astype("<u4")
                                piece = held[start - at : start - at + count]
                                crc = zlib.crc32(piece.tobytes(), crc)
                                start, count = start + len(piece), count - len(piece)
                            crcs[k] = crc
                        ids = about.column("doc_id").to_pandas(integer_object_nulls=True).astype("Int64")
                        columns = {"doc_id": ids, "start": starts + first, "n_tokens": counts, "ids_crc32": crcs}
                        yield pd.DataFrame(columns)

    tasks = int(files_written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "part").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = fresh_dir(spark, "ids")
    written = write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_ids(written, folder)
