"""Token-id output: length-delimited binary records with masked checksums and an offset index.

A record is framed as  length (8 bytes) | masked checksum of the length (4) | payload | masked checksum of the payload (4),
all little-endian. The checksum is CRC-32, masked as ((c >> 15 | c << 17) + 0xa282ead8) mod 2^32, so that checksums over
data that holds checksums stay sound. A payload is  flags (1) | id (8, if flag 1) | token ids, as 16-bit integers or, if
flag 2, 32-bit ones. Files are written in ascending id order (null first), one for each range of ids; beside them stands
the index, a Parquet table of each record's file, offset and length, by which records are read in any order.

Texts are shuffled once, by ranges of ids. Each attempt of a task writes a file of its own name, and only files that the
index names count, so lost executors and repeated attempts do no harm. Files go through pyarrow.fs to the shared folder
that spark.checkpoint.dir names. Only one total for each file is put in order to number the ids over all files.

A text of any length is one record, whose ids a task holds whole. Columns other than id and text are ignored, whatever their names.
Null texts count as empty and yield the end id alone; rows with equal ids follow each other by text; an empty table
gives an empty index.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh_path, short_batches, whole_text
from .units import UnitCache

INDEX = "part int, path string, place long, doc_id long, at long, bytes long, first long, n_tokens long"
READ = "part int, place long, doc_id long, first long, n_tokens long, ids_crc32 long"
#: Documents of one output batch, units of one call of the library.
DOCS, UNITS = 512, 5000
#: Words that a worker remembers at most, with their ids some 200 bytes each.
REMEMBERED = 500_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return bytes([(doc_id is not None) | wide << 1]) + (b"" if doc_id is None else struct.pack("<q", doc_id)) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, at = payload[0], 1
    doc_id = None
    if flags & 1:
        doc_id, at = struct.unpack_from("<q", payload, 1)[0], 9
    return doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=at).astype("<u4")


def read_frame(source, at: int | None = None) -> bytes | None:
    """The payload of the record at the source's (or the given) position; None at the end of the file."""
    if at is not None:
        source.seek(at)
    head = source.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack_from("<I", head, 8)[0] != masked(head[:8]):
        raise ValueError("a record's length is damaged")
    payload = source.read(struct.unpack_from("<Q", head)[0])
    if struct.unpack("<I", source.read(4))[0] != masked(payload):
        raise ValueError("a record is damaged")
    return payload


def open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


@lru_cache(maxsize=2)
def library_encoder(path: str) -> UnitCache:
    """Words encoded by the tokenizers library, remembered. Texts that hold the string of an added token, which the library
    gives that token's id, are encoded whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    special = re.compile("|".join(map(re.escape, added))).search if added else None

    # Bytes of each token: byte-level tokens have one character for each. Others do not add up to their units' bytes.
    n_bytes = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        n_bytes[i] = len(token)

    def by_library(units: list[str]) -> list[bytes]:
        found = tokenizer.encode(units, is_pretokenized=True, add_special_tokens=False)
        ends = (np.bincount(np.array(found.word_ids, np.int64), minlength=len(units)).cumsum() * 4).tolist()
        data = np.array(found.ids, "<u4").tobytes()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode(units: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(units), UNITS):
            part = units[k : k + UNITS]
            if special and any(map(special, part)):
                out += [np.array(tokenizer.encode(u, add_special_tokens=False).ids, "<u4").tobytes() for u in part]
                continue
            # Each unit by itself, in one call; the fast one does not tell where units end, but their bytes do.
            ids = np.array(tokenizer.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64)
            upto, want = n_bytes[ids].cumsum(), np.fromiter(map(len, part if all(map(str.isascii, part)) else map(str.encode, part)), np.int64, len(part)).cumsum()
            ends = np.searchsorted(upto, want, "right")
            if not np.array_equal(np.r_[0, upto][ends], want):
                out += by_library(part)
                continue
            data, ends = ids.astype("<u4").tobytes(), (ends * 4).tolist()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out

    return UnitCache(encode, REMEMBERED, special)


def write_records(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the records under `folder`/data, their index under `folder`/index, and returns the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/data/part-{part:05d}-{uuid.uuid4().hex}.records"
        own, sink, at, first, place = library_encoder(tokenizer_path), None, 0, 0, 0
        end = np.array([end_id], "<u4").tobytes()
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, DOCS):
                    rows = batch.slice(start, DOCS)
                    if sink is None:
                        store, name = open_store(path)
                        store.create_dir(name.rpartition("/")[0], recursive=True)
                        sink = store.open_output_stream(name)
                    out = []
                    for doc_id, ids in zip(rows.column(0).to_pylist(), own.encode(rows.column(1).to_pylist())):
                        record = frame(pack(doc_id, np.frombuffer(ids + end, "<u4")))
                        sink.write(record)
                        out.append((part, path, place, doc_id, at, len(record), first, len(ids) // 4 + 1))
                        at, first, place = at + len(record), first + len(ids) // 4 + 1, place + 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.string(), *[pa.int64()] * 6))], names=[f.split()[0] for f in INDEX.split(", ")])
        finally:
            if sink is not None:
                sink.close()

    short_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    spark = docs.sparkSession
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_files(index: DataFrame) -> DataFrame:
    """Reads every file that the index names from start to end: each record's place, id, first token's place in the file, length and checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ.split(", ")]
        kinds = (pa.int32(), *[pa.int64()] * 5)
        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = open_store(path)
                with store.open_input_stream(name, buffer_size=1 << 20) as source:
                    out, first, place = [], 0, 0
                    while (payload := read_frame(source)) is not None:
                        doc_id, ids = unpack(payload)
                        out.append((part, place, doc_id, first, len(ids), zlib.crc32(ids.tobytes())))
                        first, place = first + len(ids), place + 1
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    files = index.select("part", "path").distinct()
    return files.repartitionByRange(max(1, files.count()), "part").mapInArrow(run, READ)


def read_some(index: DataFrame) -> DataFrame:
    """doc_id and ids of the index's rows, in any order, by their offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = open_store(path)
                with store.open_input_file(name) as source:
                    doc_id, ids = unpack(read_frame(source, at))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return index.select("path", "at").mapInArrow(run, "doc_id long, ids array<long>")


def numbered(records: DataFrame, index: DataFrame) -> DataFrame:
    """Records with start: the tokens of all records before them over all files. Only a total for each file is ordered."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    return records.join(before, "part").withColumn("start", F.col("before") + F.col("first"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    index = write_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "token-records"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return numbered(read_files(index), index).select("doc_id", "start", "n_tokens", "ids_crc32")
