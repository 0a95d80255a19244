"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes ends a chunk wherever it has one residue modulo the block size; each chunk's hash
gives two characters of the signature. The block size follows from the length, is halved while it gives too few chunks
and doubled while it gives too many, so that every part of a text counts alike; a fingerprint holds the block size and the signatures for it and for twice it. Fingerprints whose block sizes are
equal or differ by the factor two are compared by the insert-and-delete edit distance of their chunk sequences.

`neighbours` gives each document its next one in descending id order without putting all documents in one task: ids are
cut into ranges of about RANGE_BYTES of text, by id, beginning and hash of the text, so that no id is too frequent for a range; each range's last document
is also sent, as a ghost, to the next range (the last range's to the first), and each range is streamed in order. Only the ranges' largest keys reach the driver.

Columns other than id and text are ignored, whatever their names. Null texts count as empty; empty texts have the empty signature and are like each other. Null ids come before all others;
equal ids follow each other by the first 64 characters of text, then by its hash. Repeated rows stay in one range. A single document is its own neighbour. A text that repeats itself may have more
than MOST chunks: a hash value that returns all along it stops ending chunks at one doubling, which then would leave
fewer than LEAST; it keeps them up to LONGEST, where the comparison's cost ends it.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, whole_text

WINDOW, LEAST_BLOCK, CHUNKS, MOST = 7, 3, 64, 64
LEAST, LONGEST = 16, 4096
#: Text of one range, which is one task's, and the most ranges: what their ends take on the driver is bounded.
RANGE_BYTES, RANGES = 16 << 20, 100_000
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PAIR = [a + b for a in LETTERS for b in LETTERS]


def rolling(raw: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the window's sum weighted by nearness and its shifted exclusive or, mixed."""
    n = len(raw)
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), raw.astype(np.uint32)])
    total, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for j in range(WINDOW):
        byte = padded[WINDOW - 1 - j : WINDOW - 1 - j + n]
        total += byte * np.uint32(1 + WINDOW - j)
        mixed ^= byte << np.uint32(5 * j)
    # Sums of a window take few residues of some block sizes: mixed, all are equally likely, so chunks follow the length.
    mixed ^= total * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    return mixed ^ mixed >> np.uint32(13)


def signature(data: bytes, ends: np.ndarray) -> str:
    """ends: places after which chunks end."""
    cuts = [0, *(ends + 1).tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    return "".join(PAIR[zlib.crc32(data[a:b]) & 0xFFF] for a, b in zip(cuts, cuts[1:]))


def fingerprint(text: str) -> str:
    data = text.encode()
    if not data:
        return f"{LEAST_BLOCK}::"
    hashes = rolling(np.frombuffer(data, np.uint8))
    block = LEAST_BLOCK
    while block * CHUNKS < len(data):
        block *= 2
    ends = np.flatnonzero(hashes % np.uint32(block) == block - 1)
    while len(ends) < CHUNKS // 2 and block > LEAST_BLOCK:
        block //= 2
        ends = np.flatnonzero(hashes % np.uint32(block) == block - 1)
    # In 64 bits: a block may be doubled beyond 32.
    twice = lambda: ends[hashes[ends].astype(np.int64) % (2 * block) == 2 * block - 1]
    while len(ends) >= MOST and (len(fewer := twice()) >= LEAST or len(ends) >= LONGEST):
        block, ends = 2 * block, fewer
    coarse = twice()
    return f"{block}:{signature(data, ends)}:{signature(data, coarse)}"


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a word of bits for each step."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    if not where.keys() & set(b):
        return 0
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def alike(a: str, b: str) -> float:
    """1 less the edit distance of two signatures over their joint length."""
    x, y = [a[i : i + 2] for i in range(0, len(a), 2)], [b[i : i + 2] for i in range(0, len(b), 2)]
    return 2 * common_length(x, y) / (len(x) + len(y)) if x and y else 0.0


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    if m == n:
        return max(alike(a1, b1), alike(a2, b2))
    if int(m) == 2 * int(n):
        return alike(a1, b2)
    if int(n) == 2 * int(m):
        return alike(a2, b1)
    return 0.0


def edited(text: str, following: str) -> str:
    """The last half of the text's characters replaced by the first as many of the following document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: What rows are put in order by: id, nulls first, the beginning of the text, a hash of all of it.
ORDER = ("order", "head", "hash")


def in_ranges(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, ghost, doc_id, text) rows, each range sorted; its ghosts, which come first, are the documents before its own."""
    placed = docs.withColumns({"order": F.coalesce(F.col("doc_id"), F.lit(-(2**63))), "head": F.substring("text", 1, 64), "hash": F.xxhash64("text")})
    # Only the keys are shuffled to find each range's largest one; a row is of the first range whose largest key is not below its own.
    keys = placed.select(*ORDER).repartitionByRange(ranges, *ORDER)
    bounds = sorted(tuple(r["last"]) for r in keys.groupBy(F.spark_partition_id()).agg(F.max(F.struct(*ORDER)).alias("last")).collect())
    n = max(1, len(bounds))

    @F.pandas_udf("range long, after long")
    def place(order: pd.Series, head: pd.Series, hashed: pd.Series) -> pd.DataFrame:
        found = [bisect_left(bounds, k) for k in zip(order.tolist(), head.tolist(), hashed.tolist())]
        # A range's largest row is also sent to the range after it, the last one's to the first.
        after = [(i + 1) % n if bounds[i] == k else -1 for i, k in zip(found, zip(order.tolist(), head.tolist(), hashed.tolist()))]
        return pd.DataFrame({"range": found, "after": after}, dtype="int64")

    own = F.struct(F.col("place.range").alias("range"), F.lit(0).alias("ghost"))
    both = F.when(F.col("place.after") >= 0, F.array(own, F.struct(F.col("place.after").alias("range"), F.lit(1).alias("ghost")))).otherwise(F.array(own))
    dealt = placed.withColumn("place", place(*ORDER)).select("doc_id", "text", *ORDER, F.explode(both).alias("at")).select("at.range", "at.ghost", "doc_id", "text", *ORDER)
    return dealt.repartition(n, "range").sortWithinPartitions("range", F.desc("ghost"), *ORDER).select("range", "ghost", "doc_id", "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(ordered: DataFrame) -> DataFrame:
    """For each document of sorted ranges: its fingerprint, that of its edited text, and its likeness to it and to the next document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [f.split()[0] for f in RESULT.split(", ")], (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        following, print_of_it = "", fingerprint("")
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, out = batch.slice(start, 256), []
                for ghost, doc_id, text in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    own = print_of_it if text == following else fingerprint(text)
                    if not ghost:
                        other = edited(text, following)
                        changed = own if other == text else fingerprint(other)
                        out.append((doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, print_of_it)))
                    following, print_of_it = text, own
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return ordered.mapInArrow(run, RESULT)


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    # Small tables still use the cluster's cores.
    ranges = min(RANGES, max(size // RANGE_BYTES + 1, docs.sparkSession.sparkContext.defaultParallelism))
    return compared(in_ranges(rows, ranges))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
