"""Near duplicates by SimHash, compared bit-sliced.

A text's fingerprint has a bit set where over half of its shingles' 64-bit hashes have it. Equal fingerprints are one row
from then on. Two fingerprints that differ in at most `radius` bits agree in at least two of radius + 2 parts of the bits,
so each is dealt to a bucket for every pair of parts (a mask of agreed bits and their values), and links are looked for
within buckets only. A bucket of more than MOST fingerprints is dealt out again by pairs of parts of its free bits, as often
as needed: after two such steps 8 bits are free, so that a bucket has 256 at most. No pair is lost and no bucket capped.

Within a task the fingerprints of one mask lie side by side as bit planes, one bit of 64 of them to a word. For each shift d
every row is compared with the row d after it at once: plane by plane, the differing bits are added to carry-save counters
of as many words, pairs that exceed the radius are struck out, and words (blocks of 64 pairs) are left as soon as all their
pairs are. Larger buckets stand first, so that shift d touches only the buckets that are larger than d.

Components come from the links between distinct fingerprints. There are at most 2,080 links to a fingerprint at radius 2.

Words are runs of bytes other than white space (0x20, 0x09-0x0D), A-Z lower-cased. Fewer words than a shingle are one shingle;
null, empty and blank texts have fingerprint zero, which is linked like any other. A text of any length goes through whole,
its hashes counted in pieces. component_id is the least doc_id, nulls aside, of all rows reachable; it is null where none of
them has an id. Rows with equal or null ids are rows of their own. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.components import components

from .common import lookup, read_table, short_batches, staged, whole_text

SEED, RADIUS, SHINGLE = 42, 2, 3
#: Fingerprints of a bucket that are compared together; a larger bucket is dealt out again.
MOST = 4096
#: Rows that a task compares at a time, hashes that are counted at a time.
ROWS, HASHES = 1 << 17, 1 << 16
#: Planes between two looks at which words still have pairs within the radius.
PLANES = 4


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z and the six white-space bytes only
    if not words:
        return 0
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = (lengths + 1).cumsum() - 1
    starts = (ends - lengths).tolist()
    last = min(shingle, len(words)) - 1
    ends = ends[last:].tolist()
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(ends), HASHES):
        some = np.array([hashed(whole[a:b], SEED) for a, b in zip(starts[k : k + HASHES], ends[k : k + HASHES])], "<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["doc_id", "fp"])

    short_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def masks(fixed: int, radius: int) -> list[int]:
    """The masks of agreed bits, fixed ones included, by which the fingerprints of a bucket are dealt out (again)."""
    free = [b for b in range(64) if not fixed >> b & 1]
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(free, radius + 2)]
    return [fixed | a | b for a, b in combinations(parts, 2)]


def planes(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """Row k: bit bits[k] of all fingerprints, 64 of them to a word, and two words of zeros."""
    flat = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, bits]
    words = np.zeros((len(bits), (len(fp) + 63) // 64 + 2), "<u8")
    packed = np.packbits(flat.T, axis=1, bitorder="little")
    words.view(np.uint8)[:, : packed.shape[1]] = packed
    return words


def within(fp: np.ndarray, sizes: np.ndarray, fixed: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (u, v) of fingerprints that stand bucket by bucket, larger ones first; sizes are the buckets' sizes, fixed their agreed bits."""
    of = np.repeat(sizes, sizes)
    place = np.arange(len(fp)) - np.repeat(sizes.cumsum() - sizes, sizes)
    sliced = planes(fp, [b for b in range(64) if not fixed >> b & 1])
    counters = (radius + 1).bit_length()
    for d in range(1, int(sizes[0]) if len(sizes) else 0):
        rows = int(sizes[sizes > d].sum())
        valid = np.zeros((rows + 63) // 64, "<u8")
        bits = np.packbits(place[:rows] + d < of[:rows], bitorder="little")
        valid.view(np.uint8)[: len(bits)] = bits
        at = np.flatnonzero(valid)
        alive, sums = valid[at], np.zeros((counters, len(at)), "<u8")
        skip, low = d // 64, np.uint64(d % 64)
        high = np.uint64(64 - d % 64)
        # Pairs cross into words after the rows' last one at most where they are not valid.
        for k, plane in enumerate(sliced):
            first = np.minimum(at + skip, sliced.shape[1] - 2)
            other = plane[first] >> low
            if low:
                other |= plane[first + 1] << high
            carry = plane[at] ^ other
            for c in sums:
                c ^= carry
                carry = carry & ~c
            beyond = np.full(len(at), ~np.uint64(0))
            for j, c in enumerate(sums):
                beyond &= c if (radius + 1) >> j & 1 else ~c
            alive &= ~beyond
            if k % PLANES == PLANES - 1:
                left = np.flatnonzero(alive)
                if not len(left):
                    break
                if len(left) < len(at):
                    at, alive, sums = at[left], alive[left], sums[:, left]
        left = np.flatnonzero(alive)
        if len(left):
            word, bit = np.nonzero(np.unpackbits(alive[left].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = at[left][word] * 64 + bit
            yield fp[i], fp[i + d]


def compared(batches: Iterator[pa.RecordBatch], radius: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (fixed, value, fp) in this order -> links (u, v), and the rows (fixed, fp) of buckets that are too large."""
    names, none = ["u", "v", "fixed", "fp"], lambda n: pa.nulls(n, pa.int64())
    links = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none(len(u)), none(len(u))], names=names)
    again = lambda x: pa.RecordBatch.from_arrays([none(len(x)), none(len(x)), pa.array(x[:, 0]), pa.array(x[:, 2])], names=names)
    held, large = np.empty((0, 3), np.int64), None

    def cut(x: np.ndarray, done: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, large
        begins = np.flatnonzero(np.r_[True, (x[1:, :2] != x[:-1, :2]).any(1)])
        sizes = np.diff(np.r_[begins, len(x)])
        too = sizes > most
        if large is not None and tuple(x[0, :2]) == large:
            too[0] = True  # the rest of a bucket whose first rows went out already
        large = tuple(x[-1, :2]) if too[-1] else None
        keep = 0
        if not done and not too[-1]:
            keep, too, begins, sizes = sizes[-1], too[:-1], begins[:-1], sizes[:-1]
        held = x[len(x) - keep :]
        if too.any():
            yield again(x[: len(x) - keep][np.repeat(too, sizes)])
        begins, sizes = begins[~too & (sizes > 1)], sizes[~too & (sizes > 1)]
        for fixed in np.unique(x[begins, 0]):
            own = x[begins, 0] == fixed
            order = np.argsort(-sizes[own], kind="stable")
            b, s = begins[own][order], sizes[own][order]
            rows = np.repeat(b - (s.cumsum() - s), s) + np.arange(s.sum())
            for u, v in within(x[rows, 2], s, int(fixed) & (1 << 64) - 1, radius):
                yield links(u, v)

    waiting, n = [], 0
    for batch in batches:
        waiting.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
        n += batch.num_rows
        if n >= ROWS:
            yield from cut(np.concatenate([held, *waiting]), False)
            waiting, n = [], 0
    rest = np.concatenate([held, *waiting])
    if len(rest):
        yield from cut(rest, True)


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(u, v) of the fingerprints `fp`, each a row once, that differ in at most radius bits; a link may come more than once."""
    fixed = masks(0, radius)
    rows = distinct.select("fp", F.explode(F.array(*[F.lit(signed(m)).cast("long") for m in fixed])).alias("fixed"))
    out = None
    while True:
        rows = staged(rows.withColumn("value", F.col("fp").bitwiseAND(F.col("fixed"))), "simhash-buckets")
        large = rows.groupBy("fixed", "value").count().where(F.col("count") > most)
        # The largest few by broadcast, so that no task gets a bucket with a large share of rows; the others are found within their task.
        top = F.broadcast(large.orderBy(F.desc("count"), "fixed", "value").limit(256).select("fixed", "value"))
        dealt = rows.join(top, ["fixed", "value"], "left_anti").select("fixed", "value", "fp").repartition("fixed", "value").sortWithinPartitions("fixed", "value", "fp")
        found = staged(dealt.mapInArrow(lambda b: compared(b, radius, most), "u long, v long, fixed long, fp long"), "simhash-links")
        pairs = found.where("u is not null").select("u", "v")
        out = pairs if out is None else out.unionByName(pairs)
        again = staged(found.where("fp is not null").select("fixed", "fp").unionByName(rows.join(top, ["fixed", "value"], "left_semi").select("fixed", "fp")), "simhash-large")
        if again.isEmpty():
            return out
        finer = {m: masks(m, radius) for m in fixed}
        fixed = sorted({n for ms in finer.values() for n in ms})
        table = F.create_map(*[x for m, ms in finer.items() for x in (F.lit(signed(m)).cast("long"), F.array(*[F.lit(signed(n)).cast("long") for n in ms]))])
        rows = again.select("fp", F.explode(F.element_at(table, F.col("fixed"))).alias("fixed")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = staged(fingerprints(docs, key, text, shingle), "simhash-rows")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-classes")
    labels = components(links(classes.select("fp"), radius, most))
    rooted = staged(classes.join(labels.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("label", "fp")).drop("label"), "simhash-roots")
    heads = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "simhash-heads")
    of_class = staged(lookup(rooted.drop("n", "least"), heads.drop("n"), ["root"], heads).select("fp", "component_id"), "simhash-components")
    return lookup(rows, of_class, ["fp"], classes).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
