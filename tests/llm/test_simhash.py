"""SimHash components against all pairs, bit slicing against plain distances, edge cases."""

import random

import numpy as np
import pyarrow as pa
import xxhash

from skylattice.llm import simhash

SCHEMA = "doc_id long, text string, fp string, fixed int"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((r[0], f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def found(spark, rows, **how):
    return sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=str)


def test_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        rows.append((len(rows), " ".join(text), None, None))
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), "  ".join(copy).upper(), None, 5))
    want = plain_components(rows)
    assert len({c for *_, c in want}) < len(rows) - 20
    assert found(spark, rows) == want


def test_nulls_blanks_repeats(spark):
    rows = [(None, None, None, 1), (5, "", None, 2), (4, " \n\t", None, 3), (9, "a", None, None), (9, "a", None, None), (8, "a b", None, None), (None, "q r s t", "x", 0), (7, " Ä B C", None, None)]
    assert found(spark, rows) == plain_components(rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_long_text(spark):
    text = " ".join(f"w{i * i % 7919}" for i in range(300_000))
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def clustered(n, seed):
    """Distinct fingerprints, most of them around few centres: some bits differ, all others are equal."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fp = centres[rng.integers(0, 3, n)]
    for _ in range(5):
        fp = fp ^ np.where(rng.random(n) < 0.7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    return np.unique(fp)


def test_bit_slices_find_what_distances_say():
    fp = clustered(700, 1)
    for radius in (0, 1, 2, 3, 5):
        got = {tuple(sorted(p)) for u, v in simhash.within(fp, np.array([400, 200, len(fp) - 600]), 0, radius) for p in zip(u.tolist(), v.tolist())}
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
        bucket = np.repeat([0, 1, 2], [400, 200, len(fp) - 600])
        i, j = np.nonzero(np.triu(near & (bucket[:, None] == bucket[None, :]), 1))
        assert got == {tuple(sorted(p)) for p in zip(fp[i].tolist(), fp[j].tolist())}


def test_large_buckets_are_dealt_again(spark):
    """Nearly all fingerprints share buckets that are larger than allowed, through a broadcast and within a task."""
    fp = clustered(1500, 2).view(np.int64)
    frame = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    near = np.triu(np.bitwise_count((fp[:, None] ^ fp[None, :]).view(np.uint64)) <= 2, 1)
    want = {tuple(sorted(p)) for p in zip(fp[np.nonzero(near)[0]].tolist(), fp[np.nonzero(near)[1]].tolist())}
    got = {tuple(sorted(p)) for p in simhash.links(frame, 2, 40).collect()}
    assert got == want and len(want) > 1000


def test_rows_of_large_buckets_go_out_over_batches():
    rows = np.array([(3, 1, k) for k in range(5)] + [(3, 2, k) for k in range(50)] + [(3, 4, 100), (3, 4, 101)], np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in part.T], names=["fixed", "value", "fp"]) for part in np.array_split(rows, 9)]
    before, simhash.ROWS = simhash.ROWS, 1
    try:
        out = pa.Table.from_batches(simhash.compared(iter(batches), 2, 10)).to_pylist()
    finally:
        simhash.ROWS = before
    assert sorted(r["fp"] for r in out if r["fp"] is not None) == list(range(50))
    assert (100, 101) in {(r["u"], r["v"]) for r in out if r["u"] is not None}
