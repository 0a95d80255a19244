"""The Merkle manifest against a plain tree, and its edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from skylattice.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(level, fan_in):
    levels = [level]
    while len(level) > 1:
        level = [h(*level[i : i + fan_in]) for i in range(0, len(level), fan_in)]
        levels.append(level)
    return levels


def expected(rows, fan_in):
    """Sorted tuples of the manifest's columns, by plain loops."""
    leaf = lambda r, text: h(*map(framed, (r[0], r[3], r[2], r[4], text)))
    by_source = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))):
        by_source.setdefault(r[3], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r, r[1]) for r in by_source[s]], fan_in) for s in names}
    upper = tree([trees[s][-1][0] for s in names], fan_in)
    root, out = upper[-1][0], []
    for k, s in enumerate(names):
        for i, r in enumerate(by_source[s]):
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            acc, proof = leaf(r, r[1].replace("\n", "") if cut else r[1]), ""
            for levels, at in ((trees[s], i), (upper, k)):
                for level in levels[:-1]:
                    run, own = level[at - at % fan_in :][:fan_in], at % fan_in
                    left, right = "".join(run[:own]), "".join(run[own + 1 :])
                    proof, acc, at = proof + left + right, h(left, acc, right), at // fan_in
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], root, h(proof), acc, acc == root))
    return sorted(out, key=str)


def found(spark, rows, fan_in=3):
    docs = spark.createDataFrame(rows, SCHEMA)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return sorted(map(tuple, merkle.manifest(docs, F.when(even, F.replace("text", F.lit("\n"), F.lit(""))), fan_in).collect()), key=str)


@pytest.mark.parametrize("fan_in", [2, 3])
def test_against_plain_tree(spark, fan_in):
    rows = [(i, f"line {i}\nand {'ü' * (i % 5)}", "en", ["a", "b", None, "ä", "a"][i % 5], i, "extra") for i in range(0, 60)]
    rows += [(1000, "alone\n", None, "z", None, None), (1001, None, None, "y", 3, None), (1002, "", "", "", 0, None)]
    assert found(spark, rows, fan_in) == expected(rows, fan_in)


def test_nulls_repeated_rows_and_long_text(spark):
    rows = [(None, "x", "en", "s", 1, None)] * 4 + [(None, None, None, None, None, None)] * 2 + [(7, "same\nrow", "en", "s", 8, None)] * 3 + [(8, "w\n" * 500_000, "en", "t", 1, None)]
    assert found(spark, rows) == expected(rows, 3)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10])
def test_small_tables(spark, n):
    rows = [(i, f"t\n{i}", "en", "s", i, None) for i in range(n)]
    assert found(spark, rows) == (expected(rows, 3) if rows else [])
