"""The whole query of the quality classifier against a second version of it: plain loops for features, pairs, standardising and threshold, and
another optimiser (accelerated gradient steps to convergence instead of Newton's)."""

import math
import zlib

import numpy as np
import pytest

from skylattice.llm import quality


def slow_features(text):
    data = text.encode()
    n = max(1, len(data))
    count = lambda wanted: sum(chr(b) in wanted for b in data)
    upper, lower, digits = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("abcdefghijklmnopqrstuvwxyz"), count("0123456789")
    space, marks, symbols = count(" \t\r\n"), count(".,;:?'\"-"), count("!#$%&()*+/<=>@[\\]^_`{|}~")
    words = text.split()
    w = max(1, len(words))
    often = {}
    for x in words:
        often[x] = often.get(x, 0) + 1
    repeated = sum(words[i] == words[i + 1] for i in range(len(words) - 1))
    neighbours = {(words[i], words[i + 1]) for i in range(len(words) - 1)}
    lines = text.split("\n")
    return [
        upper / n, math.log(1 + 100 * upper / max(1, upper + lower)), digits / n, space / n, marks / n, symbols / n, math.log(1 + 100 * symbols / n), repeated / w, math.log(1 + 100 * repeated / w),
        len(often) / w, max(often.values(), default=0) / w, len(neighbours) / w, sum(map(len, words)) / w, sum(len(x) <= 3 for x in words) / w, len(set(lines)) / len(lines), math.log(1 + w),
    ]


def spread(x, mean, sd):
    z = [min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(x, mean, sd)]
    return z + [max(v - 1, 0.0) for v in z] + [max(-v - 1, 0.0) for v in z]


def second_version(docs, labels):
    """doc_id -> score."""
    kept = {d: y for d, y in labels.items() if zlib.crc32(str(d).encode()) % 5}
    texts = {d: t or "" for d, t in docs}
    rows = [(slow_features(texts[d]), y) for d, y in sorted(kept.items()) if d in texts]
    n = len(rows)
    mean = [sum(x[c] for x, _ in rows) / n for c in range(16)]
    sd = [max(1e-6, math.sqrt(sum((x[c] - mean[c]) ** 2 for x, _ in rows) / n)) for c in range(16)]
    e = [spread(x, mean, sd) for x, _ in rows]
    good, bad = [i for i in range(n) if rows[i][1] == 1], [i for i in range(n) if rows[i][1] == 0]
    pairs, turns = max(12 * len(bad), len(good)), math.lcm(len(good), len(bad))
    d = np.array([np.subtract(e[good[(i * 7919 + i // turns) % len(good)]], e[bad[i % len(bad)]]) for i in range(pairs)])
    gradient = lambda w: -(d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(0) + 0.01 * w
    step = 1 / (0.25 * np.linalg.norm(d, 2) ** 2 / len(d) + 0.01)
    w = before = np.zeros(48)
    for k in range(200_000):
        ahead = w + (k % 400) / (k % 400 + 3) * (w - before)
        before, w = w, ahead - step * gradient(ahead)
        if k % 400 == 399 and np.abs(gradient(w)).max() < 1e-11:
            break
    strengths = np.array(e) @ w
    share = sum(y == 0 for y in kept.values()) / len(kept)
    mass = [share / len(bad) if y == 0 else (1 - share) / len(good) for _, y in rows]
    order, total, last = sorted(range(n), key=lambda i: strengths[i]), 0.0, -1
    for place, i in enumerate(order):
        total += mass[i]
        if total <= share + 1e-9:
            last = place
    around = [strengths[order[k]] for k in (last, last + 1) if 0 <= k < n]
    threshold = sum(around) / len(around)
    return {x: 1 / (1 + math.exp(-min(30.0, max(-30.0, float(np.dot(spread(slow_features(t), mean, sd), w)) - threshold + math.log(0.3 / 0.7))))) for x, t in texts.items()}


def test_whole_query_against_a_second_version(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    want = second_version(docs, labels)
    rows = quality.op9_quality(spark, sf).collect()
    assert len(rows) == len(docs) == len(want)
    for r in rows:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) and (abs(want[r.doc_id] - 0.3) < 1e-6 or r.predicted == int(want[r.doc_id] >= 0.3))


def test_features_of_odd_texts():
    for text in ("", " ", "\n\n", "A", "a a a", "Ünïcode é 123 !!", "x" * 50_000, "one two\nthree\none two\n" * 40):
        assert quality.features(text) == pytest.approx(slow_features(text), abs=1e-12)


def test_repeated_rows_and_a_very_long_text(spark):
    long = "word and other words 12\n" * 100_000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["fine text of some words here", "bad!!! $$$ bad"] * 15)] + [(50, long), (50, long), (None, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(30)] + [(50, 1)], "doc_id long, quality int")
    rows = quality.scored(docs, quality.learn(docs, labels)).collect()
    assert len(rows) == 34 and len({r.score for r in rows if r.doc_id == 50}) == 1 and len({r.score for r in rows if r.doc_id is None}) == 1
