"""Whitening against a dense eigensolver, FEAST on hard spectra, edge cases."""

import math

import numpy as np
import pytest

from skylattice.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string"


def by_hand(rows, k=4):
    """(vec_id, component, n, deviation, |whitened|, explained), sorted."""
    x = [(i, [math.floor(256 * float(c)) for c in np.array(v, np.float32)]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in {len(v) for _, v in x} - {0}:
        fit = sorted({tuple(v) for _, v in x if len(v) == d})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        y = (np.array(fit, dtype=object) * n - np.array(sums, dtype=object)).astype(float) / n
        values, vectors = np.linalg.eigh(y.T @ y / n)
        for i, v in x:
            if len(v) == d:
                off = [n * c - s for c, s in zip(v, sums)]
                for c in range(min(k, d)):
                    e = values[-1 - c]
                    if e > values.sum() * 1e-13:
                        out.append((i, c + 1, n, sum(o * o for o in off), abs(np.array(off, float) / n @ vectors[:, -1 - c]) / math.sqrt(e), e / values.sum()))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def check(spark, rows):
    frame = spark.createDataFrame([(i, v, 1, None, "x") for i, v in rows], SCHEMA)
    got = sorted(map(tuple, whitening.whiten(frame).collect()), key=lambda r: (r[0] is not None, r))
    want = by_hand(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert abs(g[4]) == pytest.approx(w[4], abs=1e-8) and g[5] == pytest.approx(w[5], rel=1e-9) and 0 <= g[6] < 1e-8
    return got


def test_against_dense_solver(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 12)) * np.linspace(1, 3, 12) + 7
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    got = check(spark, rows + rows[:40])
    assert len(got) == 340 * 4
    # Orthogonal, centred and of unit variance over the fit list.
    w = {(i, c): v for i, c, _, _, v, *_ in got}
    table = np.array([[w[i, c] for c in range(1, 5)] for i in range(300)])
    assert np.abs(np.cov(table.T, bias=True) - np.eye(4)).max() < 1e-9


def test_nulls_lengths_and_few_vectors(spark):
    rows = [(1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (None, [1.0, 2.0]), (7, [1.5, -2.0]), (7, [1.5, -2.0]), (8, [0.25, 9.0]), (9, [3.0]), (10, [4.0]), (11, [1.0, 2.0, 3.0]), (12, [-0.0, -0.001])]
    got = check(spark, rows)
    assert {r[0] for r in got} == {None, 7, 8, 9, 10, 12}


def test_huge_values(spark):
    rows = [(1, [1e30, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])]
    frame = spark.createDataFrame([(i, v, 1, None, "x") for i, v in rows], SCHEMA)
    # 2^63 - 1 and -2^63 are what the first two become, -1 is their sum.
    assert {(r["vec_id"], r["deviation"]) for r in whitening.whiten(frame).collect()} == {(1, None), (2, None), (3, 1 + (3 * 5 - 8) ** 2 * 256**2)}


def test_exact_deviations_of_middle_range():
    rng = np.random.default_rng(1)
    for high in (2**10, 2**24, 2**34, 2**45):
        x = rng.integers(-high, high, (20, 64))
        fit = whitening.Fit(1000, x.sum(0).tolist(), None, None, 1.0)
        want = [sum((1000 * int(v) - s) ** 2 for v, s in zip(row, fit.sums)) for row in x]
        assert whitening.centred(x, fit)[1] == [w if w < 2**63 else None for w in want]


def test_empty(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("spectrum", [[9, 5, 3, 2, 1, 0.5], [4, 4, 4, 4, 4, 4, 1], [7, 7 - 1e-7, 7 - 2e-7, 3, 3, 3 - 1e-9, 2], [1, 1e-6, 1e-9, 1e-12, 0, 0], [5, 0, 0, 0], [2], list(np.linspace(1, 1.01, 40)), [1e9, 1e3, 1, 0.1, 0.01]])
def test_feast_on_hard_spectra(spectrum):
    rng = np.random.default_rng(len(spectrum))
    q = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
    a = q * spectrum @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.leading(a, 4)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:4]
    kept = want[want > 4 * len(a) * 2.3e-16 * np.trace(a)]
    assert len(values) == len(kept) and np.allclose(values, kept, rtol=1e-9, atol=1e-13 * max(spectrum))
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-10
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max(initial=0) < 1e-11 * max(spectrum)


def test_inertia_counts():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 20))
    a += a.T
    np.fill_diagonal(a, 0)  # needs pivots of two rows
    for shift in (-3.0, 0.0, 1.5):
        assert whitening.above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
