"""Queries whose windows grow with the input: the same results without making or visiting all pairs of a window."""

import itertools
import random
import re

import numpy as np

from skylattice.operators import assignment, pairs
from skylattice.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_counted_without_being_made(spark, sf):
    """equal and null ids, nulls in keys, empty input."""
    rng = random.Random(5)
    rows = [(rng.choice([0, 1, None]), rng.choice([*range(40), None]), rng.randrange(3)) for _ in range(150)]
    df = spark.createDataFrame(rows, "win long, seq long, track_id long")
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    pair = lambda *at: sum(a[1] < b[1] and all(a[i] == b[i] for i in at) for a in known for b in known)
    assert [r["n"] for r in pairs.pairs_within(df, "win").collect()] == [pair(0)]
    assert [r["n"] for r in pairs.pairs_within(df, "win", "track_id").collect()] == [pair(0, 2)]
    assert [r["n"] for r in pairs.pairs_within(df.limit(0), "win").collect()] == [0]
    assert not re.search(r"seq#\d+L? < seq#", plan(catalogue.pair_labels(spark, sf)))


def test_the_hourly_gate_joins_by_cells(spark, sf):
    """no join by the window alone."""
    assert "cx#" in plan(catalogue.pair_gate_hour(spark, sf))


def test_rounding_of_cells_parts_no_pair(spark):
    rows = spark.createDataFrame([(0, 1, 1999.9999999999998, 0.0), (0, 2, 3999.9999999999995, 0.0)], "win long, seq long, x double, y double")
    assert pairs.gated_by_grid(rows).count() == pairs.gated(rows).count() == 1


def scattered(spark, rng, n, windows=2):
    """Long and narrow, with copies, clumps and outliers."""
    place = lambda: rng.choice([(rng.uniform(0, 4e6), rng.uniform(0, 9e3), rng.uniform(0, 2e3)), (5.0, 5.0, 5.0), (rng.uniform(1000, 1010), rng.uniform(0, 5), 7.0), (rng.choice([-1e8, 1e9]), 3.0, rng.uniform(0, 1e7))])
    rows = [(rng.randrange(windows), i, *map(float, place())) for i in rng.sample(range(10 * n), n)]
    return rows, spark.createDataFrame(rows, "win long, seq long, x double, y double, z double")


def apart(a, b):
    dx, dy, dz = (a[i] - b[i] for i in (2, 3, 4))
    return (dx * dx + dy * dy + dz * dz) ** 0.5


def test_nearest_of_others_in_wide_gates(spark, monkeypatch):
    """a gate wider than the window does not make all pairs."""
    monkeypatch.setattr(pairs, "FEW", 20)
    monkeypatch.setattr(pairs, "ASKS", 50)
    rng = random.Random(11)
    a, left = scattered(spark, rng, 300, 3)
    b, right = scattered(spark, rng, 400)
    for gate in (1e12, 2000.0):
        want = set()
        for x in a:
            near = min(((d, y[1]) for y in b if y[0] == x[0] and (d := apart(x, y)) < gate), default=None)
            if near:
                want.add((x[0], x[1], near[1], round(near[0], 6)))
        got = {(r["win"], r["src"], r["dst"], round(r["d"], 6)) for r in pairs.nearest_of(left, right, gate).collect()}
        assert got == want
    assert pairs.nearest_of(left, right.limit(0), 1e9).isEmpty()


def test_nearest_by_leaves(spark, monkeypatch):
    """F10 to F14: leaves hold few rows, however the rows stand, and the edges are all pairs' k nearest."""
    monkeypatch.setattr(pairs, "FEW", 20)
    monkeypatch.setattr(pairs, "ASKS", 50)
    rows, df = scattered(spark, random.Random(12), 500)
    assert max(r["count"] for r in pairs.leaves(df, 3).groupBy("leaf").count().collect()) <= 20
    want = set()
    for x in rows:
        near = sorted((apart(x, y), y[1]) for y in rows if y[0] == x[0] and y[1] != x[1])
        want |= {(x[0], x[1], dst, round(d, 6)) for d, dst in near[:3]}
    assert {(r["win"], r["src"], r["dst"], round(r["d"], 6)) for r in pairs.nearest(df, 3).collect()} == want


def test_assignment_asks_for_few_rows():
    """most rows take their cheapest column without a search; the cost is that of all permutations."""
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 7)):
        cost = rng.integers(0, 9, (n, m)).astype(float)
        i, j = assignment.augmented(n, m, lambda k: cost[k])
        assert sorted(i) == list(range(n)) and len(set(j)) == n
        assert cost[i, j].sum() == min(sum(cost[k, p[k]] for k in range(n)) for p in itertools.permutations(range(m), n))
    asked = []
    x, y = rng.uniform(0, 1e6, 300), rng.uniform(0, 1e6, 450)
    i, j = assignment.augmented(300, 450, lambda k: asked.append(k) or np.abs(y - x[k]))
    assert len(asked) < 4 * 300


def test_rows_without_a_position_match_nothing(spark):
    rows = "frame long, id long, x double, y double, z double"
    pred = spark.createDataFrame([(0, 1, None, 0.0, 0.0), (0, 2, float("nan"), 0.0, 0.0), (0, 3, 5.0, 0.0, 0.0), (0, 4, 900.0, 0.0, 0.0)], rows)
    truth = spark.createDataFrame([(0, 7, 6.0, 0.0, 0.0), (0, 8, 901.0, None, 0.0), (0, 9, 902.0, 0.0, 0.0)], rows)
    got = assignment.match_frames(pred, truth).collect()
    assert sorted((r["pred_id"], r["gt_id"], r["dist"]) for r in got) == [(3, 7, 1.0), (4, 9, 2.0)]


def test_the_gate_of_assignment_joins_by_cells(spark, sf, monkeypatch):
    """F16: no join by the frame alone."""
    seen = []
    monkeypatch.setattr(assignment, "assign_within_gate", lambda edges: seen.append(edges) or edges)
    catalogue.gate_assignment(spark, sf)
    assert "cx#" in plan(seen[0])


def test_small_rows_that_take_long_use_all_cores(spark):
    """F2 to F6, F10 to F14: frames and leaves are not joined into a few tasks by their bytes."""
    rows = spark.createDataFrame([(f, i, float(i), 0.0, 0.0) for f in range(40) for i in range(3)], "frame long, id long, x double, y double, z double")
    assert assignment.match_frames(rows, rows).rdd.getNumPartitions() >= 16
