"""Scans of pieces against plain folds, nearest neighbours against brute force, calibration and truth edges, splits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.operators import kalman, pairs, scan, truth, windows


def test_ema_of_a_track_with_a_million_rows(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("track_id"), F.col("id").alias("t_us"), F.col("id").alias("seq"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(2, 5, 0, 3.0)], rows.schema))
    got = {r.track_id: (r.n, r.ema) for r in scan.ema(rows, "v").collect()}
    v, want = np.arange(n) * 7919 % 1000, None
    for x in v[-3000:]:
        want = float(x) if want is None else 0.95 * want + 0.05 * float(x)
    assert got[1][0] == n and got[1][1] == pytest.approx(want, abs=1e-9) and got[2] == (1, 3.0)


def tracks(rng, lengths):
    rows = []
    for track, n in enumerate(lengths):
        t = 0.0
        for seq in range(n):
            t += rng.choice([0.0, 0.5, 4.0, 30.0])
            v = (0.0, 0.0) if rng.random() < 0.4 else (rng.uniform(-200, 200), rng.uniform(-200, 200))
            rows.append((track, seq, int(t * 1e6), t, rng.uniform(-9e3, 9e3), rng.uniform(-9e3, 9e3), v[0] or None, v[1]))
    return rows


SCHEMA = "track_id long, seq long, t_us long, t double, x double, y double, vx double, vy double"


@pytest.mark.parametrize("bits", [0, 1, 4])
def test_pieces_of_any_size_give_the_fold(spark, bits):
    """Kalman filter and smoother, cut into pieces of 1, 2 and 16 rows, against plain loops."""
    rng = random.Random(bits)
    rows = tracks(rng, [1, 2, 3, 17, 60])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    q, r, p_pos, p_vel = 2500.0, 22500.0, 1e6, 250000.0
    want, smooth = {}, {}
    for track in range(5):
        own = [x for x in rows if x[0] == track]
        m0 = own[0]
        x, p = np.array([[m0[4], m0[6] or 0.0], [m0[5], m0[7]]]), np.diag([p_pos, p_vel])
        s = [m0[4], m0[5], 0.0, 0.0]
        for a, b in zip(own, own[1:]):
            f = np.array([[1, b[3] - a[3]], [0, 1]])
            x, p = x @ f.T, f @ p @ f.T + q * np.eye(2)
            h = np.eye(2) if (b[6] or b[7]) else np.eye(2)[:1]
            gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + r * np.eye(len(h)))
            z = np.array([[b[4], b[6] or 0.0], [b[5], b[7]]])[:, : len(h)]
            x, p = x + (z - x @ h.T) @ gain.T, (np.eye(2) - gain @ h) @ p
            s = [s[0] * 0.3 + b[4] * 0.7, s[1] * 0.3 + b[5] * 0.7, (b[4] - s[0]) * 0.2, (b[5] - s[1]) * 0.2]
        want[track], smooth[track] = [x[0, 0], x[1, 0], x[0, 1], x[1, 1], p[0, 0]], s
    for row in scan.kalman(df, p_pos, p_vel, q, r, bits=bits).collect():
        assert [row.x, row.y, row.vx, row.vy, row.p_pos] == pytest.approx(want[row.track_id], rel=1e-9, abs=1e-6)
    for row in scan.smoothed(df, bits=bits).collect():
        assert list(row.s) == pytest.approx(smooth[row.track_id], abs=1e-9)


def test_scan_holds_no_track_in_one_row(spark):
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("track_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("t"), F.rand(1).alias("x"), F.rand(2).alias("y"), F.lit(None).cast("double").alias("vx"), F.lit(1.0).alias("vy"))
    cut = scan.pieces(rows, "track_id", ["t", "seq"], F.col("x"), bits=8)
    assert cut.agg(F.max(F.size("m"))).first()[0] <= 256 and cut.count() >= 20
    assert kalman.fold(rows).first().n == 5000


def brute_nearest(rows, src, k):
    me = rows[src]
    others = [(float(np.sqrt((me[2] - o[2]) ** 2 + (me[3] - o[3]) ** 2 + (me[4] - o[4]) ** 2)), o[1]) for o in rows if o[0] == me[0] and o[1] != me[1]]
    return sorted(others)[:k]


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_against_brute_force(spark, k, monkeypatch):
    """Even and crowded windows, many rows in one place, a window of one row, fewer rows than k, far outliers, ties."""
    monkeypatch.setattr(pairs, "FEW", 30)
    rng = random.Random(k)
    rows = [(0, i, rng.uniform(-1e4, 1e4), rng.uniform(-1e4, 1e4), rng.uniform(0, 900)) for i in range(900)]
    rows += [(1, 1000 + i, 5.0, 5.0, 1.0) for i in range(120)] + [(1, 1200 + i, rng.gauss(0, 3), rng.gauss(0, 3), 0.0) for i in range(150)] + [(1, 1400, 1e6, -1e6, 0.0)]
    rows += [(2, 2000, 1.0, 1.0, 1.0), (3, 2001, 0.0, 0.0, 0.0), (3, 2002, 3.0, 0.0, 0.0)] + [(4, 3000 + 10 * a + b, float(a), float(b), 0.0) for a in range(8) for b in range(8)]
    df = spark.createDataFrame(rows + [(0, 9999, None, 1.0, 1.0)], "win long, seq long, x double, y double, z double")
    got = {}
    for r in pairs.nearest(df, k).collect():
        got.setdefault(r.src, []).append((r.d, r.dst))
    for i in [*range(0, 900, 9), *range(900, len(rows))]:
        assert [(pytest.approx(d, abs=1e-9), s) for d, s in brute_nearest(rows, i, k)] == sorted(got.get(rows[i][1], [])), rows[i]


def test_nearest_in_a_large_window_makes_few_pairs(spark):
    """A window of 60,000 rows, a third of them in a small corner: some hundred pairs a row at most, not all of them."""
    df = spark.range(60_000).select(F.lit(1).cast("long").alias("win"), F.col("id").alias("seq"), *[(F.rand(s) * F.when(F.col("id") % 3 == 0, 3000.0).otherwise(1e5)).alias(c) for s, c in ((1, "x"), (2, "y"))], F.lit(0.0).alias("z"))
    got = pairs.nearest(df, 3)
    assert got.count() == 180_000 and got.select("src").distinct().count() == 60_000


def test_truth_states_at_duplicates_bounds_and_allowed_ids(spark):
    rows = [(1, 10, 0, 1.0, 0.0, 0.0, 1.0, 0.0), (1, 20, 1, 3.0, 0.0, 0.0, 3.0, 0.0), (1, 20, 2, 9.0, 0.0, 0.0, 9.0, 0.0), (1, 40, 3, 5.0, 0.0, 0.0, 5.0, 0.0), (2, 15, 4, 7.0, 0.0, 0.0, 0.0, 0.0), (3, 30, 5, 8.0, 1.0, 2.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "track_id long, t_us long, seq long, x double, y double, z double, vx double, vy double")
    got = sorted((r.track_id, r.tick, r.x, r.vx) for r in truth.states_at(df, 10).collect())
    # At 20 the first of two samples; after it from the second one.
    assert got == [(1, 1, 1.0, 1.0), (1, 2, 3.0, 3.0), (1, 3, 7.0, 7.0), (1, 4, 5.0, 5.0), (3, 3, 8.0, 0.0)]
    assert {r.track_id for r in truth.states_at(df, 10, spark.createDataFrame([(3,), (3,), (None,)], "track_id long")).collect()} == {3}


def test_origin_without_positions_is_the_default(spark):
    schema = "t_us long, seq long, track_id long, source_lat double, source_lon double, x double, y double"
    for rows in ([], [(1, 1, -1, 1.0, 1.0, 0.0, 0.0), (2, 2, 5, None, None, 0.0, 0.0)]):
        o = truth.calibrated_origin(spark.createDataFrame(rows, schema)).first()
        assert (o.n, o.origin_lat, o.origin_lon) == (0, 24.4539, 54.3773)


@pytest.mark.parametrize("n", [0, 1, 3, 10, 1000])
def test_split_by_time_ranks_only_the_days_of_the_bounds(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([0, 1, 1, 1, 5]) * 86_400_000_000 + rng.randrange(3_000_000) * 1000, i) for i in range(n)]
    got = {r.seq: r.part for r in windows.split_by_time(spark.createDataFrame(rows, "t_us long, seq long"), (70, 85)).collect()}
    order = [s for _, s in sorted(rows)]
    assert got == {s: "train" if i < n * 70 // 100 else "val" if i < n * 85 // 100 else "test" for i, s in enumerate(order)}
