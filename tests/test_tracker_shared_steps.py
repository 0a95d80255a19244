"""The tracker's rows meet once for both models, scenes are dealt to all cores, and blocks of reports find the same pairs as reports one by one."""

import numpy as np

from skylattice.functions import training
from skylattice.operators import staging, tracker
from skylattice.plans import catalogue


def joins(tables):
    return sum(t._jdf.queryExecution().optimizedPlan().toString().count("Join Inner, ") for t in tables)


def test_pairs_are_joined_once_and_scenes_dealt(spark, sf, monkeypatch):
    h = staging.staged(catalogue.scenes(spark, sf), "scenes")
    for module, work in ((training, lambda: training.fit_pairs(h)), (tracker, lambda: tracker.linked(h, tracker.HYBRID_RULES, None, None))):
        seen = []
        monkeypatch.setattr(module, "staged", lambda df, name, seen=seen: (seen.append(df), staging.staged(df, name))[1])
        out = work()
        assert joins(seen + ([out] if module is tracker else [])) == 1
    assert tracker.track_scenes(h, 3600.0).rdd.getNumPartitions() == staging.parts(spark)


def test_blocks_find_the_pairs_of_a_loop():
    made = np.random.default_rng(3)
    state = np.concatenate([made.uniform(-2e4, 2e4, (300, 3)), made.normal(0, 200, (300, 3))], axis=1)
    state[:4] = [[8000.0, 0, 0, 0, 0, 0], [7999.999, 0, 0, 0, 0, 0], [0, -8000.0, 0, 0, 0, 0], [0, 0, 0, 0, 0, 0]]
    tracks = [tracker.Track(i, float(made.uniform(0, 20)), s.tolist(), [1.0, 0.0, 1.0], 1) for i, s in enumerate(state)]
    reports = [{"t": float(t), "x": float(x), "y": float(y)} for t, x, y in made.uniform(0, 20, (2 * tracker.BLOCK + 7, 3)) * [1, 1000, 1000]] + [{"t": 0.0, "x": 0.0, "y": 0.0}]
    s, t0, want = np.array([t.s for t in tracks]), np.array([t.t for t in tracks]), []
    for j, m in enumerate(reports):
        p = s[:, :3] + s[:, 3:] * np.maximum(0.0, m["t"] - t0)[:, None]
        want += [(int(i), j, *p[i]) for i in np.flatnonzero(np.hypot(p[:, 0] - m["x"], p[:, 1] - m["y"]) < 8000.0)]
    i, j, p = tracker.pair_table(tracks, reports, 8000.0)
    assert [(int(a), int(b), *c) for a, b, c in zip(i, j, p)] == want and len(want) > 1000
