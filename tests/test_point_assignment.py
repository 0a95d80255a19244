"""F2 to F5: the assignment of a frame's points looks at neighbours, and has the cost of the one over all pairs."""

import numpy as np
import pytest

from skylattice.operators import assignment


def apart(x, y):
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))


@pytest.mark.parametrize("n, m", [(1, 1), (1, 6), (2, 200), (40, 41), (150, 150), (300, 340)])
@pytest.mark.parametrize("spread", [(1e6, 10, 10), (10, 1e4, 10), (10, 10, 10), (0, 0, 0)])
def test_points_are_assigned_as_over_all_pairs(n, m, spread):
    rng = np.random.default_rng(n + m)
    for places in (lambda k: rng.normal(size=(k, 3)) * spread, lambda k: np.round(rng.normal(size=(k, 3)) * 2) * spread, lambda k: np.where(rng.random((k, 1)) < 0.5, 7.0, rng.random((k, 3)) * spread)):
        x, y = places(n), places(m)
        cost = apart(x, y)
        i, j = assignment.hungarian(cost)
        got = assignment.closest(x, y)
        assert len(set(got.tolist())) == n
        assert cost[np.arange(n), got].sum() == pytest.approx(cost[i, j].sum(), rel=1e-9, abs=1e-9)
    assert (assignment.closest(x * 1e300, y * 1e300) >= 0).all()


def test_few_distances_are_asked_for(monkeypatch):
    """A frame that is spread along a line: a quarter of those that rows of all distances have, at most."""
    rng = np.random.default_rng(2)
    x, y = (rng.random((k, 3)) * (7.5e6, 9e3, 2e3) for k in (600, 700))
    rows, asked, cost = [], [], apart(x, y)
    i, j = assignment.augmented(600, 700, lambda k: rows.append(k) or cost[k])

    class Counted:
        def __getattr__(self, name):
            return getattr(np, name)

        def sqrt(self, values, **more):
            asked.append(values.size)
            return np.sqrt(values, **more)

    monkeypatch.setattr(assignment, "np", Counted())
    got = assignment.closest(x, y)
    assert cost[np.arange(600), got].sum() == pytest.approx(cost[i, j].sum())
    assert 4 * sum(asked) < 700 * len(rows)


def test_infinite_positions_match_nothing(spark):
    rows = "frame long, id long, x double, y double, z double"
    pred = spark.createDataFrame([(0, 1, float("inf"), 0.0, 0.0), (0, 3, 5.0, 0.0, 0.0)], rows)
    truth = spark.createDataFrame([(0, 7, 6.0, 0.0, 0.0), (0, 8, 9.0, 0.0, float("-inf"))], rows)
    assert [(r["pred_id"], r["gt_id"], r["dist"]) for r in assignment.match_frames(pred, truth).collect()] == [(3, 7, 1.0)]
