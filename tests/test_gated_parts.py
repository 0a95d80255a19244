"""F6 gate_assignment: parts are found in the tasks and solved one after the other, not as a group of its own each."""

import random

import numpy as np
import pandas as pd
import pytest

from skylattice.operators import assignment


def crowd(seed, frames=5, n=60):
    rng = random.Random(seed)
    return sorted({(f, rng.randrange(n), rng.randrange(n)) for f in range(frames) for _ in range(n // (1 + f % 2))})


def test_parts_that_span_batches(spark):
    rng = np.random.default_rng(6)
    # Frame 0 is one large part, frame 7 has only single edges.
    edges = [(f, a, b, float(rng.random() * 1.2)) for f, a, b in crowd(1)] + [(0, a, a + d, float(rng.random() * 0.9)) for a in range(60) for d in (0, 1)] + [(7, a, -a, 0.5) for a in range(30)]
    edges = list({e[:3]: e for e in edges}.values())
    df = spark.createDataFrame(edges, "frame long, a long, b long, cost double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        done = assignment.assign_within_gate(df)
        got = done.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for f in {e[0] for e in edges}:
        cost, own = np.ones((61, 62)), lambda x: abs(x)
        for frame, a, b, c in edges:
            if frame == f:
                cost[own(a), own(b)] = min(c, 1.0)
        i, j = assignment.hungarian(cost)
        mine = [r for r in got if r.frame == f]
        assert sum(r.cost - 1 for r in mine) == pytest.approx((cost[i, j] - 1).sum())
        assert len({r.a for r in mine}) == len(mine) == len({r.b for r in mine})
    assert "FlatMapGroups" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert assignment.assign_within_gate(df.limit(0)).collect() == []


@pytest.mark.parametrize("together", [200_000, 5])
def test_stars_join_what_edges_join(monkeypatch, together):
    """Whole frames are joined to their parts at once; pieces of a frame join the same vertices together."""
    monkeypatch.setattr(assignment, "TOGETHER", together)
    edges = pd.DataFrame(crowd(2), columns=["frame", "a", "b"])
    found = pd.concat(assignment.stars(iter([edges.iloc[i : i + 4] for i in range(0, len(edges), 4)])))

    def parts(pairs):
        label = {}
        for u, v in pairs:
            one, other = label.setdefault(u, {u}), label.setdefault(v, {v})
            if one is not other:
                one |= other
                label.update(dict.fromkeys(other, one))
        return {frozenset(x) for x in label.values()}

    want = parts(((f, 0, a), (f, 1, b)) for f, a, b in edges.itertuples(index=False))
    assert parts(((f, side, i), (f, 0, root)) for f, side, i, root in found.itertuples(index=False)) == want
    if together > len(edges):
        assert all(min(x) == (f, 0, root) for f, side, i, root in found.itertuples(index=False) for x in want if (f, side, i) in x)
