"""Operators that SQL cannot repeat, against brute force and stated values."""

import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skylattice.functions import perceptron, training
from skylattice.operators import assignment, kalman, metrics, pairs, tracker, windows
from skylattice.plans import catalogue
from skylattice.sources import streams
from skylattice.streaming import tracks


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.integers(0, 10_000))
def test_hungarian_against_permutations(n, m, seed):
    cost = np.random.default_rng(seed).random((n, m)).round(2)
    rows, cols = assignment.hungarian(cost)
    assert len(rows) == min(n, m) and len(set(cols)) == len(cols)
    a = cost if n <= m else cost.T
    best = min(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(a.shape[1]), len(a)))
    assert cost[rows, cols].sum() == pytest.approx(best)


def frame(spark, rows):
    return spark.createDataFrame(rows, "frame long, id long, x double, y double, z double")


def test_metrics_of_one_match(spark):
    p, g = frame(spark, [(0, 1, 10.0, 20.0, 0.0)]), frame(spark, [(0, 7, 11.0, 21.0, 0.0)])
    m = assignment.match_frames(p, g, 100.0)
    (row,) = metrics.summary(assignment.frame_counts(p, g, m)).collect()
    assert (row.mota, row.total_matches, row.motp) == (1.0, 1, round(2**0.5, 6))


def test_trackers_by_name_and_formatted_metrics(spark):
    assert tracker.rules_of("sort") is not None and tracker.rules_of("legacy").max_age == 5 and tracker.rules_of("hybrid", cap=7).cap == 7
    with pytest.raises(ValueError, match="no tracker"):
        tracker.rules_of("kalmann")
    life = tracker.Tracker(tracker.LEGACY_RULES)
    report = tracker.as_report({"t": 0.5, "x": 0.0, "y": 0.0, "z": 0.0, "vx": None, "vy": None, "vz": None, "mode_3a": None, "mode_s": None, "size": 5})
    assert [t.track_id for t in life.step([report], 1.0)] == [0]  # confirmed at birth by its cluster
    assert [len(life.step([], 2.0 + i)) for i in range(6)] == [1, 1, 1, 1, 1, 0]  # of age 5 it still lives
    life.step([report], 9.0)
    life.reset()
    assert life.tracks == [] and life.next_id == 2
    p, g = frame(spark, [(0, 1, 10.0, 20.0, 0.0), (1, 2, 0.0, 0.0, 0.0)]), frame(spark, [(0, 7, 13.0, 24.0, 0.0)])
    line = metrics.formatted(metrics.summary(assignment.frame_counts(p, g, assignment.match_frames(p, g, 100.0)))).first().text
    assert line == "MOTA: 0.000 | MOTP: 5.0 | Precision: 0.500 | Recall: 1.000 | F1: 0.667 | ID_SW: 0 | FP/frame: 0.5 | FN/frame: 0.0"


def test_assignment_comes_before_the_gate(spark):
    p = frame(spark, [(0, 1, 0.0, 0.0, 0.0), (0, 2, 90.0, 0.0, 0.0)])
    g = frame(spark, [(0, 1, 80.0, 0.0, 0.0), (0, 2, 201.0, 0.0, 0.0)])
    assert {(r.pred_id, r.gt_id) for r in assignment.match_frames(p, g, 100.0).collect()} == {(1, 1)}


def test_published_counters(spark):
    rows = [(0, 268, 1010, 632, 268 * 354.75)] + [(i, 0, 0, 0, 0.0) for i in range(1, 45)]
    (r,) = metrics.summary(spark.createDataFrame(rows, "frame long, matches long, fp long, fn long, dist_sum double")).collect()
    assert (r.mota, r.precision, r.recall, r.f1) == (-0.824444, 0.209703, 0.297778, 0.246097) and r.motp == 354.75 and r.fp_rate == pytest.approx(22.444444)
    (none,) = metrics.summary(spark.createDataFrame([], "frame long, matches long, fp long, fn long, dist_sum double")).collect()
    assert none.mota == none.motp == 0.0
    (idle,) = metrics.summary(spark.createDataFrame([(0, 0, 2, 3, 0.0)], "frame long, matches long, fp long, fn long, dist_sum double")).collect()
    assert idle.motp == 15000.0


def test_match_counters_add_up(spark, sf):
    pred, gt, m = catalogue.matching(spark, sf)
    c = assignment.frame_counts(pred, gt, m).agg(F.sum("matches").alias("m"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("n_gt").alias("g"), F.sum("n_pred").alias("p")).first()
    assert c.m + c.fn == c.g and c.m + c.fp == c.p and c.m == m.count() > 0


def matrix_filter(rows, n):
    f = lambda dt: np.array([[1, 0, dt, 0], [0, 1, 0, dt], [0, 0, 1, 0], [0, 0, 0, 1]], float)
    x, p, t = np.array(rows[0][1:], float), np.diag([n.p_pos, n.p_pos, n.p_vel, n.p_vel]), rows[0][0]
    for t1, *m in rows[1:]:
        a = f(t1 - t)
        x, p, t = a @ x, a @ p @ a.T + n.q * np.eye(4), t1
        h = np.eye(4) if m[2] or m[3] else np.eye(4)[:2]
        k = p @ h.T @ np.linalg.inv(h @ p @ h.T + n.r * np.eye(len(h)))
        x, p = x + k @ (np.array(m[: len(h)]) - h @ x), (np.eye(4) - k @ h) @ p
    return x


@pytest.mark.parametrize("noise", [kalman.HYBRID, kalman.SORT])
def test_kalman_fold_against_matrices(spark, noise):
    rng = random.Random(3)
    tracks_ = {i: sorted((rng.uniform(0, 60), rng.uniform(-9e3, 9e3), rng.uniform(-9e3, 9e3), *((0.0, 0.0) if rng.random() < 0.4 else (rng.uniform(-200, 200), rng.uniform(-200, 200)))) for _ in range(rng.randrange(1, 12))) for i in range(8)}
    rows = [(i, j, *m) for i, t in tracks_.items() for j, m in enumerate(t)]
    got = kalman.fold(spark.createDataFrame(rows, "track_id long, seq long, t double, x double, y double, vx double, vy double"), noise).collect()
    for r in got:
        assert [r.x, r.y, r.vx, r.vy] == pytest.approx(matrix_filter(tracks_[r.track_id], noise), abs=2e-3)


def test_grid_equals_plain_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(3), i, rng.uniform(-6000, 6000), rng.choice([0.0, 2000.0, -2000.0, rng.uniform(-6000, 6000)])) for i in range(300)]
    df = spark.createDataFrame(rows, "win long, seq long, x double, y double")
    key = lambda p: sorted(p.select(F.col("a.seq"), F.col("b.seq")).collect())
    assert key(pairs.gated(df)) == key(pairs.gated_by_grid(df)) != []


def test_components_do_not_depend_on_order(spark):
    rows = [(0, i) for i in range(12)]
    edges = [(0, 5, 9), (0, 9, 2), (0, 3, 4), (0, 7, 8), (0, 8, 3)]
    df = spark.createDataFrame(rows, "win long, seq long")
    want = {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 2, 6: 6, 7: 3, 8: 3, 9: 2, 10: 10, 11: 11}
    for order in (edges, edges[::-1]):
        assert {r.seq: r.cluster for r in pairs.window_components(df, spark.createDataFrame(order, "win long, src long, dst long")).collect()} == want


def test_windows_include_empty_ones(spark):
    df = spark.createDataFrame([(10, 1, 0.0, 0.0), (10, 1, 2.0, 0.0), (39, -1, 5.0, 0.0), (40, 2, 1.0, 1.0)], "t_us long, track_id long, x double, y double")
    assert [tuple(r) for r in windows.tumbling_summary(df, 10).orderBy("win").collect()] == [(0, 2, 1, 1.0, 0.0), (1, 0, 0, None, None), (2, 1, 0, 5.0, 0.0), (3, 1, 1, 1.0, 1.0)]


def meas_row(t, x, **more):
    return {"t": t, "x": x, "y": 0.0, "z": 0.0, "vx": 0.0, "vy": 0.0, "vz": 0.0, "amplitude": None, "meas_type": "PSR", "mode_3a": None, "mode_s": None, "seq": 0} | more


def test_track_life():
    life = tracker.Tracker()
    step = lambda rows, end: life.step(tracker.clustered_here(rows, life.rules, life.models), end)
    assert step([meas_row(0.5, 0.0)], 1.0) == []
    assert step([meas_row(1.5, 10.0)], 2.0) == []
    (confirmed,) = step([meas_row(2.5, 20.0)], 3.0)
    assert (confirmed.track_id, confirmed.hits, confirmed.age) == (0, 3, 0)
    for i in range(9):
        assert [t.age for t in step([], 4.0 + i)] == [i + 1]
    assert step([], 13.0) == [] and life.tracks == []
    assert [t.track_id for t in step([meas_row(20.0, 0.0, seq=i) for i in range(3)], 21.0)] == [1]  # a cluster of three confirms at birth
    assert len(step([meas_row(21.2, 0.0, mode_s="a"), meas_row(21.3, 50.0, mode_s="b")], 22.0)) == 1 and len(life.tracks) == 2


def fitted_models(spark, sf):
    h = catalogue.scenes(spark, sf)
    return h, [f and f.weights for f in training.fit_pairs(h)]


def test_clusters_in_a_task_equal_those_of_spark(spark, sf):
    h, (psr, ssr) = fitted_models(spark, sf)
    h = h.where("scene < 30")
    for models in ((None, None), (psr, ssr)):
        want = sorted((r.scene, r.win, r.first, r.size, round(r.x, 6), round(r.z, 6), round(r.vx or 0.0, 6), r.mode_3a, r.mode_s) for r in tracker.fused_reports(h, psr=models[0], ssr=models[1]).collect())
        got, by_window = [], {}
        for r in tracker.with_defaults(h).collect():
            by_window.setdefault((r.scene, r.win), []).append(r.asDict())
        for (scene, win), rows in by_window.items():
            rows.sort(key=lambda r: r["seq"])
            got += [(scene, win, m["size"], round(m["x"], 6), round(m["z"], 6), round(m["vx"], 6), m["mode_3a"], m["mode_s"]) for m in tracker.clustered_here(rows, tracker.HYBRID_RULES, tracker.Classifiers.of(*models))]
        assert sorted(map(repr, got)) == sorted(repr(w[:2] + w[3:]) for w in want) and any(w[3] > 1 for w in want)


def test_batch_equals_stream(spark, sf, tmp_path):
    """Every window is cut over three micro-batches, rows out of order within the watermark; the query is stopped and restarted from its
    checkpoint; a far row of its own scene moves the watermark past the last window."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    h, (psr, ssr) = fitted_models(spark, sf)
    rows = h.where("scene < 10").select("scene", "win", "seq", "t", "x", "y", "z", "vx", "vy", "amplitude", "meas_type", "mode_3a", "mode_s")
    # Ten days later: Spark takes a row at the epoch itself as late.
    rows = rows.withColumns({"t": F.col("t") + 864_000, "win": F.col("win") + 240}).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    want = sorted(map(repr, tracker.track_scenes(rows, 3600.0, psr=psr, ssr=ssr).collect()))
    span = 48 * 3600.0  # lateness of the whole test: any order is within it
    batches = [rows.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == i) for i in range(3)]
    end = spark.createDataFrame([(99, 0, -1, 1e7, 0.0, 0.0, 0.0, 0.0, 0.0, 50.0, "PSR", None, None)], rows.drop("ts").schema).withColumn("ts", F.timestamp_micros(F.lit(10**13)))
    out = []
    for i, part in enumerate([*batches, end, end.withColumn("seq", F.lit(-2).cast("long"))]):
        part.orderBy(F.xxhash64("seq")).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        if i in (1, 3, 4):  # a start of the query for the first two files, and one for each group after them
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
            q = tracks.track_stream(stream, 3600.0, f"{int(span)} seconds", psr=psr, ssr=ssr).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None
            out.append(spark.read.schema(tracker.TRACKS).parquet(str(tmp_path / "out")).where("scene <> 99"))
    got = sorted(map(repr, out[-1].collect()))
    assert got == want and len(want) > 20


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 7), st.integers(1, 7), st.integers(0, 100_000))
def test_sparse_assignment_costs_what_the_dense_one_costs(n, m, seed):
    rng = np.random.default_rng(seed)
    cost = np.where(rng.random((n, m)) < 0.5, rng.random((n, m)).round(2), 1.0)
    a, b = np.nonzero(cost < 1)
    keep = assignment.sparse_assignment(a, b, cost[a, b])
    assert len(set(a[keep])) == len(keep) == len(set(b[keep]))
    i, j = assignment.hungarian(cost)
    assert (cost[a, b][keep] - 1).sum() == pytest.approx((cost[i, j] - 1).sum())


def test_assignment_by_connected_parts(spark):
    rng = np.random.default_rng(4)
    edges = [(f, int(a), int(b), float(rng.random() * 1.3)) for f in range(6) for a in range(12) for b in rng.choice(14, 3, replace=False)] + [(9, 1, 1, None), (9, 2, 2, float("nan"))]
    got = assignment.assign_within_gate(spark.createDataFrame(edges, "frame long, a long, b long, cost double")).collect()
    for f in range(6):
        cost = np.ones((12, 14))
        for frame_, a, b, c in edges:
            if frame_ == f:
                cost[a, b] = min(c, 1.0)
        i, j = assignment.hungarian(cost)
        mine = [r for r in got if r.frame == f]
        assert sum(r.cost - 1 for r in mine) == pytest.approx((cost[i, j] - 1).sum()) and len({r.a for r in mine}) == len(mine) == len({r.b for r in mine})
    assert {r.frame for r in got} == set(range(6))


def test_frames_need_no_matrix(spark):
    rng = np.random.default_rng(8)
    p, g = ([(0, i, *(float(v) for v in x)) for i, x in enumerate(rng.random((n, 3)) * 100)] for n in (60, 90))
    for few, many in ((p, g), (g, p)):
        got = {(r.pred_id, r.gt_id) for r in assignment.match_frames(frame(spark, few), frame(spark, many), 30.0).collect()}
        d = np.linalg.norm(np.array([x[2:] for x in few])[:, None] - np.array([x[2:] for x in many])[None], axis=2)
        i, j = assignment.hungarian(d)
        assert got == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if d[a, b] < 30}
    assert assignment.match_frames(frame(spark, p), frame(spark, [])).count() == 0


def test_switches_pass_over_frames_that_are_not_scored(spark):
    rng = random.Random(2)
    scored = sorted(rng.sample(range(-70_000, 140_000), 300))
    matches = [(f, g, rng.randrange(3)) for f in scored for g in range(4) if rng.random() < 0.7]
    want, held = set(), {}
    for f in scored:
        now = {g: p for x, g, p in matches if x == f}
        want |= {(f, g, p, held[g]) for g, p in now.items() if g in held and held[g] != p}
        held = now
    got = metrics.stateful_switches(spark.createDataFrame(matches, "frame long, gt_id long, pred_id long"), spark.createDataFrame([(f,) for f in scored], "frame long"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_classifiers_are_fitted_and_saved(spark, sf, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("y", (F.col("a") - 2 * F.col("b") > 1.5).cast("int"))
    fitted = training.fit(df, [F.col("a"), F.col("b")], F.col("y"), F.col("id"))
    assert fitted.f1 > 0.9 and fitted.n_train + fitted.n_held_out == 1500 and fitted.steps in training.STEPS
    perceptron.save(fitted.weights, str(tmp_path / "model"))
    back = perceptron.load(spark, str(tmp_path / "model"))
    score = lambda w: [r.p for r in df.orderBy("id").select(perceptron.probability([F.col("a"), F.col("b")], w).alias("p")).limit(50).collect()]
    assert score(back) == score(fitted.weights)
    assert training.fit(df.where("y = 1"), [F.col("a")], F.col("y"), F.col("id")) is None
    h = catalogue.scenes(spark, sf)
    _, ssr = training.fit_pairs(h)
    clutter = training.fit_clutter(h)
    assert ssr.f1 > 0 and clutter.f1 > 0.5


def test_watermarked_counts(spark, sf, tmp_path):
    m = catalogue.meas(spark, sf).withColumn("ts", F.timestamp_micros("t_us")).select("ts", "meas_type", "x")
    m.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "in"))
    q = tracks.windowed_counts(stream, "1 day", "1 hour").writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("n")).first()[0] == m.count()


def test_sources(spark, tmp_path):
    lines = [{"t": 2.0, "radar_id": 1, "meas_type": "SSR", "x": 1.0, "mode3a": "1200", "track_id": 4}, {"timestamp": 1.0, "sensor_id": 3, "type": "plot", "x": 2.0, "y": 0.5}]
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)))
    got = {r.t: r for r in streams.read_stream(spark, str(path)).collect()}
    assert (got[2.0].mode_3a, got[2.0].radar_id, got[1.0].meas_type, got[1.0].radar_id, got[1.0].track_id) == ("1200", 1, "PSR", 3, -1)
    assert streams.is_stream(spark, str(path)) is True
    path.write_text(path.read_text() + "\n{broken")
    assert streams.read_stream(spark, str(path), strict=False).count() == 2
    with pytest.raises(Exception):
        streams.read_stream(spark, str(path)).collect()
    frames = tmp_path / "f.jsonl"
    frames.write_text(json.dumps({"timestamp": 3.0, "measurements": [{"sensor_id": 0, "x": 1.5, "track_id": 2}], "gt_tracks": [{"id": 2, "x": 1.0}]}))
    m, g = streams.explode_frames(streams.read_frames(spark, str(frames)))
    assert (m.first().x, m.first().frame_t, g.first().id) == (1.5, 3.0, 2) and streams.is_stream(spark, str(frames)) is False
    raw = tmp_path / "c.txt"
    raw.write_text("\n".join(["{'category': 62, 'track_number': 5, 'time': 1.0, 'lat': 1.0, 'lon': 2.0, 'x': 3.0, 'y': 4.0, 'vx': None, 'vy': 0.0, 'mode3a': '7000'}", "", "nonsense(", "{'category': 48}"]))
    cat = streams.read_cat62(spark, str(raw))
    assert [(r.track_number, r.mode3a, r.vx) for r in cat.collect()] == [(5, "7000", None)]
    (tmp_path / "ids.json").write_text("[3, 1, 2]")
    ids = streams.read_ids(spark, str(tmp_path / "ids.json"))
    assert streams.ids_json(ids).first().value == "[1,2,3]"
    assert len(streams.fingerprint(spark, str(raw)).first().digest) == 16
    streams.append_run(spark, str(tmp_path / "runs"), "a", {}, {"mota": 0.5}, {})
    streams.append_run(spark, str(tmp_path / "runs"), "b", {}, {"MOTA": 0.8}, {})
    assert [r.run_id for r in streams.leaderboard(spark.read.parquet(str(tmp_path / "runs"))).collect()] == ["b", "a"]
    streams.write_sorted_stream(spark.createDataFrame([(2.0, 1), (1.0, 2)], "t double, i int"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        streams.load_config('{"clutter_threshold": 2}')


def test_window_components_gather_no_window(spark):
    # One hot window, a chain: labels must cross all of it, and no task may be given the window's edges.
    df = spark.createDataFrame([(0, i) for i in range(300)], "win long, seq long")
    edges = spark.createDataFrame([(0, i + 1, i) for i in range(299) if i != 150], "win long, src long, dst long")
    got = pairs.window_components(df, edges)
    assert {r.seq: r.cluster for r in got.collect()} == {i: 0 if i <= 150 else 151 for i in range(300)}
    assert "Pandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_split_by_id_ranks_in_bins(spark):
    ids = [None, *range(500), 3, 3]
    got = {r.id: r.train for r in windows.split_by_id(spark.createDataFrame([(i,) for i in ids], "id long"), "id", 80).collect()}
    order = sorted(set(ids), key=lambda i: (-1, 0) if i is None else ((i + 42) * 2654435761 % 4294967291, i))
    assert got == {i: k < len(order) * 80 // 100 for k, i in enumerate(order)}
    plan = windows.split_by_id(spark.range(9), "id", 80)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(bin" in plan


def test_perceptron_weights(spark, tmp_path):
    """Weights go through a table, a folded normalisation equals one after the layer, no table is a warning, odd models are refused."""
    import numpy as np
    import pytest
    from pyspark.sql import functions as F

    from skylattice.functions import perceptron

    weights = perceptron.made_weights(spark, (2, 3, 1))
    stats = spark.createDataFrame([(u, 0.1 * u, 1.0 + u, 2.0, -0.5) for u in range(3)], "unit int, mean double, variance double, gain double, shift double")
    perceptron.fold_normalisation(weights, 0, stats).write.parquet(str(tmp_path / "w"))
    back = perceptron.load(spark, str(tmp_path / "w"))
    rows = spark.createDataFrame([(1.0, 2.0), (-3.0, None)], "a double, b double")
    got = [x["p"] for x in rows.select(perceptron.probability([F.col("a"), F.col("b")], back).alias("p")).collect()]
    w = {(x["layer"], x["unit"]): (x["bias"], x["weights"]) for x in weights.collect()}
    want = []
    for a, b in ((1.0, 2.0), (-3.0, 0.0)):
        hidden = [max(0.0, (w[0, u][0] + w[0, u][1][0] * a + w[0, u][1][1] * b - 0.1 * u) / (1.0 + u + 1e-5) ** 0.5 * 2.0 - 0.5) for u in range(3)]
        want.append(1 / (1 + np.exp(-(w[1, 0][0] + sum(h * v for h, v in zip(hidden, w[1, 0][1]))))))
    assert np.allclose(got, want)
    with pytest.warns(UserWarning):
        assert perceptron.load(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        perceptron.probability([F.col("a")], back)


def test_auc_of_probabilities_spreads_over_ranges(spark):
    """Scores between 0 and 1 with ties and nulls, against all pairs."""
    import random

    from skylattice.operators import metrics

    rng = random.Random(5)
    rows = [(rng.choice([None, *[i / 40 for i in range(40)]]), rng.random() < 0.4) for _ in range(400)]
    got = metrics.auc(spark.createDataFrame([(s, int(y)) for s, y in rows], "s double, y int"), "s", "y").first()
    pos, neg = ([s for s, y in rows if s is not None and y == want] for want in (True, False))
    won = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    assert (got["positives"], got["negatives"], got["auc"]) == (len(pos), len(neg), round(won / len(pos) / len(neg), 6))
