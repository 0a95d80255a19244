"""The tracker: reports of a window are clustered and fused by Spark, and a scene's windows are then gone through in order.

Clusters (gate, pair classifier, connected components) and their fusion are DataFrame operations over all windows at once. What
remains in order is the association of fused reports with tracks, the filters, and the life of tracks: rows of a scene stream
through one task, sorted by window, which holds the scene's tracks (capped) and one window. Scenes are many and independent.
`Tracker.step` is that small fold; the streaming operator keeps its state between micro-batches.

A pair's cost is 1 - p, p by the pair classifiers (tables of weights, see `functions/training.py`). Without a classifier p falls
with the distance, to 0 at the gate. The assignment is solved over the pairs within the gate only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions import kinematics as k
from skylattice.functions import perceptron

from .assignment import augmented, sparse_assignment
from .kalman import HYBRID, SORT, Noise
from .pairs import fuse, gated_by_grid, square, window_components
from .staging import parts, staged

STATE = ("x", "y", "z", "vx", "vy", "vz")
TRACKS = "scene long, win long, track_id long, hits long, age long, x double, y double, z double, vx double, vy double, vz double"
REPORT = ("t", "x", "y", "z", "vx", "vy", "vz", "mode_3a", "mode_s", "size")


@dataclass(frozen=True)
class Rules:
    noise: Noise = HYBRID
    cluster_gate: float = 2000.0
    gate: float = 8000.0
    min_hits: int = 3
    max_age: int = 10
    cap: int = 500
    #: Whether measurements are clustered and hits grow by cluster sizes.
    clustered: bool = True
    birth_velocity: float = 100.0
    #: A track as old as max_age still lives; reports come out confirmed in so many first windows whatever their hits.
    last_age_lives: bool = False
    first_windows: int = 0
    #: Tracks are moved to the window's end first and assigned to all its reports by distance; the gate comes after.
    gate_last: bool = False


HYBRID_RULES = Rules()
SORT_RULES = Rules(noise=SORT, gate=15000.0, clustered=False, birth_velocity=1.0, last_age_lives=True, first_windows=3, gate_last=True)


#: The older tracker: slower to confirm, quicker to forget, and a track of the last age still lives.
LEGACY_RULES = Rules(min_hits=5, max_age=5, last_age_lives=True)
RULES = {"hybrid": HYBRID_RULES, "sort": SORT_RULES, "legacy": LEGACY_RULES}


def rules_of(name: str, **changes: object) -> Rules:
    """A tracker's rules by name, with changes."""
    if name not in RULES:
        raise ValueError(f"no tracker {name!r}: one of {', '.join(sorted(RULES))}")
    return replace(RULES[name], **changes)


@dataclass(frozen=True)
class Classifiers:
    """Layers of the models for pairs of primary plots and for pairs with a beacon, as perceptron.layers() gives them."""

    psr: list | None = None
    ssr: list | None = None

    @classmethod
    def of(cls, psr: DataFrame | None, ssr: DataFrame | None) -> Classifiers:
        return cls(psr and perceptron.layers(psr, 6), ssr and perceptron.layers(ssr, 4))


@dataclass
class Track:
    track_id: int
    t: float
    s: list[float]  # in the order of STATE
    p: list[float]  # covariance of position, position with velocity, velocity
    hits: int
    age: int = 0
    confirmed: bool = False
    mode_3a: str | None = None
    mode_s: str | None = None

    def at(self, t: float) -> list[float]:
        dt = max(0.0, t - self.t)
        return [a + v * dt for a, v in zip(self.s[:3], self.s[3:])]

    def predict(self, t: float, q: float) -> None:
        dt = t - self.t
        if dt > 0:
            a, b, c = self.p
            self.s = self.at(t) + self.s[3:]
            self.p, self.t = [a + 2 * dt * b + dt * dt * c + q, b + dt * c, c + q], t

    def update(self, m: dict, r: float) -> None:
        a, b, c = self.p
        y = [m[x] - s for x, s in zip(STATE, self.s)]
        if m["vx"] or m["vy"] or m["vz"]:
            d = (a + r) * (c + r) - b * b
            k11, k12, k22 = (a * (c + r) - b * b) / d, r * b / d, (c * (a + r) - b * b) / d
            self.p = [r * k11, r * k12, r * k22]
        else:
            k11, k12, k22, y[3:] = a / (a + r), 0.0, b / (a + r), y[:3]
            self.p = [(1 - k11) * a, (1 - k11) * b, c - k22 * b]
            self.s = [s + k11 * e for s, e in zip(self.s[:3], y)] + [s + k22 * e for s, e in zip(self.s[3:], y)]
            return
        self.s = [s + k11 * e + k12 * w for s, e, w in zip(self.s[:3], y[:3], y[3:])] + [s + k12 * e + k22 * w for s, e, w in zip(self.s[3:], y[:3], y[3:])]


#: Reports that are compared with all tracks at once.
BLOCK = 256


def pair_table(tracks: list[Track], reports: list[dict], gate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes of tracks and reports nearer than the gate in the plane, and the tracks' positions at the reports' times, by report and track.
    Tracks are capped, so a block of them and of reports is small."""
    s, t0 = np.array([t.s for t in tracks]), np.array([t.t for t in tracks])
    m = np.array([[r["t"], r["x"], r["y"]] for r in reports])
    found = []
    for start in range(0, len(m), BLOCK):
        t, x, y = m[start : start + BLOCK].T[:, :, None]
        dt = np.maximum(0.0, t - t0)
        # A little wider, so that rounding parts no pair; then the distance of those that are left.
        j, i = np.nonzero(np.abs(s[:, 0] + s[:, 3] * dt - x) < gate * (1 + 1e-9))
        p = s[i, :3] + s[i, 3:] * dt[j, i][:, None]
        near = np.hypot(p[:, 0] - x[j, 0], p[:, 1] - y[j, 0]) < gate
        found.append((i[near], j[near] + start, p[near]))
    i, j, p = zip(*found)
    return np.concatenate(i), np.concatenate(j), np.concatenate(p)


def costs(tracks: list[Track], reports: list[dict], i: np.ndarray, j: np.ndarray, p: np.ndarray, gate: float, models: Classifiers) -> np.ndarray:
    """1 - p of pairs of tracks and reports: by the model of primary plots where neither has a transponder code, else by the other."""
    m = np.array([[r["x"], r["y"], r["z"]] for r in reports])[j]
    out = np.hypot(p[:, 0] - m[:, 0], p[:, 1] - m[:, 1]) / gate
    coded = np.array([bool(t.mode_3a) for t in tracks])[i] | np.array([bool(r["mode_3a"]) for r in reports])[j]
    dist = np.linalg.norm(p - m, axis=1) / 1e5
    turn = np.abs(np.arctan2(p[:, 1], p[:, 0]) - np.arctan2(m[:, 1], m[:, 0]))
    turn = np.where(turn > math.pi, 2 * math.pi - turn, turn)
    if models.psr is not None and (~coded).any():
        v = np.array([t.s[3:5] for t in tracks])[i]
        w = np.array([[r["vx"], r["vy"]] for r in reports])[j]
        speed, other = np.linalg.norm(v, axis=1), np.linalg.norm(w, axis=1)
        rise = np.abs(np.arctan2(p[:, 2], np.hypot(p[:, 0], p[:, 1])) - np.arctan2(m[:, 2], np.hypot(m[:, 0], m[:, 1])))
        x = np.column_stack([dist, (v * w).sum(1) / ((speed + 1e-8) * (other + 1e-8)), np.abs(speed - other) / 1000, turn, rise, np.zeros(len(i))])
        out = np.where(coded, out, 1 - perceptron.forward(models.psr, x))
    if models.ssr is not None and coded.any():
        agree = lambda key: np.array([0.0 if not (a := getattr(tracks[x], key)) or not (b := reports[y][key]) else 1.0 if a == b else -1.0 for x, y in zip(i, j)])
        x = np.column_stack([dist, turn, agree("mode_3a"), agree("mode_s")])
        out = np.where(coded, 1 - perceptron.forward(models.ssr, x), out)
    return out


def nearest_in_all(tracks: list[Track], reports: list[dict], gate: float) -> dict[int, int]:
    """track -> report of the assignment with the least sum of distances, of which those not nearer than the gate are undone."""
    if not tracks or not reports:
        return {}
    few, many = np.array([t.s[:3] for t in tracks]), np.array([[m["x"], m["y"], m["z"]] for m in reports])
    turned = len(few) > len(many)
    few, many = (many, few) if turned else (few, many)
    distances = lambda x: np.linalg.norm(many - few[x], axis=1)
    pairs = [(a, b) for a, b in zip(*(x.tolist() for x in augmented(len(few), len(many), distances))) if np.linalg.norm(many[b] - few[a]) < gate]
    return {b: a for a, b in pairs} if turned else dict(pairs)


@dataclass
class Tracker:
    rules: Rules = HYBRID_RULES
    models: Classifiers = Classifiers()
    tracks: list[Track] = field(default_factory=list)
    next_id: int = 0
    windows: int = 0

    def step(self, reports: list[dict], end: float) -> list[Track]:
        """One window's fused reports, in order; returns the confirmed tracks."""
        rule, noise = self.rules, self.rules.noise
        self.windows += 1
        matched: dict[int, int] = {}
        if rule.gate_last:
            for track in self.tracks:
                track.predict(end, noise.q)
            matched = nearest_in_all(self.tracks, reports, rule.gate)
            reports = [m | {"t": end} for m in reports]
        elif reports and self.tracks:
            i, j, p = pair_table(self.tracks, reports, rule.gate)
            if len(i):
                c = costs(self.tracks, reports, i, j, p, rule.gate, self.models)
                matched = {int(i[e]): int(j[e]) for e in sparse_assignment(i, j, c)}
        for i, track in enumerate(self.tracks):
            if i in matched:
                m = reports[matched[i]]
                track.predict(m["t"], noise.q)
                track.t = m["t"]
                track.update(m, noise.r)
                track.age, track.hits = 0, track.hits + m["size"]
                track.mode_3a, track.mode_s = m["mode_3a"] or track.mode_3a, m["mode_s"] or track.mode_s
            else:
                track.age += 1
        taken = set(matched.values())
        for j, m in enumerate(reports):
            if j not in taken:
                self.tracks.append(Track(self.next_id, m["t"], [m[x] for x in STATE], [noise.p_pos, 0.0, noise.p_vel * rule.birth_velocity], m["size"], 0, False, m["mode_3a"], m["mode_s"]))
                self.next_id += 1
        if reports:
            for track in self.tracks:
                track.predict(end, noise.q)
        for track in self.tracks:
            track.confirmed |= track.hits >= rule.min_hits
        self.tracks = [t for t in self.tracks if t.age < rule.max_age + rule.last_age_lives]
        self.tracks = sorted(self.tracks, key=lambda t: -t.hits)[: rule.cap] if len(self.tracks) > rule.cap else self.tracks
        return [t for t in self.tracks if t.confirmed or self.windows <= rule.first_windows]

    def reset(self) -> None:
        """Forgets the tracks; ids go on."""
        self.tracks = []

    def dump(self) -> dict:
        return {"tracks": [asdict(t) for t in self.tracks], "next_id": self.next_id, "windows": self.windows}

    @classmethod
    def load(cls, rules: Rules, models: Classifiers, state: dict) -> Tracker:
        return cls(rules, models, [Track(**t) for t in state["tracks"]], state["next_id"], state["windows"])


def run_windows(tracker: Tracker, scene: int, windows: Iterator[tuple[int, list[dict]]], done: int | None, width: float) -> Iterator[tuple]:
    """Steps through windows that come in order, and through the empty ones between: tracks must age. Once no track is left, empty ones change
    nothing but the count of windows. done: the last window that was stepped through."""
    for win, reports in windows:
        gap = 0 if done is None else win - done - 1
        while gap and tracker.tracks:
            done, gap = done + 1, gap - 1
            for t in tracker.step([], width * (done + 1)):
                yield scene, done, t.track_id, t.hits, t.age, *t.s
        tracker.windows += gap
        done = win
        for t in tracker.step(reports, width * (win + 1)):
            yield scene, win, t.track_id, t.hits, t.age, *t.s


def as_report(r: dict) -> dict:
    number = lambda v: 0.0 if v is None or v != v else float(v)
    text = lambda v: v if isinstance(v, str) and v else None
    return {"t": float(r["t"]), "x": float(r["x"]), "y": float(r["y"])} | {c: number(r[c]) for c in ("z", "vx", "vy", "vz")} | {"mode_3a": text(r["mode_3a"]), "mode_s": text(r["mode_s"]), "size": int(r["size"])}


def with_defaults(rows: DataFrame, *others: str) -> DataFrame:
    """The columns that the tracker reads, and others; z, vz, amplitude and meas_type may be absent."""
    have = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    return rows.select(
        *others, "scene", "win", "seq", "t", "x", "y", have("z", "double").alias("z"), "vx", "vy", have("vz", "double").alias("vz"), have("amplitude", "double").alias("amplitude"),
        have("meas_type", "string").alias("meas_type"), "mode_3a", "mode_s",
    )


def linked(rows: DataFrame, rules: Rules, psr: DataFrame | None, ssr: DataFrame | None) -> DataFrame:
    """(win, src, dst): pairs of a window within the gate that belong together: by the classifiers' probability above 0.5, or, without
    one, where identities do not differ."""
    near = gated_by_grid(rows, rules.cluster_gate)
    primary = (F.coalesce(F.col("a.meas_type"), F.lit("PSR")) == "PSR") & (F.coalesce(F.col("b.meas_type"), F.lit("PSR")) == "PSR")
    differ = lambda c: F.coalesce((F.col(f"a.{c}") != F.col(f"b.{c}")) & (F.col(f"a.{c}") != "") & (F.col(f"b.{c}") != ""), F.lit(False))
    routes = ((F.col("primary"), psr, k.psr_pair_features), (~F.col("primary"), ssr, k.ssr_pair_features))
    given = {str(i): F.struct(*features("a", "b").values()) for i, (_, model, features) in enumerate(routes) if model is not None}
    ends = (F.col("a.win").alias("win"), F.col("a.seq").alias("src"), F.col("b.seq").alias("dst"))
    # Rows meet once for both routes.
    near = staged(near.select(*ends, primary.alias("primary"), (~differ("mode_3a") & ~differ("mode_s")).alias("plain"), *[x.alias(f"_f{i}") for i, x in given.items()]), "tracker-pairs")
    out = None
    for i, (route, model, features) in enumerate(routes):
        some = near.where(route)
        some = some.where("plain") if model is None else some.withColumn("_p", perceptron.probability([F.col(f"_f{i}.col{n + 1}") for n in range(len(features("a", "b")))], model)).where("_p > 0.5")
        out = some.select("win", "src", "dst") if out is None else out.unionByName(some.select("win", "src", "dst"))
    return out


def fused_reports(rows: DataFrame, rules: Rules = HYBRID_RULES, psr: DataFrame | None = None, ssr: DataFrame | None = None) -> DataFrame:
    """scene, win, first (the least seq) and REPORT of each cluster of a scene's window; of each row where the rules do not cluster."""
    rows = with_defaults(rows)
    if not rules.clustered:
        return rows.select("scene", "win", F.col("seq").alias("first"), *REPORT[:-1], F.lit(1).cast("long").alias("size"))
    keyed = staged(rows.withColumn("win", F.struct("scene", "win")).drop("scene"), "tracker-rows")
    clusters = window_components(keyed, linked(keyed, rules, psr, ssr))
    return fuse(clusters).select(
        "win.scene", "win.win", F.col("cluster").alias("first"), "t", "x", "y", "z", "vx", "vy", F.lit(None).cast("double").alias("vz"), "mode_3a", "mode_s", F.col("cluster_size").alias("size"))


def track_scenes(rows: DataFrame, width: float, rules: Rules = HYBRID_RULES, psr: DataFrame | None = None, ssr: DataFrame | None = None) -> DataFrame:
    """Confirmed tracks of each scene's windows. rows: scene, win, seq (of its own over all scenes), t (seconds; window w ends at
    (w + 1) * width), x, y, vx, vy, mode_3a, mode_s, and z, vz, amplitude, meas_type if known. psr, ssr: models' tables."""
    models = Classifiers.of(psr, ssr)

    def windows_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, list[dict]]]:
        at, held = None, []
        for part in batches:
            for r in part.to_dict("records"):
                if at != (r["scene"], r["win"]):
                    if at is not None:
                        yield *at, held
                    at, held = (r["scene"], r["win"]), []
                held.append(as_report(r))
        if at is not None:
            yield *at, held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in TRACKS.split(", ")]
        out, scene, tracker, done = [], None, None, None
        for s, win, reports in windows_of(batches):
            if s != scene:
                scene, tracker, done = s, Tracker(rules, models), None
            out += run_windows(tracker, scene, iter([(win, reports)]), done, width)
            done = win
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    reports = fused_reports(rows, rules, psr, ssr)
    # Into a given number of parts: Spark would join scenes by their bytes, and a window takes long for its bytes.
    return reports.repartition(parts(rows.sparkSession), "scene").sortWithinPartitions("scene", "win", "first").mapInPandas(run, TRACKS)


def clustered_here(rows: list[dict], rules: Rules, models: Classifiers) -> list[dict]:
    """The same clusters and fusion for one window's rows within a task, for the streaming operator: rows meet by cells of the gate's width."""
    if not rules.clustered:
        return [as_report(r | {"size": 1}) for r in rows]
    cells: dict[tuple[int, int], list[int]] = {}
    for i, r in enumerate(rows):
        cells.setdefault((math.floor(r["x"] / rules.cluster_gate), math.floor(r["y"] / rules.cluster_gate)), []).append(i)
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (cx, cy), own in cells.items():
        around = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get((cx + dx, cy + dy), ())]
        for i in own:
            near = [j for j in around if j > i and (rows[i]["x"] - rows[j]["x"]) ** 2 + (rows[i]["y"] - rows[j]["y"]) ** 2 <= rules.cluster_gate**2]
            for j, joined in zip(near, belong(rows[i], [rows[j] for j in near], models)):
                if joined:
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    members: dict[int, list[dict]] = {}
    for i, r in enumerate(rows):
        members.setdefault(root(i), []).append(r)
    mean = lambda values: sum(values) / len(values) if values else None
    out = []
    for i in sorted(members):
        group = members[i]
        present = lambda c: [m[c] for m in group if m[c] is not None and m[c] == m[c]]  # noqa: B023, E731
        row = {c: mean(present(c)) for c in ("t", "x", "y", "z")} | {c: mean([v for v in present(c) if v]) for c in ("vx", "vy")} | {"vz": None, "size": len(group)}
        out.append(as_report(row | {c: next((m[c] for m in group if m[c]), None) for c in ("mode_3a", "mode_s")}))
    return out


def belong(a: dict, others: list[dict], models: Classifiers) -> list[bool]:
    """linked() for a row and its neighbours."""
    value = lambda m, c, default=0.0: default if m[c] is None or m[c] != m[c] else m[c]
    angle = lambda m: math.atan2(m["y"], m["x"])
    rise = lambda m: math.atan2(value(m, "z"), math.hypot(m["x"], m["y"]))
    agree = lambda m, n, c: 0.0 if m[c] is None or n[c] is None else 1.0 if m[c] == n[c] else -1.0
    out = []
    for b in others:
        primary = (a["meas_type"] or "PSR") == "PSR" and (b["meas_type"] or "PSR") == "PSR"
        model = models.psr if primary else models.ssr
        if model is None:
            out.append(not any(a[c] and b[c] and a[c] != b[c] for c in ("mode_3a", "mode_s")))
            continue
        known = a["z"] is not None and b["z"] is not None
        dist = math.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (a["z"] - b["z"]) ** 2) / 1e5 if known else 0.0
        turn = abs(angle(a) - angle(b))
        turn = 2 * math.pi - turn if turn > math.pi else turn
        if primary:
            v, w = (math.hypot(value(m, "vx"), value(m, "vy")) for m in (a, b))
            dot = value(a, "vx") * value(b, "vx") + value(a, "vy") * value(b, "vy")
            x = [dist, dot / ((v + 1e-8) * (w + 1e-8)), abs(v - w) / 1000, turn, abs(rise(a) - rise(b)) if known else 0.0, abs(value(a, "amplitude", 50.0) - value(b, "amplitude", 50.0)) / 100]
        else:
            x = [dist, turn, agree(a, b, "mode_3a"), agree(a, b, "mode_s")]
        out.append(bool(perceptron.forward(model, np.array([x]))[0] > 0.5))
    return out
