"""The tracker over a stream: one state for each scene, kept by Structured Streaming, and windowed counts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from skylattice.operators.tracker import HYBRID_RULES, TRACKS, Classifiers, Rules, Tracker, clustered_here, run_windows, with_defaults

COLUMNS = [f.split()[0] for f in TRACKS.split(", ")]
ROW = "t double, x double, y double, z double, vx double, vy double, vz double, amplitude double, meas_type string, mode_3a string, mode_s string"
NAMES = [f.split()[0] for f in ROW.split(", ")]


def plain(v):
    """State takes Python's own values."""
    v = v.item() if hasattr(v, "item") else v
    return None if v is None or v != v else v


class SceneTracker(StatefulProcessor):
    """Rows wait in a map of (window, seq) until the watermark passes their window's end, an event-time timer; then the window is clustered and
    stepped through, in order, however micro-batches cut it. A value holds the tracks, which the rules cap."""

    def __init__(self, width: float, rules: Rules, models: Classifiers):
        self.width, self.rules, self.models = width, rules, models

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "win long, seq long", ROW)
        self.state = handle.getValueState("tracks", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        saved = self.state.get()
        done = json.loads(saved[0])["done"] if saved else None
        fresh = set()
        for part in rows:
            for r in part.to_dict("records"):
                # Its window has been stepped through: the watermark had passed its end.
                if done is not None and r["win"] <= done:
                    continue
                self.rows.updateValue((int(r["win"]), int(r["seq"])), tuple(plain(r[c]) for c in NAMES))
                fresh.add(int(r["win"]))
        for win in fresh:
            self.handle.registerTimer(int((win + 1) * self.width * 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        ready: dict[int, list[tuple[int, dict]]] = {}
        for (win, seq), row in self.rows.iterator():
            if (win + 1) * self.width * 1000 <= end:
                ready.setdefault(win, []).append((seq, dict(zip(NAMES, row))))
        if not ready:
            return
        saved = self.state.get()
        held = json.loads(saved[0]) if saved else {"tracks": [], "next_id": 0, "windows": 0, "done": None}
        tracker = Tracker.load(self.rules, self.models, held)
        windows = ((w, clustered_here([r for _, r in sorted(ready[w], key=lambda x: x[0])], self.rules, self.models)) for w in sorted(ready))
        out = list(run_windows(tracker, int(key[0]), windows, held["done"], self.width))
        for win, some in ready.items():
            for seq, _ in some:
                self.rows.removeKey((win, seq))
        self.state.update((json.dumps(tracker.dump() | {"done": max(ready)}),))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def track_stream(rows: DataFrame, width: float, lateness: str, rules: Rules = HYBRID_RULES, psr: DataFrame | None = None, ssr: DataFrame | None = None) -> DataFrame:
    """As track_scenes, over a stream. rows: as there, and ts, the event time, which is t seconds after the epoch. A window comes out when the
    watermark, `lateness` behind the latest row, has passed its end; rows may come in any order and any micro-batch before that, none is dropped."""
    ready = with_defaults(rows, "ts").withWatermark("ts", lateness)
    return ready.groupBy("scene").transformWithStateInPandas(SceneTracker(width, rules, Classifiers.of(psr, ssr)), StructType.fromDDL(TRACKS), "append", "eventtime")


def windowed_counts(rows: DataFrame, width: str, lateness: str) -> DataFrame:
    """Counts for each epoch-aligned window and type; rows later than the watermark are dropped. An extension: batch windows start at the first row."""
    return rows.withWatermark("ts", lateness).groupBy(F.window("ts", width), "meas_type").agg(F.count("*").alias("n"), F.avg("x").alias("avg_x")).select("window.start", "window.end", "meas_type", "n", "avg_x")
