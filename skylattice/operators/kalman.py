"""Constant-velocity Kalman filter over tracks whose associations are known, in SQL functions.

All axes share one covariance triple (position, position with velocity, velocity), since the noises are equal and diagonal;
so the filter needs two-row matrices only and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan


@dataclass(frozen=True)
class Noise:
    p_pos: float = 1000.0**2
    p_vel: float = 500.0**2
    q: float = 50.0**2
    r: float = 150.0**2


HYBRID = Noise()
SORT = Noise(100.0, 1000.0, 0.1, 50.0)


def fold(rows: DataFrame, noise: Noise = HYBRID) -> DataFrame:
    """The filter's last state for each track, over its measurements in time order, by a scan of pieces: a track may have any length."""
    done = scan.kalman(rows, noise.p_pos, noise.p_vel, noise.q, noise.r)
    return done.select("track_id", "n", *[F.round(c, 3).alias(c) for c in ("x", "y", "vx", "vy")], F.round("p_pos", 2).alias("p_pos"))


def smoothed(rows: DataFrame, alpha: float = 0.7, gain: float = 0.2) -> DataFrame:
    """The fixed-gain smoother: the velocity follows the step from the position before its update."""
    return scan.smoothed(rows, alpha, gain).select("track_id", *[F.round(F.col(f"s.{c}"), 4).alias(c) for c in ("x", "y", "vx", "vy")])
