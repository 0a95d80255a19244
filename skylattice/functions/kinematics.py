"""Scalar functions of measurements as Column expressions: scores, pair features, coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that the semantics name.
METRES_PER_DEGREE = 111320.0
DEFAULT_ORIGIN = (24.4539, 54.3773)
#: Weights of the default linear clutter scorer over the eight clutter features, and its bias.
CLUTTER_WEIGHTS, CLUTTER_BIAS = (-1.2, 0.4, -0.3, 0.0, 0.8, -0.5, 0.1, 0.6), 0.9


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clutter_features() -> list[Column]:
    """Amplitude (default 50), velocity and position (default 0) scaled, and the SSR flag."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    return [
        c("amplitude", 50.0) / 100.0, c("vx", 0.0) / 100.0, c("vy", 0.0) / 100.0, c("vz", 0.0) / 50.0,
        c("x", 0.0) / 1e5, c("y", 0.0) / 1e5, c("z", 0.0) / 2e4, F.when(F.col("meas_type") == "SSR", 1.0).otherwise(0.0),
    ]


def node_features() -> list[Column]:
    """A graph node's ten numbers: the clutter features with the code last but one, and a place for the hash of mode S, which is 0."""
    code = F.when(F.coalesce(F.col("mode_3a"), F.lit("")) != "", (F.col("mode_3a").cast("double") - 1000) / 1000)
    xyz, v = ["x", "y", "z"], ["vx", "vy", "vz"]
    c = lambda name, scale, default=0.0: F.coalesce(F.col(name), F.lit(default)) / scale
    return [
        *[c(n, s) for n, s in zip(xyz, (1e5, 1e5, 2e4))], *[c(n, s) for n, s in zip(v, (100.0, 100.0, 50.0))], c("amplitude", 100.0, 50.0),
        F.when(F.col("meas_type") == "SSR", 1.0).otherwise(0.0), F.coalesce(code, F.lit(0.0)), F.lit(0.0),
    ]


def linear(features: list[Column], weights: tuple[float, ...], bias: float) -> Column:
    """The default scorer's logit; trained weights fit the same place."""
    total = F.lit(bias)
    for f, w in zip(features, weights, strict=True):
        total = total + f * F.lit(w)
    return total


def wrapped(angle: Column) -> Column:
    """The absolute difference of two azimuths, at most pi."""
    return F.when(angle > math.pi, 2 * math.pi - angle).otherwise(angle)


def azimuth_difference(a: str, b: str) -> Column:
    azimuth = lambda s: F.atan2(F.col(f"{s}.y"), F.col(f"{s}.x"))
    return wrapped(F.abs(azimuth(a) - azimuth(b)))


def distance3(a: str, b: str) -> Column:
    d = lambda c: F.col(f"{a}.{c}") - F.col(f"{b}.{c}")
    return F.sqrt(d("x") * d("x") + d("y") * d("y") + d("z") * d("z"))


def psr_pair_features(a: str, b: str) -> dict[str, Column]:
    """Distance, velocity cosine, speed, azimuth, elevation and amplitude differences of two primary plots."""
    v = lambda s, c: F.coalesce(F.col(f"{s}.{c}"), F.lit(0.0))
    speed = lambda s: F.sqrt(v(s, "vx") * v(s, "vx") + v(s, "vy") * v(s, "vy"))
    dot = v(a, "vx") * v(b, "vx") + v(a, "vy") * v(b, "vy")
    elevation = lambda s: F.atan2(F.col(f"{s}.z"), F.sqrt(F.col(f"{s}.x") * F.col(f"{s}.x") + F.col(f"{s}.y") * F.col(f"{s}.y")))
    amplitude = lambda s: F.coalesce(F.col(f"{s}.amplitude"), F.lit(50.0))
    return {
        "dist": distance3(a, b) / 1e5,
        "vel_cos": dot / ((speed(a) + 1e-8) * (speed(b) + 1e-8)),
        "speed_diff": F.abs(speed(a) - speed(b)) / 1000.0,
        "azimuth_diff": azimuth_difference(a, b),
        "elevation_diff": F.abs(elevation(a) - elevation(b)),
        "amplitude_diff": F.abs(amplitude(a) - amplitude(b)) / 100.0,
    }


def agreement(x: Column, y: Column) -> Column:
    """1 if equal, -1 if not, 0 if either is missing."""
    return F.when(x.isNull() | y.isNull(), 0.0).when(x == y, 1.0).otherwise(-1.0)


def ssr_pair_features(a: str, b: str) -> dict[str, Column]:
    return {
        "dist": distance3(a, b) / 1e5,
        "azimuth_diff": azimuth_difference(a, b),
        "mode_3a_match": agreement(F.col(f"{a}.mode_3a"), F.col(f"{b}.mode_3a")),
        "mode_s_match": agreement(F.col(f"{a}.mode_s"), F.col(f"{b}.mode_s")),
    }


def to_local(lat: Column, lon: Column, lat0: Column | None = None, lon0: Column | None = None) -> tuple[Column, Column]:
    """Metres east and north of the origin, equirectangular."""
    lat0, lon0 = lat0 if lat0 is not None else F.lit(DEFAULT_ORIGIN[0]), lon0 if lon0 is not None else F.lit(DEFAULT_ORIGIN[1])
    return (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * METRES_PER_DEGREE


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) from keys, the same however rows are partitioned; also plain arithmetic, so SQL can repeat it."""
    h = F.lit(seed % 1_000_003).cast("long")
    for k in keys:
        h = F.pmod((h * 31 + F.pmod(k.cast("long"), F.lit(1_000_003)) + 17) * 7919, F.lit(1_000_003))
    return h.cast("double") / 1_000_003.0
