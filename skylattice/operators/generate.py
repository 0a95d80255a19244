"""Radar sites, scans, codes and augmentation of measurements, by hashes of keys: the same at any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.kinematics import uniform

# Five sites of our own choosing (id, x, y, range, period, chances of PSR and SSR detection).
SITES = [(0, 0.0, 0.0, 120000.0, 5.5, 0.9, 0.95), (1, 60000.0, 20000.0, 110000.0, 6.0, 0.88, 0.94), (2, -50000.0, 40000.0, 100000.0, 7.0, 0.86, 0.93), (3, 20000.0, -70000.0, 100000.0, 8.0, 0.85, 0.92), (4, -60000.0, -50000.0, 90000.0, 9.0, 0.84, 0.9)]
SITE_SCHEMA = "site int, sx double, sy double, max_range double, period double, psr double, ssr double"


def sites(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SITES, SITE_SCHEMA)


def next_scan(t: Column, phase: Column, period: Column) -> Column:
    """The first scan at or after t."""
    return phase + F.ceil((t - phase) / period) * period


def seen_by(targets: DataFrame, radars: DataFrame) -> DataFrame:
    """Targets within each radar's range: the radars are a fixed handful, broadcast."""
    d = F.sqrt((F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy")))
    return targets.crossJoin(F.broadcast(radars)).withColumn("ground_range", d).where(F.col("ground_range") <= F.col("max_range"))


def altitude_band(speed: Column, u: Column) -> Column:
    """Metres by speed: one of four bands, random within it."""
    return F.when(speed < 80, 300 + u * 1200).when(speed < 150, 1500 + u * 3000).when(speed < 220, 4500 + u * 4500).otherwise(9000 + u * 3000)


def squawk(key: Column) -> Column:
    return F.lpad(F.conv(F.pmod(key * 7919, F.lit(4096)).cast("string"), 10, 8), 4, "0")


def mode_s(key: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.pmod(key * 2654435761, F.lit(16777216)))), 6, "0")


def normal(*keys: Column, seed: int) -> Column:
    """A standard normal number from keys."""
    u, v = uniform(*keys, seed=seed), uniform(*keys, seed=seed + 1)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def augmented(rows: DataFrame, drop: float = 0.1, hide: float = 0.2, bias: dict[int, float] | None = None, noise: float = 0.0, seed: int = 7) -> DataFrame:
    """Dropout of rows, then of identities of secondary reports, then noise, then a bias for each sensor."""
    kept = rows.where(uniform(F.col("seq"), seed=seed) >= drop)
    hidden = (F.col("meas_type") == "SSR") & (uniform(F.col("seq"), seed=seed + 1) < hide)
    kept = kept.withColumns({c: F.when(~hidden, F.col(c)) for c in ("mode_3a", "mode_s")})
    if noise:
        kept = kept.withColumns({c: F.col(c) + noise * normal(F.col("seq"), seed=seed + 2 + 2 * i) for i, c in enumerate(("x", "y"))})
    if bias:
        shift = F.lit(0.0)
        for sensor, by in bias.items():
            shift = F.when(F.col("radar_id") == sensor, F.lit(by)).otherwise(shift)
        kept = kept.withColumn("x", F.col("x") + shift)
    return kept
