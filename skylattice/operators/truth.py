"""Truth tracks: bounds, calibration and the interpolating as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylattice.functions.kinematics import DEFAULT_ORIGIN, METRES_PER_DEGREE


def interpolated(truth: DataFrame, step_us: int) -> DataFrame:
    """Each track's position at every tick (multiples of step_us) from its first to its last sample. Segments between samples
    carry the ticks they cover, so there is no join: a lead and an explode. Of samples at one time the last counts, a tick on a sample takes it."""
    one = truth.groupBy("track_id", "t_us").agg(F.max_by(F.struct("x", "y", "z"), "seq").alias("p"))
    w = Window.partitionBy("track_id").orderBy("t_us")
    seg = one.withColumns({"t1": F.lead("t_us").over(w), "p1": F.lead("p").over(w)})
    lo, hi = F.ceil(F.col("t_us") / step_us), F.when(F.col("t1").isNull(), F.floor(F.col("t_us") / step_us)).otherwise(F.ceil(F.col("t1") / step_us) - 1)
    ticks = seg.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("tick", F.explode(F.sequence("lo", "hi")))
    share = F.when(F.col("t1").isNull(), F.lit(0.0)).otherwise((F.col("tick") * step_us - F.col("t_us")) / (F.col("t1") - F.col("t_us")))
    at = lambda c: F.round(F.col(f"p.{c}") + F.when(F.col("t1").isNull(), 0.0).otherwise((F.col(f"p1.{c}") - F.col(f"p.{c}")) * F.col("share")), 4).alias(c)
    return ticks.withColumn("share", share).select("track_id", "tick", at("x"), at("y"), at("z"))


def bounds(truth: DataFrame) -> DataFrame:
    return truth.where("track_id <> -1").groupBy("track_id").agg(
        F.count("*").alias("n"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), *[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))]
    )


def calibration(rows: DataFrame, sample: int = 500) -> DataFrame:
    """Medians of positions over the first rows with truth in time order: a top-k by time and one row of result."""
    first = rows.where("track_id <> -1").orderBy("t_us", "seq").limit(sample)
    return first.agg(F.count("*").alias("n"), F.round(F.median("x"), 4).alias("median_x"), F.round(F.median("y"), 4).alias("median_y"))


def calibrated_origin(rows: DataFrame, sample: int = 500) -> DataFrame:
    """One row: n, origin_lat, origin_lon, lat_scale, lon_scale (metres a degree), the medians of the origins that the reports of the first
    `sample` rows imply, those of a track with a position; the latitude's median goes into the longitudes' scale. Without any, the default origin.
    rows: t_us, seq, track_id, source_lat, source_lon, x, y. A top-k by time, then one row of result."""
    first = rows.select("t_us", "seq", "track_id", "source_lat", "source_lon", "x", "y").orderBy("t_us", "seq").limit(sample)
    used = first.where("track_id <> -1 and source_lat is not null")
    metres = F.lit(METRES_PER_DEGREE)
    lat = used.agg(F.count("*").alias("n"), F.coalesce(F.median(F.col("source_lat") - F.col("y") / metres), F.lit(DEFAULT_ORIGIN[0])).alias("origin_lat"))
    lat = lat.withColumns({"lat_scale": metres, "lon_scale": metres * F.cos(F.radians("origin_lat"))})
    lon = used.crossJoin(F.broadcast(lat)).agg(F.coalesce(F.median(F.col("source_lon") - F.col("x") / F.col("lon_scale")), F.lit(DEFAULT_ORIGIN[1])).alias("origin_lon"))
    return lat.crossJoin(F.broadcast(lon)).select("n", "origin_lat", "origin_lon", "lat_scale", "lon_scale")


def trajectories(rows: DataFrame, origin: DataFrame) -> DataFrame:
    """track_id, t_us, seq, x, y, z, vx, vy of every report of a track: the true position where a report has one, else the one that its
    latitude and longitude give from the origin (one row); height and velocity are the report's, a missing velocity is 0."""
    true = F.col("gt_x").isNotNull() & F.col("gt_y").isNotNull()
    east, north = (F.col("source_lon") - F.col("origin_lon")) * F.col("lon_scale"), (F.col("source_lat") - F.col("origin_lat")) * F.col("lat_scale")
    v = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    placed = rows.where("track_id <> -1").crossJoin(F.broadcast(origin.drop("n")))
    return placed.select("track_id", "t_us", "seq", F.when(true, F.col("gt_x")).otherwise(east).alias("x"), F.when(true, F.col("gt_y")).otherwise(north).alias("y"), "z", v("vx"), v("vy"))


def states_at(truth: DataFrame, step_us: int, allowed: DataFrame | None = None) -> DataFrame:
    """track_id, tick, x, y, z, vx, vy, vz (0) of each track at every multiple of step_us from its first to its last sample, between the sample
    before the tick and the one at or after it. Samples less than a microsecond apart give the earlier one. allowed: the ids (track_id) that count."""
    names = ("x", "y", "z", "vx", "vy")
    rows = truth if allowed is None else truth.join(allowed.select("track_id").distinct(), "track_id", "left_semi")
    w = Window.partitionBy("track_id").orderBy("t_us", "seq")
    seg = rows.select("track_id", "t_us", "seq", F.struct(*names).alias("s")).withColumns({"t0": F.lag("t_us").over(w), "s0": F.lag("s").over(w)})
    # Ticks after the sample before, up to this one; a track's first sample has only a tick of its own time.
    lo = F.when(F.col("t0").isNull(), F.ceil(F.col("t_us") / step_us)).otherwise(F.floor(F.col("t0") / step_us) + 1)
    ticks = seg.withColumns({"lo": lo, "hi": F.floor(F.col("t_us") / step_us)}).where("lo <= hi").withColumn("tick", F.explode(F.sequence("lo", "hi")))
    gap = F.col("t_us") - F.col("t0")
    share = (F.col("tick") * step_us - F.col("t0")) / gap
    at = lambda c: F.when(F.col("t0").isNull(), F.col(f"s.{c}")).when(gap < 1, F.col(f"s0.{c}")).otherwise(F.col(f"s0.{c}") + share * (F.col(f"s.{c}") - F.col(f"s0.{c}"))).alias(c)
    return ticks.select("track_id", "tick", *[at(c) for c in names], F.lit(0.0).alias("vz"))
