"""Windows from the first measurement on, with the empty ones; ordered operators; splits; deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scan


def with_window(rows: DataFrame, width_us: int, time: str = "t_us") -> DataFrame:
    """win: the half-open window of each row, counted from the earliest time. The origin is one row, safe to broadcast."""
    origin = rows.agg(F.min(time).alias("t0"))
    return rows.crossJoin(F.broadcast(origin)).withColumn("win", F.floor((F.col(time) - F.col("t0")) / width_us)).drop("t0")


def dense(windowed: DataFrame, per_window: DataFrame) -> DataFrame:
    """per_window with a row for every window from the first to the last."""
    spine = windowed.agg(F.max("win").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("win"))
    return spine.join(per_window, "win", "left")


def tumbling_summary(rows: DataFrame, width_us: int) -> DataFrame:
    windowed = with_window(rows, width_us)
    per = windowed.groupBy("win").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("track_id") != -1, F.col("track_id"))).alias("targets"), F.avg("x").alias("ax"), F.avg("y").alias("ay"))
    return dense(windowed, per).select("win", F.coalesce("n", F.lit(0).cast("long")).alias("n_meas"), F.coalesce("targets", F.lit(0).cast("long")).alias("n_targets"), F.round("ax", 6).alias("avg_x"), F.round("ay", 6).alias("avg_y"))


def first_per(rows: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The first row of each key: an aggregation, which combines before it shuffles."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def top_per(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def deltas(rows: DataFrame) -> DataFrame:
    """Scaled changes from each row to the same target's next."""
    w = Window.partitionBy("track_id").orderBy("t_us", "seq")
    d = lambda c, scale: F.round((F.lead(c).over(w) - F.col(c)) / scale, 6).alias(f"d{c}")
    return rows.select("seq", "track_id", d("x", 100.0), d("y", 100.0), d("z", 100.0)).where("dx is not null")


def sequences(rows: DataFrame, length: int = 5) -> DataFrame:
    """Sliding runs of a target's rows, stride one."""
    w = Window.partitionBy("track_id").orderBy("t_us", "seq")
    return rows.select("track_id", "seq", F.collect_list("seq").over(w.rowsBetween(0, length - 1)).alias("run")).where(F.size("run") == length)


def ema(rows: DataFrame, value: str, keep: float = 0.95) -> DataFrame:
    """Exponential moving average of each target, seeded with its first value, by a scan of pieces: a track may have any length."""
    return scan.ema(rows, value, keep).select("track_id", "n", F.round("ema", 4).alias("ema"))


def split_by_time(rows: DataFrame, bounds_percent: tuple[int, int]) -> DataFrame:
    """train, val, test by row counts in time order. Days are counted; a day that holds no bound gets its part from the counts alone, and only
    the days that hold one, two at most, are ranked, by pieces of a second: no task sorts all rows, or a day's."""
    day, second = F.floor(F.col("t_us") / 86_400_000_000), F.floor(F.col("t_us") / 1_000_000)
    dayed = rows.withColumn("day", day)
    earlier = lambda *by: Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    counts = dayed.groupBy("day").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # A row for each day.
    counted = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier("day")), F.lit(0))).crossJoin(F.broadcast(total))
    for i, p in enumerate(bounds_percent):
        counted = counted.withColumn(f"b{i}", F.floor(F.col("total") * p / 100))
    holds = lambda i: (F.col("before") < F.col(f"b{i}")) & (F.col("before") + F.col("n") > F.col(f"b{i}"))
    counted = counted.withColumn("cut", holds(0) | holds(1))
    placed = dayed.join(counted.drop("n", "total"), "day")
    part = lambda rank: F.when(rank <= F.col("b0"), "train").when(rank <= F.col("b1"), "val").otherwise("test").alias("part")
    inside = placed.where("cut").withColumn("second", second)
    seconds = inside.groupBy("day", "second").agg(F.count("*").alias("in_second"))
    of_day = Window.partitionBy("day").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    starts = seconds.select("day", "second", F.coalesce(F.sum("in_second").over(of_day), F.lit(0)).alias("start"))
    rank = F.col("before") + F.col("start") + F.row_number().over(Window.partitionBy("day", "second").orderBy("t_us", "seq"))
    ranked = inside.join(starts, ["day", "second"]).select("seq", part(rank))
    return placed.where("not cut").select("seq", part(F.col("before") + 1)).unionByName(ranked)


def split_by_id(ids: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """A share of the distinct ids by a hash order, the same at any partitioning. No task ranks all ids: hashes are counted in bins of
    65,536 values, and each bin is ranked by itself after those before it."""
    hashed = F.pmod((F.col(key) + seed) * 2654435761, F.lit(4294967291))
    distinct = ids.select(key).distinct().withColumn("h", hashed)
    binned = distinct.withColumn("bin", F.coalesce(F.floor(F.col("h") / 65536), F.lit(-1)))
    counts = binned.groupBy("bin").agg(F.count("*").alias("in_bin"))
    before = counts.withColumn("before", F.coalesce(F.sum("in_bin").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = counts.agg(F.sum("in_bin").alias("n"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("bin").orderBy("h", key))
    ranked = binned.join(before, "bin").withColumn("rank", rank).crossJoin(F.broadcast(n))
    return ranked.select(key, (F.col("rank") <= F.floor(F.col("n") * percent / 100)).alias("train"))
