"""The driver's tables seen as measurement streams: the same projection in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1704067200000000
HOUR, DAY = 3_600_000_000, 86_400_000_000

MEAS = f"""meas as (select event_id as seq, cast(event_id % 5 as int) radar_id,
  case when event_type in ('click','view') then 'PSR' else 'SSR' end meas_type,
  cast(case when event_type='error' then -1 else user_id end as bigint) track_id, user_id,
  t_us, cast(t_us as double)/1000000.0 t,
  cast(user_id*500 as double)+value*10.0 x, cast((user_id%13)*700 as double)-value*5.0 y,
  cast(1000+(user_id%7)*250 as double)+value z,
  case when event_type in ('click','view') then value-50.0 end vx,
  case when event_type in ('click','view') then 25.0-value/2.0 end vy,
  case when event_type in ('click','view') then 20.0+cast(event_id%80 as double) end amplitude,
  case when event_type not in ('click','view') then cast(1200+user_id%50 as varchar(8)) end mode_3a,
  case when event_type in ('purchase','error') then cast(user_id*7919%100000 as varchar(8)) end mode_s
from (select *, epoch_us(ts) - {EPOCH} as t_us from events))"""


def meas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    primary = F.col("event_type").isin("click", "view")
    c, d = F.col, lambda x: x.cast("double")
    t_us = F.unix_micros(c("ts").cast("timestamp")) - EPOCH
    return e.select(
        c("event_id").alias("seq"), (c("event_id") % 5).cast("int").alias("radar_id"), F.when(primary, "PSR").otherwise("SSR").alias("meas_type"),
        F.when(c("event_type") == "error", F.lit(-1)).otherwise(c("user_id")).cast("long").alias("track_id"), "user_id", t_us.alias("t_us"), (d(t_us) / 1e6).alias("t"),
        (d(c("user_id") * 500) + c("value") * 10.0).alias("x"), (d((c("user_id") % 13) * 700) - c("value") * 5.0).alias("y"), (d(1000 + (c("user_id") % 7) * 250) + c("value")).alias("z"),
        F.when(primary, c("value") - 50.0).alias("vx"), F.when(primary, 25.0 - c("value") / 2.0).alias("vy"), F.when(primary, 20.0 + d(c("event_id") % 80)).alias("amplitude"),
        F.when(~primary, (1200 + c("user_id") % 50).cast("string")).alias("mode_3a"), F.when(c("event_type").isin("purchase", "error"), (c("user_id") * 7919 % 100000).cast("string")).alias("mode_s"),
    )


def windows_sql(width: int) -> str:
    return f"{MEAS}, w as (select *, ((t_us - (select min(t_us) from meas)) // {width})::bigint win from meas)"
