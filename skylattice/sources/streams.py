"""Readers and writers of measurement streams, frames, raw records, id lists and runs; schemas are explicit."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STREAM = "t double, timestamp double, radar_id int, sensor_id int, meas_type string, type string, x double, y double, z double, vx double, vy double, vz double, amplitude double, mode3a string, mode_3a string, mode_s string, gt_x double, gt_y double, track_id bigint, source_lat double, source_lon double"
MEASUREMENT = "sensor_id int, timestamp double, type string, x double, y double, z double, vx double, vy double, amplitude double, mode_3a int, mode_s string, track_id bigint"
TRUTH = "id bigint, x double, y double, z double, vx double, vy double, vz double, t double, callsign string, mode_3a int, mode_s string"
FRAMES = f"timestamp double, measurements array<struct<{MEASUREMENT.replace(' ', ':').replace(',:', ',')}>>, gt_tracks array<struct<{TRUTH.replace(' ', ':').replace(',:', ',')}>>"
CAT62 = "category int, track_number bigint, time double, lat double, lon double, x double, y double, vx double, vy double, mode3a string"


def read_stream(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One measurement for each line. strict: a bad line fails the read; else it is skipped."""
    reader = spark.read.schema(STREAM)
    return normalised(reader.option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path))


def read_frames(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return spark.read.schema(FRAMES).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_csv_stream(spark: SparkSession, path: str) -> DataFrame:
    return normalised(spark.read.schema(STREAM).csv(path, header=True, enforceSchema=False))


def normalised(rows: DataFrame) -> DataFrame:
    """One name for each thing: radar_id, meas_type, mode_3a and t from whichever of their names is filled."""
    either = lambda a, b: F.coalesce(F.col(a), F.col(b))
    kind = F.upper(either("meas_type", "type"))
    return rows.withColumns({
        "t": either("t", "timestamp"), "radar_id": either("radar_id", "sensor_id"), "mode_3a": either("mode_3a", "mode3a"),
        "meas_type": F.when(kind == "PLOT", "PSR").when(kind == "BEACON", "SSR").otherwise(kind), "track_id": F.coalesce("track_id", F.lit(-1)),
    }).drop("timestamp", "sensor_id", "type", "mode3a")


def explode_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The frames' measurements and their truth, as tables."""
    m = frames.select("timestamp", F.posexplode("measurements").alias("seq", "m")).select(F.col("timestamp").alias("frame_t"), "seq", "m.*").drop("timestamp")
    g = frames.select("timestamp", F.explode("gt_tracks").alias("g")).select(F.col("timestamp").alias("frame_t"), "g.*")
    return m, g


def is_stream(spark: SparkSession, path: str) -> bool | None:
    """Whether the first line is a single measurement and not a frame; None for an empty file."""
    first = spark.read.text(path).limit(1).select(F.get_json_object("value", "$.measurements").isNull() & F.get_json_object("value", "$.t").isNotNull()).collect()
    return first[0][0] if first else None


def read_cat62(spark: SparkSession, path: str) -> DataFrame:
    """Python dict literals, one for each line; other categories, broken and incomplete lines are skipped."""
    names = [f.split()[0] for f in CAT62.split(", ")]

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for line in part["value"]:
                try:
                    d = ast.literal_eval(line.strip())
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    continue
                if isinstance(d, dict) and d.get("category") == 62 and all(k in d for k in names):
                    rows.append({k: (str(d[k]) if k == "mode3a" and d[k] is not None else d[k]) for k in names})
            yield pd.DataFrame(rows, columns=names)

    return spark.read.text(path).where(F.trim("value") != "").mapInPandas(parse, CAT62)


def first_of_epoch(records: DataFrame, order: str) -> DataFrame:
    """The first record of each (time, track_number)."""
    return records.groupBy("time", "track_number").agg(F.min_by(F.struct(*[c for c in records.columns if c not in ("time", "track_number")]), order).alias("r")).select("time", "track_number", "r.*")


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """The first 16 hex digits of each file's SHA-256."""
    return spark.read.format("binaryFile").load(path).select("path", F.substring(F.sha2("content", 256), 1, 16).alias("digest"))


def write_sorted_stream(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """Measurements as JSON lines in order of time, over as many files as the range partitioning makes."""
    ranged = rows.repartitionByRange(partitions, "t") if partitions else rows.repartitionByRange("t")
    ranged.sortWithinPartitions("t").write.json(path)


def write_frames(measurements: DataFrame, path: str) -> None:
    columns = [c for c in measurements.columns if c != "frame"]
    measurements.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("measurements")).write.json(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ids as a column."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<bigint>")).alias("track_id"))


def ids_json(ids: DataFrame) -> DataFrame:
    return ids.agg(F.to_json(F.array_sort(F.collect_set("track_id"))).alias("value"))


def append_run(spark: SparkSession, table_path: str, run_id: str, params: dict, metrics: dict, tags: dict, status: str = "FINISHED") -> None:
    row = (run_id, status, {k: str(v) for k, v in params.items()}, {k: str(v) for k, v in tags.items()}, {k: float(v) for k, v in metrics.items()})
    schema = "run_id string, status string, params map<string,string>, tags map<string,string>, metrics map<string,double>"
    spark.createDataFrame([row], schema).withColumn("start_time", F.current_timestamp()).write.mode("append").parquet(table_path)


def leaderboard(runs: DataFrame, n: int = 10) -> DataFrame:
    """Runs by MOTA under either of its names."""
    return runs.withColumn("mota", F.coalesce(F.col("metrics")["MOTA"], F.col("metrics")["mota"])).orderBy(F.desc_nulls_last("mota"), "run_id").limit(n)


def report_json(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("report"))


def load_config(text: str) -> dict:
    """Config as JSON, with ranges checked."""
    config = json.loads(text)
    for name in ("clutter_threshold", "dropout"):
        if not 0 <= config.get(name, 0) <= 1:
            raise ValueError(f"{name} must lie between 0 and 1")
    if config.get("min_hits", 1) < 1 or config.get("max_age", 1) < 1:
        raise ValueError("min_hits and max_age must be positive")
    return config
