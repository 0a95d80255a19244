"""The life of tracks by existence probabilities, window by window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Existence:
    init: float = 0.5
    coast: float = 0.4
    del_exist: float = 0.3
    del_age: int = 5
    cap: int = 200
    #: With fewer measurements in a window tracks coast more easily; without tracks measurements start them more easily.
    few: int = 30
    boost: float = 0.5
    cold: float = 0.18
    #: A track above this probability is seen anew.
    seen: float = 0.4


def live_tracks(rows: DataFrame, rule: Existence = Existence()) -> DataFrame:
    """What lives on after each window: rows of win, id, is_track, prob, suppressed, age, hits with new age and hits.

    A window's counts come from an aggregation that joins back; only the cap ranks, and Spark limits each task's share of a
    window before it is gathered. Equal probabilities go by id. Null probabilities count as 0."""
    p = F.coalesce("prob", F.lit(0.0))
    track = F.col("is_track")
    counts = rows.groupBy("win").agg(F.count(F.when(track, 1)).alias("n_tracks"), F.count(F.when(~track, 1)).alias("n_meas"))
    cold = F.col("n_tracks") == 0
    coasts = p + F.when(F.col("n_meas") < rule.few, rule.boost).otherwise(0.0) > rule.coast
    starts = (p > F.when(cold, rule.init - rule.cold).otherwise(rule.init)) & (cold | ~F.coalesce("suppressed", F.lit(False)))
    kept = rows.withColumn("prob", p).join(counts, "win").where(F.when(track, coasts).otherwise(starts))
    seen = p > rule.seen
    kept = kept.select(
        "win", "id", "is_track", "prob",
        F.when(~track | seen, 0).otherwise(F.col("age") + 1).cast("long").alias("age"), F.when(~track, 1).when(seen, F.col("hits") + 1).otherwise(F.col("hits")).cast("long").alias("hits"),
    ).where((p > rule.del_exist) | (F.col("age") < rule.del_age))
    rank = F.row_number().over(Window.partitionBy("win").orderBy(F.desc("prob"), "id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= rule.cap).drop("rank")
