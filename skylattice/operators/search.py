"""Search over parameters by successive halving: a grid is scored on a part of the frames, the better half on more of them, and so on.

All parameters of a round are scored in one aggregation, over matches that do not depend on them, so the grid's size costs rows of results,
not passes over the data. Runs come out as a table, the best first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "round int, param double, frames long, mota double, kept boolean"


def halving(score: Callable[[DataFrame, int], DataFrame], params: list[float], rounds: int, spark) -> DataFrame:
    """score(params: param, shares of the frames: one in so many) -> param, frames, mota. In the last round all frames count. Equal scores go
    to the smaller parameter. Of n parameters (n + 1) // 2 go on; only rows of results reach the driver."""
    runs, left = [], sorted(params)
    for i in range(rounds):
        grid = spark.createDataFrame([(p,) for p in left], "param double")
        rows = sorted(score(grid, 2 ** (rounds - 1 - i)).collect(), key=lambda r: (-r["mota"], r["param"]))
        keep = {r["param"] for r in rows[: max(1, (len(rows) + 1) // 2) if i < rounds - 1 else 1]}
        runs += [(i + 1, r["param"], r["frames"], r["mota"], r["param"] in keep) for r in rows]
        left = sorted(keep)
    return spark.createDataFrame(runs, RUNS)


def gate_scores(pred: DataFrame, truth: DataFrame, matches: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """Scores of match gates (metres): MOTA without switches over the frames whose number the share divides. matches: frame, dist of the
    assignments before any gate."""
    n = lambda df, name: df.groupBy("frame").agg(F.count("*").alias(name))
    frames = n(pred, "n_pred").join(n(truth, "n_gt"), "frame", "full").fillna(0)

    def score(grid: DataFrame, share: int) -> DataFrame:
        some = frames.where(F.col("frame") % share == 0)
        sides = some.agg(F.count("*").alias("frames"), F.coalesce(F.sum("n_pred"), F.lit(0)).alias("p"), F.coalesce(F.sum("n_gt"), F.lit(0)).alias("g"))
        within = matches.where(F.col("frame") % share == 0).join(F.broadcast(grid), F.col("dist") < F.col("param")).groupBy("param").agg(F.count("*").alias("m"))
        all_ = grid.join(within, "param", "left").fillna(0).crossJoin(F.broadcast(sides))
        mota = F.when(F.col("g") > 0, 1 - ((F.col("g") - F.col("m")) + (F.col("p") - F.col("m"))) / F.col("g")).otherwise(0.0)
        return all_.select("param", "frames", F.round(mota, 6).alias("mota"))

    return score
