"""Tracking and classifier metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import staged

NO_MATCH_MOTP = 15000.0


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def summary(counts: DataFrame) -> DataFrame:
    """MOTA, MOTP, precision, recall, F1 and rates from per-frame counts; all 0 without frames. id_switches may be among the counts."""
    counts = counts if "id_switches" in counts.columns else counts.withColumn("id_switches", F.lit(0))
    s = counts.agg(F.count("*").alias("frames"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matches", "fp", "fn", "dist_sum", "id_switches")])
    c = F.col
    s = s.withColumns({"precision": ratio(c("matches"), c("matches") + c("fp")), "recall": ratio(c("matches"), c("matches") + c("fn"))})
    motp = F.when(c("frames") == 0, 0.0).when(c("matches") == 0, NO_MATCH_MOTP).otherwise(c("dist_sum") / c("matches"))
    mota = F.when(c("matches") + c("fn") == 0, 0.0).otherwise(1 - (c("fn") + c("fp") + c("id_switches")) / (c("matches") + c("fn")))
    r = lambda x, n: F.round(x, 6).alias(n)
    return s.select(
        r(mota, "mota"), r(motp, "motp"), r(c("precision"), "precision"), r(c("recall"), "recall"), r(ratio(2 * c("precision") * c("recall"), c("precision") + c("recall")), "f1"),
        r(ratio(c("fp"), c("frames")), "fp_rate"), r(ratio(c("fn"), c("frames")), "fn_rate"), c("matches").cast("long").alias("total_matches"), c("fp").cast("long").alias("fp"), c("fn").cast("long").alias("fn"), c("id_switches").cast("long").alias("id_switches"),
    )


def formatted(summary_row: DataFrame) -> DataFrame:
    """text: the summary as one line."""
    names = {"MOTA: %.3f": "mota", "MOTP: %.1f": "motp", "Precision: %.3f": "precision", "Recall: %.3f": "recall", "F1: %.3f": "f1", "ID_SW: %d": "id_switches", "FP/frame: %.1f": "fp_rate", "FN/frame: %.1f": "fn_rate"}
    return summary_row.select(F.format_string(" | ".join(names), *names.values()).alias("text"))


def id_switches(matches: DataFrame) -> DataFrame:
    """Matches whose truth had another prediction in the frame before."""
    w = Window.partitionBy("gt_id").orderBy("frame")
    return matches.withColumns({"was": F.lag("pred_id").over(w), "was_frame": F.lag("frame").over(w)}).where((F.col("was_frame") == F.col("frame") - 1) & (F.col("was") != F.col("pred_id")))


#: Frames that are numbered together.
FRAMES = 65_536


def frames_before(frames: DataFrame) -> DataFrame:
    """(frame, before): the next earlier frame of the table, null for the first. Frames are ordered within bins, the bins by one row each."""
    binned = frames.select("frame").distinct().withColumn("bin", F.floor(F.col("frame") / FRAMES))
    last = binned.groupBy("bin").agg(F.max("frame").alias("last"))
    carried = last.select("bin", F.max("last").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    within = F.lag("frame").over(Window.partitionBy("bin").orderBy("frame"))
    return binned.join(F.broadcast(carried), "bin").select("frame", F.coalesce(within, "carried").alias("before"))


def stateful_switches(matches: DataFrame, scored: DataFrame) -> DataFrame:
    """frame, gt_id, pred_id, was: matches whose truth had another prediction in the last frame before that was scored, one that had both
    predictions and truths; frames without either are passed over, as a tracker's evaluation passes over them. scored: frame."""
    w = Window.partitionBy("gt_id").orderBy("frame")
    lagged = matches.withColumns({"was": F.lag("pred_id").over(w), "was_frame": F.lag("frame").over(w)}).where(F.col("was") != F.col("pred_id"))
    return lagged.join(frames_before(scored), "frame").where(F.col("was_frame") == F.col("before")).select("frame", "gt_id", "pred_id", "was")


def classifier(rows: DataFrame, label: str, predicted: Column) -> DataFrame:
    t, p = F.col(label) == 1, predicted
    s = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    c, e = F.col, 1e-8
    s = s.withColumns({"precision": c("tp") / (c("tp") + c("fp") + e), "recall": c("tp") / (c("tp") + c("fn") + e)})
    return s.select("tp", "fp", "fn", *[F.round(x, 6).alias(n) for n, x in (("precision", c("precision")), ("recall", c("recall")), ("f1", 2 * c("precision") * c("recall") / (c("precision") + c("recall") + e)))])


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties counting half: from counts for each distinct score, whose running sums are taken
    within sorted ranges of scores and over the ranges' totals, so no task sorts all rows. Null scores take no part."""
    by_score = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("n"))
    ranged = staged(by_score.repartitionByRange(F.desc(score)).withColumn("range", F.spark_partition_id()), "auc-ranges")
    before = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    per = ranged.groupBy("range").agg(F.sum("p").alias("bp"))
    above = per.select("range", F.coalesce(F.sum("bp").over(before("range")), F.lit(0)).alias("above"))
    w = Window.partitionBy("range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    pairs = ranged.join(F.broadcast(above), "range").select("p", "n", ((F.col("above") + F.coalesce(F.sum("p").over(w), F.lit(0)) + F.col("p") / 2) * F.col("n")).alias("won"))
    return pairs.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum("won").alias("won")).select("positives", "negatives", F.round(ratio(F.col("won"), F.col("positives") * F.col("negatives")), 6).alias("auc"))
