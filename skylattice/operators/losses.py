"""The tracker's set loss and its parts as aggregations over assignments; evaluation only, without gradients."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ("x", "y", "z", "vx", "vy", "vz")


@dataclass(frozen=True)
class Weights:
    miss: float = 2.0
    false_alarm: float = 1.0
    matched_logit: float = 4.0
    logit: float = 2.0
    cardinality: float = 0.5
    alpha: float = 0.25
    gamma: float = 2.0


def cross_entropy(logit: Column, target: Column) -> Column:
    """Of a sigmoid with a target in [0, 1], stable at any logit."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def focal(logit: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Cross entropy that counts less the surer it is; of one row, a mean over rows is the loss."""
    e = cross_entropy(logit, target)
    return alpha * F.pow(1 - F.exp(-e), F.lit(gamma)) * e


def smooth_l1(difference: Column) -> Column:
    d = F.abs(difference)
    return F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)


def set_loss(pred: DataFrame, truth: DataFrame, matches: DataFrame, w: Weights = Weights()) -> DataFrame:
    """A row for each frame that has predictions or truths: n_pred, n_gt, matched, the parts of the loss and their sum.

    pred: frame, id, logit and STATE; truth: frame, id and STATE; matches: frame, pred_id, gt_id. Nulls of a state count as 0. Frames are
    aggregated before anything of them meets, so no frame is gathered."""
    v = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0.0))
    p, g, m = pred.alias("p"), truth.alias("g"), matches.alias("m")
    pairs = m.join(p, (F.col("m.frame") == F.col("p.frame")) & (F.col("m.pred_id") == F.col("p.id"))).join(g, (F.col("m.frame") == F.col("g.frame")) & (F.col("m.gt_id") == F.col("g.id")))
    off, logit = sum((smooth_l1(v("p", c) - v("g", c)) for c in STATE), F.lit(0.0)) / len(STATE), F.col("p.logit")
    matched = pairs.groupBy(F.col("m.frame").alias("frame")).agg(
        F.count("*").alias("matched"), F.avg(off).alias("regression"), F.avg(focal(logit, F.lit(1.0), w.alpha, w.gamma)).alias("matched_focal"),
        F.avg((logit - w.matched_logit) * (logit - w.matched_logit)).alias("matched_logit"))
    alone = p.join(m, (F.col("m.frame") == F.col("p.frame")) & (F.col("m.pred_id") == F.col("p.id")), "left_anti")
    false_alarms = alone.groupBy("frame").agg((w.false_alarm * F.avg(focal(F.col("logit"), F.lit(0.0), w.alpha, w.gamma))).alias("false_alarm"))
    n = lambda df, name: df.groupBy("frame").agg(F.count("*").alias(name))
    # A frame without truths has no false-alarm part: nothing is matched there.
    frames = n(pred, "n_pred").join(n(truth, "n_gt"), "frame", "full").join(matched, "frame", "left").join(false_alarms, "frame", "left").fillna(0)
    frames = frames.withColumn("false_alarm", F.when(F.col("n_gt") > 0, F.col("false_alarm")).otherwise(0.0))
    parts = {"miss": w.miss * (F.col("n_gt") - F.col("matched")), "cardinality": w.cardinality * (F.col("n_pred") - F.col("n_gt")) * (F.col("n_pred") - F.col("n_gt"))}
    total = F.col("regression") + F.col("matched_focal") + F.col("false_alarm") + F.col("miss") + w.logit * F.col("matched_logit") + F.col("cardinality")
    return frames.withColumns(parts).withColumn("loss", total).select("frame", "n_pred", "n_gt", "matched", "regression", "matched_focal", "matched_logit", "false_alarm", "miss", "cardinality", "loss")
