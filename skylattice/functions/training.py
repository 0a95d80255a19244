"""Fitting the classifiers of clutter and of pairs: weighted logistic regression, spread over the cluster by Spark's own optimiser.

A fit's rows are split by id (all rows of an id go to one side), so that a track is never in both. Positives weigh as much as
negatives. The number of optimiser steps is chosen by the best F1 on the held-out ids. The result is a model's table as in
`perceptron`, a perceptron of one layer, which a score, a filter or the tracker takes as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions import kinematics as k
from skylattice.functions import perceptron
from skylattice.operators import metrics, pairs
from skylattice.operators.staging import staged

#: Optimiser steps to choose from, shares of a hundred ids that are learnt from.
STEPS, TRAIN = (5, 20, 80), 80
CUT = 0.5


@dataclass
class Fitted:
    """A model's table, and its measures on the held-out ids."""

    weights: DataFrame
    steps: int
    n_train: int
    n_held_out: int
    precision: float
    recall: float
    f1: float


def held_out(ids: Column, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), ids), F.lit(100)) >= TRAIN


def fit(rows: DataFrame, features: list[Column], label: Column, ids: Column, steps: tuple[int, ...] = STEPS) -> Fitted | None:
    """None where the ids learnt from have no positive or no negative rows. Null features count as 0, null labels are left out."""
    return fit_staged(staged(learnable(rows, numbers(features), label, ids), "fit-rows"), len(features), steps)


def learnable(rows: DataFrame, x: Column, label: Column, ids: Column, *others: Column) -> DataFrame:
    """(x, y, out): features, label and whether the id is held out; and others."""
    return rows.select(x.alias("x"), label.cast("double").alias("y"), held_out(ids).alias("out"), *others).where("y is not null")


def numbers(features: list[Column]) -> Column:
    return F.array(*[F.coalesce(f.cast("double"), F.lit(0.0)) for f in features])


def fit_staged(data: DataFrame, width: int, steps: tuple[int, ...] = STEPS) -> Fitted | None:
    """fit() of a written table of learnable() rows, of so many features."""
    spark = data.sparkSession
    n = data.where("not out").agg(F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("negative")).first()
    if not n["positive"] or not n["negative"]:
        return None
    weight = F.when(F.col("y") == 1, n["negative"] / n["positive"]).otherwise(1.0)
    train = data.where("not out").select(array_to_vector("x").alias("features"), "y", weight.alias("weight"))
    test, best = data.where("out"), None
    for some in steps:
        model = LogisticRegression(labelCol="y", weightCol="weight", maxIter=some, regParam=1e-6).fit(train)
        table = spark.createDataFrame([(0, 0, float(model.intercept), [float(w) for w in model.coefficients])], perceptron.WEIGHTS)
        score = perceptron.probability([F.get("x", F.lit(i)) for i in range(width)], table)
        m = metrics.classifier(test.withColumn("score", score), "y", F.col("score") > CUT).first()
        if best is None or m["f1"] > best.f1:
            best = Fitted(table, some, n["positive"] + n["negative"], test.count() if best is None else best.n_held_out, m["precision"], m["recall"], m["f1"])
        if model.summary.totalIterations < some:
            break  # the optimiser has ended by itself: more steps are the same model
    return best


def fit_clutter(rows: DataFrame) -> Fitted | None:
    """Clutter is what belongs to no track. Rows of one track are one id, each row of clutter its own."""
    clutter = F.coalesce(F.col("track_id"), F.lit(-1)) == -1
    return fit(rows, k.clutter_features(), clutter.cast("int"), F.when(clutter, -F.col("seq") - 2).otherwise(F.col("track_id")))


def fit_pairs(rows: DataFrame, gate: float = 8000.0) -> tuple[Fitted | None, Fitted | None]:
    """The models of pairs of primary plots, and of pairs with a beacon: whether both are of one track. Learnt from the pairs of a window
    within the association gate, the only ones that are ever scored."""
    near = pairs.gated_by_grid(rows, gate)
    same = ((F.col("a.track_id") == F.col("b.track_id")) & (F.col("a.track_id") != -1)).cast("int")
    ids = F.least("a.track_id", "b.track_id")
    primary = (F.col("a.meas_type") == "PSR") & (F.col("b.meas_type") == "PSR")
    routes = [list(f("a", "b").values()) for f in (k.psr_pair_features, k.ssr_pair_features)]
    # Rows meet once for both models.
    x = F.when(primary, numbers(routes[0])).otherwise(numbers(routes[1]))
    both = staged(learnable(near, x, same, ids, primary.alias("primary")), "fit-pairs")
    return fit_staged(both.where("primary"), len(routes[0])), fit_staged(both.where("not primary"), len(routes[1]))
