"""Multi-layer perceptrons over feature columns; their weights are a table with a row for each unit."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WEIGHTS = "layer int, unit int, bias double, weights array<double>"
#: A model has so many units at most: all its weights are sent to every task.
MOST_UNITS = 4096


def made_weights(spark: SparkSession, sizes: tuple[int, ...]) -> DataFrame:
    """Weights by a rule, for a model that nobody has trained yet; sizes: features, units of each layer."""
    rule = lambda layer, unit, i: float((layer * 31 + unit * 17 + i * 7) % 21 - 10) / (2.0 * sizes[layer])
    rows = [(layer, u, rule(layer, u, sizes[layer]), [rule(layer, u, i) for i in range(sizes[layer])]) for layer in range(len(sizes) - 1) for u in range(sizes[layer + 1])]
    return spark.createDataFrame(rows, WEIGHTS)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The weights table at path; None, with a warning, where there is none: filters then keep all rows."""
    try:
        return spark.read.schema(WEIGHTS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no weights at {path}", stacklevel=2)
        return None


def fold_normalisation(weights: DataFrame, layer: int, stats: DataFrame, eps: float = 1e-5) -> DataFrame:
    """weights with a batch normalisation after a layer folded in; stats: unit, mean, variance, gain, shift."""
    scale = F.col("gain") / F.sqrt(F.col("variance") + eps)
    here = weights.where(F.col("layer") == layer).join(stats, "unit").select(
        "layer", "unit", ((F.col("bias") - F.col("mean")) * scale + F.col("shift")).alias("bias"), F.transform("weights", lambda w: w * scale).alias("weights"))
    return weights.where(F.col("layer") != layer).unionByName(here)


def layers(weights: DataFrame, n_features: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, biases) of each layer, from a model's table."""
    rows = weights.orderBy("layer", "unit").limit(MOST_UNITS + 1).collect()
    if len(rows) > MOST_UNITS:
        raise ValueError(f"a model has {MOST_UNITS} units at most")
    found = []
    for layer in sorted({r["layer"] for r in rows}):
        units = [r for r in rows if r["layer"] == layer]
        found.append((np.array([r["weights"] for r in units]).T, np.array([r["bias"] for r in units])))
    if not found or found[-1][0].shape[1] != 1 or found[0][0].shape[0] != n_features:
        raise ValueError("the model's layers do not fit: one unit at its end, a weight for each feature")
    return found


def forward(model: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """The sigmoid of the last layer's one unit for each row of x; ReLU between layers."""
    for i, (w, b) in enumerate(model):
        x = x @ w + b
        if i < len(model) - 1:
            x = np.maximum(x, 0.0)
    return 1.0 / (1.0 + np.exp(-np.clip(x[:, 0], -700, 700)))


def probability(features: list[Column], weights: DataFrame) -> Column:
    """forward() over columns. Null features count as 0."""
    model = layers(weights, len(features))

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(forward(model, np.column_stack([c.to_numpy(np.float64) for c in columns])))

    return run(*[F.coalesce(f.cast("double"), F.lit(0.0)) for f in features])


def save(weights: DataFrame, path: str) -> None:
    """Writes a model's table, at most MOST_UNITS rows, as one file."""
    weights.select("layer", "unit", "bias", "weights").orderBy("layer", "unit").coalesce(1).write.mode("overwrite").parquet(path)
