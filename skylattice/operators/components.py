"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Scratch, lookup, staged


def _star(keep: Scratch, edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): every u sends its larger (large) or not larger neighbours to the least of its neighbourhood.

    The hub of a giant component is one key of the join: lookup() sends the largest hubs' least neighbours to all tasks."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where(F.col("v") < F.col("u"))
    least = keep.table(near.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u")), "least")
    if large:
        out = lookup(near, least.drop("n"), ["u"], least).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        # After a large step the hubs are the least of their neighbours, with none smaller.
        out = near.join(least.drop("n").hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return keep.table(out.where(F.col("u") != F.col("v")).distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(u, label) of every vertex that has an edge to a smaller one: label is the least vertex of its component.

    Each step is an aggregation and a join. They end when the edges are stars: nothing has two parents, no parent has one."""
    keep = Scratch(edges.sparkSession)
    now = keep.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct(), "edges")
    while True:
        # Each end of an edge once: how many parents it has, and whether it is one.
        ends = now.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            break
        now = _star(keep, _star(keep, now, True), False)
    labels = staged(now.select("u", F.col("v").alias("label")), "labels")
    keep.clear()
    return labels
