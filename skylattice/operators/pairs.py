"""Pairs within windows, neighbour graphs, components, fusion and softmax over groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skylattice.functions import kinematics, perceptron

from .components import components
from .staging import Scratch, parts, staged


def windowed_pairs(rows: DataFrame, condition: Column | None = None) -> DataFrame:
    """a, b: rows of one window with a.seq < b.seq. The window is the equi key, the rest a residual."""
    on = (F.col("a.win") == F.col("b.win")) & (F.col("a.seq") < F.col("b.seq"))
    return rows.alias("a").join(rows.alias("b"), on if condition is None else on & condition)


def square(a: str = "a", b: str = "b") -> Column:
    d = lambda c: F.col(f"{a}.{c}") - F.col(f"{b}.{c}")
    return d("x") * d("x") + d("y") * d("y")


def gated(rows: DataFrame, gate: float = 2000.0) -> DataFrame:
    return windowed_pairs(rows, square() <= gate * gate)


def gated_by_grid(rows: DataFrame, gate: float = 2000.0) -> DataFrame:
    """The same pairs for large windows: cells of the gate's width join their neighbours, so a window's rows spread over tasks and most pairs are never made."""
    # A little wider, so that rounding parts no pair that stands a gate apart.
    left, right = around(rows, F.lit(gate * (1 + 1e-9)))
    on = (F.col("a.win") == F.col("b.win")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.seq") < F.col("b.seq")) & (square() <= gate * gate)
    return left.alias("a").join(right.alias("b"), on)


def pairs_within(rows: DataFrame, *keys: str) -> DataFrame:
    """One row, n: how many pairs with a.seq < b.seq agree in all keys, none of them null. They are counted, not made: all pairs of
    a group's rows less those of equal seq."""
    same = rows.dropna(subset=[*keys, "seq"]).groupBy(*keys, "seq").agg(F.count("*").alias("m"))
    groups = same.groupBy(*keys).agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("equal"))
    return groups.agg(F.coalesce(F.sum(F.shiftright(F.col("m") * F.col("m") - F.col("equal"), 1)), F.lit(0).cast("long")).alias("n"))


def distance() -> Column:
    return F.sqrt(square() + (F.col("a.z") - F.col("b.z")) * (F.col("a.z") - F.col("b.z")))


def around(rows: DataFrame, cell: Column) -> tuple[DataFrame, DataFrame]:
    """rows with their cells, of width `cell`, and rows with the nine cells around theirs."""
    place = lambda c: F.floor(F.col(c) / cell)
    own = rows.withColumns({"cx": place("x"), "cy": place("y")})
    nine = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct((F.floor(i / 3) - 1).alias("dx"), (i % 3 - 1).alias("dy")))
    spread = own.withColumn("step", F.explode(nine)).withColumns({"cx": F.col("cx") + F.col("step.dx"), "cy": F.col("cy") + F.col("step.dy")}).drop("step")
    return own, spread


def within_radius(rows: DataFrame, radius: float) -> DataFrame:
    """Directed edges (win, src, dst, d) of a window's rows that are apart and nearer than the radius, by cells of that width."""
    if radius <= 0:
        return rows.select("win", F.col("seq").alias("src"), F.col("seq").alias("dst"), F.lit(0.0).alias("d")).limit(0)
    own, spread = around(rows.select("win", "seq", "x", "y", "z"), F.lit(float(radius)))
    on = (F.col("a.win") == F.col("b.win")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.seq") != F.col("b.seq")) & (distance() > 0) & (distance() < radius)
    return own.alias("a").join(spread.alias("b"), on).select(F.col("a.win").alias("win"), F.col("a.seq").alias("src"), F.col("b.seq").alias("dst"), distance().alias("d"))


#: Rows of a window that stand near each other and are compared as one leaf.
FEW = 256

LEAVES = "win long, seq long, x double, y double, z double, leaf long, held boolean, far double, near array<struct<dst:long,d:double>>"


def spread_bits(value: Column, bits: int = 20) -> Column:
    """The bits of a number of so many bits with a 0 after each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def leaves(rows: DataFrame, k: int) -> DataFrame:
    """LEAVES: rows (win, seq, x, y, z, none null) cut into leaves of FEW rows of a window at most, with the k nearest others within their leaf.

    Rows are dealt by ranges of a curve that fills the plane, so leaves have few rows wherever and however unevenly those stand, and no window
    goes to one task. held: whether a row may be another's neighbour; of many rows in one place the first k + 1 of a batch are enough.
    far: the distance of the k-th found, infinite if there are fewer."""
    extent = rows.groupBy("win").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("extent"))
    step = lambda c: spread_bits(F.least(F.lit((1 << 20) - 1), F.floor((F.col(c) - F.col(f"{c}0")) / F.col("extent") * (1 << 20))))
    placed = rows.select("win", "seq", "x", "y", "z").join(F.broadcast(extent), "win").withColumn("code", F.shiftleft(step("x"), 1).bitwiseOR(step("y"))).drop("x0", "y0", "extent")
    order = ("win", "code", "x", "y", "z", "seq")
    dealt = placed.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf = 0
        for batch in batches:
            win = batch["win"].to_numpy()
            if not len(win):
                continue
            starts = np.flatnonzero(np.r_[True, win[1:] != win[:-1]])
            for a, b in zip(starts, [*starts[1:], len(win)]):
                # Even leaves: none of a handful of rows beside full ones.
                for at in np.array_split(np.arange(a, b), -(-(b - a) // FEW)):
                    part = batch.iloc[at].sort_values("seq", kind="stable")
                    yield nearest_in_leaf(part, k).assign(leaf=(int(batch["part"].iloc[0]) << 32) + leaf)[[f.split()[0] for f in LEAVES.split(", ")]]
                    leaf += 1

    return dealt.mapInPandas(run, LEAVES)


def least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the k least finite entries of each row of d, in order of i, entry and j."""
    # All that are as near as the k-th, then a stable order.
    last = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else np.inf
    i, j = np.nonzero((d <= last) & np.isfinite(d))
    order = np.lexsort((j, d[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As distance(), to the last bit."""
    dx, dy, dz = (a[:, None, i] - b[None, :, i] for i in range(3))
    return np.sqrt(dx * dx + dy * dy + dz * dz)


def nearest_in_leaf(part: pd.DataFrame, k: int) -> pd.DataFrame:
    """part, in order of seq, with held, far and near of its rows."""
    seq, xyz = part["seq"].to_numpy(), part[["x", "y", "z"]].to_numpy(float)
    d = distances(xyz, xyz)
    d[seq[:, None] == seq[None, :]] = np.inf
    i, j = least(d, k)
    first = np.searchsorted(i, np.arange(len(seq) + 1))
    found = list(zip(seq[j].tolist(), d[i, j].tolist()))
    near = [found[a:b] for a, b in zip(first, first[1:])]
    return part.assign(held=part.groupby(["x", "y", "z"], sort=False).cumcount() <= k, far=[x[-1][1] if len(x) == k else np.inf for x in near], near=near)


#: Rows that ask for the same leaf in one task, and those compared with it at once.
ASKS, BLOCK = 65_536, 1024


def in_leaves(asks: DataFrame, rows: DataFrame, k: int, apart: bool) -> DataFrame:
    """(win, src, dst, d): for each of asks (win, seq, x, y, z, far, leaf) the k nearest of that leaf's rows not farther than far; apart: of
    another seq. A leaf that many rows ask for is dealt to several tasks."""
    shares = asks.groupBy("leaf").agg(F.ceil(F.count("*") / ASKS).alias("shares"))
    a = asks.join(shares, "leaf").withColumn("share", F.pmod(F.xxhash64("seq"), F.col("shares"))).drop("shares")
    b = rows.select("leaf", "seq", "x", "y", "z").join(shares, "leaf").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("seq", kind="stable")
        seq, there, out = b["seq"].to_numpy(), b[["x", "y", "z"]].to_numpy(float), []
        for start in range(0, len(a) if len(b) else 0, BLOCK):
            part = a.iloc[start : start + BLOCK]
            d = distances(part[["x", "y", "z"]].to_numpy(float), there)
            d[d > part["far"].to_numpy()[:, None] * ROOM] = np.inf
            own = part["seq"].to_numpy()
            if apart:
                d[own[:, None] == seq[None, :]] = np.inf
            i, j = least(d, k)
            out.append(pd.DataFrame({"win": part["win"].to_numpy()[i], "src": own[i], "dst": seq[j], "d": d[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"win": [], "src": [], "dst": [], "d": []})

    n = parts(rows.sparkSession)
    a, b = a.repartition(n, "leaf", "share"), b.repartition(n, "leaf", "share")
    return a.groupBy("leaf", "share").cogroup(b.groupBy("leaf", "share")).applyInPandas(solve, "win long, src long, dst long, d double")


def outside(a: str, b: str) -> Column:
    """The square of the distance from a's place to b's box, 0 inside."""
    off = [F.greatest(F.col(f"{b}.{c}0") - F.col(f"{a}.{c}"), F.col(f"{a}.{c}") - F.col(f"{b}.{c}1"), F.lit(0.0)) for c in ("x", "y", "z")]
    return off[0] * off[0] + off[1] * off[1] + off[2] * off[2]


def farthest(a: str, b: str) -> Column:
    """The square of the distance from a's place to the farthest corner of b's box."""
    off = [F.greatest(F.abs(F.col(f"{b}.{c}0") - F.col(f"{a}.{c}")), F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}1"))) for c in ("x", "y", "z")]
    return off[0] * off[0] + off[1] * off[1] + off[2] * off[2]


def boxes(cut: DataFrame) -> DataFrame:
    """A row for each leaf with the box around its held rows: one in FEW of the rows."""
    ends = [f(c).alias(c + n) for c in ("x", "y", "z") for f, n in ((F.min, "0"), (F.max, "1"))]
    return cut.where("held").groupBy("win", "leaf").agg(F.count("*").alias("n"), *ends)


#: Squares of distances are compared with a little room, so that rounding leaves no leaf out.
ROOM = 1 + 1e-9


def nearest(rows: DataFrame, k: int) -> DataFrame:
    """Directed edges (win, src, dst, d) from each row to the k nearest others of its window (all, if fewer), ties to the smaller seq.

    Each row looks among its leaf's rows first; then only in those other leaves whose box is not farther than the k-th it has found, or,
    where its leaf has too few, than the farthest corner of some leaf that has enough. Rows with a null coordinate have no neighbours."""
    keep = Scratch(rows.sparkSession)
    known = rows.select("win", "seq", "x", "y", "z").where("win is not null and seq is not null and x is not null and y is not null and z is not null")
    cut = keep.table(leaves(known, k), "nearest-leaves")
    box = keep.table(boxes(cut), "nearest-boxes")
    q = cut.select("win", "seq", "x", "y", "z", "leaf", F.pow("far", F.lit(2.0)).alias("far2"))
    few = q.where("far2 = double('infinity')").alias("a").join(box.where(F.col("n") > k).alias("b"), "win")
    few = few.groupBy("win", "a.leaf", "a.seq").agg(F.min(farthest("a", "b")).alias("reach"))
    bounded = q.where("far2 < double('infinity')").unionByName(q.where("far2 = double('infinity')").join(few, ["win", "leaf", "seq"], "left").select("win", "seq", "x", "y", "z", "leaf", F.coalesce("reach", "far2").alias("far2")))
    on = (F.col("a.win") == F.col("b.win")) & (F.col("a.leaf") != F.col("b.leaf")) & (outside("a", "b") <= F.col("a.far2") * ROOM)
    asks = bounded.alias("a").join(F.broadcast(box).alias("b"), on).select("a.win", "a.seq", "a.x", "a.y", "a.z", F.sqrt("a.far2").alias("far"), F.col("b.leaf").alias("leaf"))
    asks = keep.table(asks, "nearest-asks")
    beyond = in_leaves(asks, cut.where("held"), k, True)
    within = cut.select("win", F.col("seq").alias("src"), F.explode("near").alias("e")).select("win", "src", "e.dst", "e.d")
    rank = F.row_number().over(Window.partitionBy("win", "src").orderBy("d", "dst"))
    out = staged(within.unionByName(beyond).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank"), "nearest")
    keep.clear()
    return out


def nearest_of(rows: DataFrame, others: DataFrame, gate: float) -> DataFrame:
    """(win, src, dst, d): for each of rows (win, seq, x, y, z) the nearest of others nearer than the gate, ties to the smaller seq of those.

    Rows look in the leaf of the least farthest corner first, then in those whose box is not farther than what they have found there."""
    keep = Scratch(rows.sparkSession)
    whole = "win is not null and seq is not null and x is not null and y is not null and z is not null"
    cut = keep.table(leaves(others.where(whole), 1).drop("near", "far"), "nearest-leaves").where("held")
    box = keep.table(boxes(cut), "nearest-boxes")
    places = keep.table(rows.select("win", "seq", "x", "y", "z").where(whole), "nearest-rows")

    both = places.alias("a").join(F.broadcast(box).alias("b"), F.col("a.win") == F.col("b.win")).where(outside("a", "b") <= gate * gate * ROOM)
    first = both.groupBy("a.win", "a.seq", "a.x", "a.y", "a.z").agg(F.min_by("b.leaf", farthest("a", "b")).alias("leaf")).withColumn("far", F.lit(float(gate)))
    first = keep.table(first, "nearest-first")
    near = keep.table(in_leaves(first, cut, 1, False), "nearest-found")
    known = first.join(near.select("win", F.col("src").alias("seq"), "d"), ["win", "seq"], "left").withColumn("far", F.coalesce("d", "far"))
    on = (F.col("a.win") == F.col("b.win")) & (F.col("a.leaf") != F.col("b.leaf")) & (outside("a", "b") <= F.col("a.far") * F.col("a.far") * ROOM)
    asks = known.alias("a").join(F.broadcast(box).alias("b"), on).select("a.win", "a.seq", "a.x", "a.y", "a.z", "a.far", F.col("b.leaf").alias("leaf"))
    more = in_leaves(keep.table(asks, "nearest-asks"), cut, 1, False)
    best = near.unionByName(more).where(F.col("d") < gate).groupBy("win", "src").agg(F.min(F.struct("d", "dst")).alias("best"))
    out = staged(best.select("win", "src", "best.dst", "best.d"), "nearest")
    keep.clear()
    return out


def neighbour_edges(rows: DataFrame, radius: float, k: int) -> DataFrame:
    """Directed edges (win, src, dst, d): nearer than the radius and apart, or among the k nearest (ties to the smaller seq)."""
    near = nearest(rows, k)
    return within_radius(rows, radius).unionByName(near).distinct() if radius > 0 else near


def edge_attributes(edges: DataFrame, rows: DataFrame, psr: DataFrame | None = None, ssr: DataFrame | None = None) -> DataFrame:
    """edges with what tells their ends apart: dx, dy, dz, dvx, dvy, dvz (source less target, null velocities as 0) and prob, by the models
    of pairs (see functions/perceptron.py), 0 without one. As for a graph's nodes, transponder codes are not compared."""
    names = ("win", "seq", "x", "y", "z", "vx", "vy", "amplitude", "meas_type")
    end = lambda side: rows.select(F.struct(*names).alias(side), F.col("win").alias(f"_{side}w"), F.col("seq").alias(f"_{side}s"))
    both = edges.join(end("a"), (F.col("win") == F.col("_aw")) & (F.col("src") == F.col("_as"))).join(end("b"), (F.col("win") == F.col("_bw")) & (F.col("dst") == F.col("_bs")))
    v = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(0.0))
    primary = (F.col("a.meas_type") == "PSR") & (F.col("b.meas_type") == "PSR")
    other = list(kinematics.ssr_pair_features("a", "b").values())[:2] + [F.lit(0.0), F.lit(0.0)]
    score = lambda model, features: F.lit(0.0) if model is None else perceptron.probability(features, model)
    prob = F.when(primary, score(psr, list(kinematics.psr_pair_features("a", "b").values()))).otherwise(score(ssr, other))
    return both.select(*edges.columns, *[(v("a", c) - v("b", c)).alias(f"d{c}") for c in ("x", "y", "z", "vx", "vy")], F.lit(0.0).alias("dvz"), prob.alias("prob"))


def window_components(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """seq, cluster: the least seq of each row's component. A window may hold any share of the rows: its edges are spread by their ends, never gathered."""
    labelled = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).withColumnsRenamed({"u": "seq", "label": "cluster"})
    return rows.join(labelled, "seq", "left").withColumn("cluster", F.coalesce("cluster", "seq"))


def fuse(clustered: DataFrame) -> DataFrame:
    """A row for each cluster: means, velocities over those present and not 0, the first identities in member order."""
    moving = lambda c: F.avg(F.when(F.col(c) != 0, F.col(c)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("seq")))
    return clustered.groupBy("win", "cluster").agg(
        F.count("*").alias("cluster_size"), F.avg("t").alias("t"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), moving("vx").alias("vx"), moving("vy").alias("vy"),
        first("mode_3a").alias("mode_3a"), first("mode_s").alias("mode_s"), F.max(F.when(F.col("meas_type") == "SSR", "SSR").otherwise("PSR")).alias("meas_type"),
    )


def fuse_plain(clustered: DataFrame) -> DataFrame:
    """The older rule: missing velocities count as 0."""
    mean = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0.0)))
    return clustered.groupBy("win", "cluster").agg(F.count("*").alias("cluster_size"), *[mean(c).alias(c) for c in ("x", "y", "z", "vx", "vy")])


def softmax(score: str, *by: str) -> Column:
    """Within groups, the maximum taken off first."""
    w = Window.partitionBy(*by)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return e / F.sum(e).over(w)
