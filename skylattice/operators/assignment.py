"""One-to-one assignment within frames, and greedy and nearest matching."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .pairs import nearest_of
from .staging import parts, staged


def augmented(n: int, m: int, row: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest assignment of n rows to n of m >= n columns, by shortest augmenting paths with potentials; row(i): the costs
    of row i, none of them NaN, asked for when they are needed, so memory is n + m. Rows whose cheapest column nobody has taken yet get it
    at once; only the others search for paths, and potentials change once for each path."""
    u, v, owner, mate = np.zeros(n), np.zeros(m), np.full(m, -1), np.full(n, -1)
    for i in range(n):
        cost = row(i)
        j = int(np.argmin(cost))
        u[i] = cost[j]
        if owner[j] < 0:
            owner[j], mate[i] = i, j
    reach, back, nearer = np.empty(m), np.empty(m, int), np.empty(m, bool)
    for start in np.flatnonzero(mate < 0).tolist():
        reach.fill(np.inf)
        price, i, far, closed, at = v.copy(), start, 0.0, [], []
        while True:
            way = row(i) - price
            way += far - u[i]
            np.less(way, reach, out=nearer)
            np.copyto(reach, way, where=nearer)
            np.copyto(back, i, where=nearer)
            j = int(np.argmin(reach))
            far = reach[j]
            if owner[j] < 0:
                break
            closed.append(j)
            at.append(far)
            # A closed column is infinitely far from now on.
            reach[j], price[j] = np.inf, -np.inf
            i = int(owner[j])
        gain = far - np.array(at)
        u[owner[closed]] += gain
        v[closed] -= gain
        u[start] += far
        i = -1
        while i != start:
            i = int(back[j])
            owner[j] = i
            mate[i], j = j, int(mate[i])
    return np.arange(n), mate


def hungarian(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cheapest complete assignment."""
    if cost.size == 0:
        return np.empty(0, int), np.empty(0, int)
    if cost.shape[0] > cost.shape[1]:
        cols, rows = hungarian(cost.T)
        order = np.argsort(rows)
        return rows[order], cols[order]
    return augmented(*cost.shape, lambda i: cost[i])


def sparse_assignment(a: np.ndarray, b: np.ndarray, cost: np.ndarray, limit: float = 1.0) -> np.ndarray:
    """Indexes of the edges (a[k], b[k], cost[k]) of the cheapest one-to-one assignment in which staying alone costs `limit`.

    It is what a complete assignment over a matrix filled up with `limit` keeps below it, without that matrix: every row may
    take its edges or a column of its own, and rows are added one by one along shortest augmenting paths over the edges."""
    edges: dict[int, list[tuple[int, float, int]]] = {}
    for k in np.lexsort((b, a)).tolist():
        if cost[k] < limit:
            edges.setdefault(int(a[k]), []).append((int(b[k]), float(cost[k]) - limit, k))
    price_a: dict[int, float] = {}
    price_b: dict[object, float] = {}
    owner: dict[object, int] = {}
    taken: dict[int, tuple[object, int]] = {}  # row -> its column and edge
    for start in sorted(edges):
        # A column is (0, b), or (1, row) for staying alone.
        options = lambda r: [((0, j), c, k) for j, c, k in edges[r]] + [((1, r), 0.0, -1)]
        price_a[start] = min(c - price_b.get(j, 0.0) for j, c, _ in options(start))
        best: dict[object, float] = {}
        came: dict[object, tuple[int, int]] = {}
        done: list[object] = []
        closed, heap, row, base = set(), [], start, 0.0
        while True:
            for j, c, k in options(row):
                d = base + c - price_a[row] - price_b.get(j, 0.0)
                if j not in closed and d < best.get(j, np.inf):
                    best[j], came[j] = d, (row, k)
                    heappush(heap, (d, j))
            while heap[0][1] in closed:
                heappop(heap)
            base, j = heappop(heap)
            if j not in owner:
                break
            closed.add(j)
            done.append(j)
            row = owner[j]
        for x in done:
            price_b[x] = price_b.get(x, 0.0) - (base - best[x])
            price_a[owner[x]] += base - best[x]
        price_a[start] += base
        while True:
            row, k = came[j]
            before = taken.get(row)
            owner[j], taken[row] = row, (j, k)
            if before is None:
                break
            j = before[0]
    return np.array(sorted(k for _, k in taken.values() if k >= 0), int)


#: Nearest columns of a row that a search has at hand; columns on either side of a row, along the widest axis, among which they are looked for.
AT_HAND, BESIDE = 32, 64


def at_hand(x: np.ndarray, y: np.ndarray) -> list[list[tuple[float, int]]]:
    """(distance, place in y) of the AT_HAND nearest rows of y, or all, for each row of x, nearest first. y is in order of its first axis."""
    m, found = len(y), []
    k, wide = min(AT_HAND, m), min(2 * BESIDE, m)
    for a in range(0, len(x), 1024):
        part = x[a : a + 1024]
        lo = np.clip(np.searchsorted(y[:, 0], part[:, 0]) - BESIDE, 0, m - wide)
        cols = lo[:, None] + np.arange(wide)
        d = np.sqrt(((part[:, None] - y[cols]) ** 2).sum(2))
        nearest = np.argsort(d, axis=1, kind="stable")[:, :k]
        d, cols = np.take_along_axis(d, nearest, 1), np.take_along_axis(cols, nearest, 1)
        # What was left out on either side is at least as far as the last that was not.
        sure = np.minimum(np.where(lo > 0, part[:, 0] - y[lo, 0], np.inf), np.where(lo + wide < m, y[lo + wide - 1, 0] - part[:, 0], np.inf))
        for i in np.flatnonzero(d[:, -1] > sure).tolist():
            row = np.sqrt(((part[i] - y) ** 2).sum(1))
            some = np.argpartition(row, k - 1)[:k]
            cols[i] = some[np.argsort(row[some], kind="stable")]
            d[i] = row[cols[i]]
        found += [list(zip(*r)) for r in zip(d.tolist(), cols.tolist())]
    return found


def closest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n rows of x a row of its own of m >= n rows of y, so that the sum of the distances is least: augmented() for points.

    Prices are never above 0, so a column is no nearer to a search than its distance says. A search looks at the nearest columns of its rows, and
    as long as nothing else is nearer than the last of these, at no others; searches that need more look at columns that are, along the widest
    axis alone, nearer than a known way to a free one. So the work is that of the neighbourhood where points spread. Memory is n + m.
    Searches start all over the frame in turn: in order, the last would cross all that came before."""
    n, m = len(x), len(y)
    if not n:
        return np.empty(0, int)
    axes = np.argsort(y.min(0) - y.max(0), kind="stable")
    order = np.argsort(y[:, axes[0]], kind="stable")
    # By a power of two, so that no square overflows and no digit is lost.
    scale = np.ldexp(1.0, -int(np.frexp(max(np.abs(x).max(), np.abs(y).max()))[1]))
    x, y = x[:, axes] * scale, np.ascontiguousarray(y[order][:, axes]) * scale
    near, across, points, along, at = at_hand(x, y), np.ascontiguousarray(y.T), x[:, :, None], y[:, 0].tolist(), x[:, 0].tolist()
    u, v, owner, mate = [r[0][0] for r in near], [0.0] * m, [-1] * m, [-1] * n
    for i, r in enumerate(near):
        if owner[r[0][1]] < 0:
            owner[r[0][1]], mate[i] = i, r[0][1]
    # v once more, and infinity where a column is taken.
    prices, taken = np.zeros(m), np.where(np.array(owner) < 0, 0.0, np.inf)
    infinite = float("inf")

    def nearby(start: int) -> tuple | None:
        """The free column that start reaches, how far it is, closed columns and how far, and the rows that columns are reached from; None if those at hand are too few."""
        reach: dict[int, float] = {}
        back: dict[int, int] = {}
        heap: list[tuple[float, int]] = []
        closed, bound, far, i = [], infinite, 0.0, start
        while True:
            base, edges = far - u[i], near[i]
            room = bound - base
            for c, j in edges:
                if c >= room:
                    break
                d = base + c - v[j]
                if d < bound and d < reach.get(j, infinite):
                    reach[j], back[j] = d, i
                    heappush(heap, (d, j))
                    if owner[j] < 0:
                        bound, room = d, d - base
            else:
                if len(edges) < m:
                    # No column that is not at hand is nearer than this.
                    heappush(heap, (base + edges[-1][0], -1))
            far, j = heappop(heap)
            while j < 0 or reach[j] != far:
                if j < 0:
                    return None
                far, j = heappop(heap)
            if owner[j] < 0:
                return j, far, closed, back
            closed.append((j, far))
            reach[j] = -infinite
            i = owner[j]

    def ways(i: int, lo: int, hi: int) -> np.ndarray:
        d = across[:, lo:hi] - points[i]
        d *= d
        way = d[0] + d[1]
        way += d[2]
        np.sqrt(way, out=way)
        way -= prices[lo:hi]
        return way

    def farther(start: int) -> tuple:
        """As nearby(), among all columns."""
        mid, width, bound = bisect_left(along, at[start]), BESIDE, infinite
        while bound == infinite:
            lo, hi = max(0, mid - width), min(m, mid + width)
            bound, width = float((ways(start, lo, hi) + taken[lo:hi]).min()) - u[start], 4 * width
        reach, back, closed, far, i, left, right = np.full(m, np.inf), np.empty(m, int), [], 0.0, start, m, 0
        while True:
            # A little more, so that rounding leaves out no column: coordinates are 1 at most.
            within = bound - far + u[i] + 1e-12
            lo, hi = bisect_left(along, at[i] - within), bisect_right(along, at[i] + within)
            if lo < hi:
                way = ways(i, lo, hi)
                way += far - u[i]
                bound = min(bound, float((way + taken[lo:hi]).min()))
                nearer = way < reach[lo:hi]
                np.copyto(reach[lo:hi], way, where=nearer)
                np.copyto(back[lo:hi], i, where=nearer)
                left, right = min(left, lo), max(right, hi)
            j = left + int(reach[left:right].argmin())
            far = float(reach[j])
            if owner[j] < 0:
                return j, far, closed, back
            closed.append((j, far))
            # A closed column is infinitely far from now on.
            reach[j], prices[j] = np.inf, -np.inf
            i = owner[j]

    for start in np.random.default_rng(0).permutation(n).tolist():
        if mate[start] >= 0:
            continue
        j, far, closed, back = nearby(start) or farther(start)
        for k, d in closed:
            v[k] -= far - d
            prices[k] = v[k]
            u[owner[k]] += far - d
        u[start] += far
        taken[j], i = np.inf, -1
        while i != start:
            i = int(back[j])
            owner[j] = i
            mate[i], j = j, mate[i]
    return order[mate]


GATED, STARS = "frame long, a long, b long, cost double", "frame long, side int, id long, root long"

#: Edges of a frame that a task joins to parts at once.
TOGETHER = 200_000


def runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Where equal keys begin and end in rows sorted by them."""
    if not len(keys[0]):
        return []
    cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys[0])]))


def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """STARS: each end of the edges (frame, a, b), sorted by frame, with the least a of its part; of TOGETHER edges of a frame at a time."""
    root: dict[int, int] = {}
    via: dict[int, int] = {}
    out: list[tuple[int, int, int, int]] = []
    at, n = None, 0

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = a = root[root[a]]
        return a

    def flush() -> None:
        out.extend((at, 0, a, find(a)) for a in root)
        out.extend((at, 1, b, find(a)) for b, a in via.items())
        root.clear()
        via.clear()

    table = lambda: pd.DataFrame(out, columns=["frame", "side", "id", "root"])
    for batch in batches:
        for lo, hi in runs(batch["frame"].to_numpy()):
            frame, n = int(batch["frame"].iat[lo]), n + hi - lo
            if frame != at or n > TOGETHER:
                flush()
                at, n = frame, hi - lo
            for a, b in zip(batch["a"].iloc[lo:hi].tolist(), batch["b"].iloc[lo:hi].tolist()):
                root.setdefault(a, a)
                one, other = find(a), find(via.setdefault(b, a))
                if one != other:
                    root[max(one, other)] = min(one, other)
        if len(out) >= 50_000:
            yield table()
            out.clear()
    flush()
    if out:
        yield table()


def assign_within_gate(edges: DataFrame, limit: float = 1.0) -> DataFrame:
    """(frame, a, b, cost) of the cheapest one-to-one assignment of each frame over its edges below `limit`, those outside a gate costing `limit`.

    Edges that share no end are independent, so Spark cuts frames into connected parts first and each part is solved by itself:
    a task holds a part's edges, not a frame's matrix. Tasks join the edges of a frame, or of pieces of a large one, to stars, which are the
    parts already where no frame is in pieces; and solve many parts, one after the other. edges: frame, a, b, cost. Null costs are no edges."""
    inside = staged(edges.where(F.col("cost") < limit).select("frame", "a", "b", "cost"), "gate-edges")
    n = parts(edges.sparkSession)
    starry = inside.select("frame", "a", "b").repartition(n, "frame").sortWithinPartitions("frame").mapInPandas(stars, STARS)
    vertex = lambda side, c: F.struct(F.col("frame").alias("frame"), side.alias("side"), F.col(c).alias("id"))
    found = components(starry.select(vertex(F.col("side"), "id").alias("u"), vertex(F.lit(0), "root").alias("v")))
    # b's vertex always has a label: a's is smaller.
    of = found.where("u.side = 1").select(F.col("u.frame").alias("frame"), F.col("u.id").alias("b"), F.col("label.id").alias("root"))
    labelled = inside.join(of, ["frame", "b"]).select("frame", "a", "b", "cost", "root")

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        a, b, cost = (rows[c].to_numpy() for c in ("a", "b", "cost"))
        keep = []
        for lo, hi in runs(rows["frame"].to_numpy(), rows["root"].to_numpy()):
            keep += [lo] if hi - lo == 1 else (lo + sparse_assignment(a[lo:hi], b[lo:hi], cost[lo:hi], limit)).tolist()
        return rows.iloc[keep][["frame", "a", "b", "cost"]]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows of the last part wait for the next batch, which may have more of them.
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            last = runs(batch["frame"].to_numpy(), batch["root"].to_numpy())[-1][0]
            if held and last == 0 and tuple(batch[["frame", "root"]].iloc[0]) == tuple(held[-1][["frame", "root"]].iloc[-1]):
                held.append(batch)
                continue
            yield solved(pd.concat([*held, batch.iloc[:last]]))
            held = [batch.iloc[last:]]
        if held:
            yield solved(pd.concat(held))

    return labelled.repartition(n, "frame", "root").sortWithinPartitions("frame", "root", "a", "b").mapInPandas(solve, GATED)


MATCHES = "frame long, pred_id long, gt_id long, dist double"


def match_frames(pred: DataFrame, truth: DataFrame, gate: float = 5000.0) -> DataFrame:
    """(frame, pred_id, gt_id, dist): the assignment is made before the gate is applied, so it may match less than a gated one. Frames are independent.
    An optimum over all pairs never needs them all at once: a task holds the positions of one frame, a few neighbours of each and a row of
    distances. Rows without a position, or an infinite one, have no distance to any and match nothing."""

    def solve(key: tuple, p: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        p, g = p.sort_values("id"), g.sort_values("id")
        few, many = (p, g) if len(p) <= len(g) else (g, p)
        x, y = few[["x", "y", "z"]].to_numpy(float), many[["x", "y", "z"]].to_numpy(float)
        i, j = np.arange(len(x)), closest(x, y)
        d = np.sqrt(((x[i] - y[j]) ** 2).sum(1))
        near = d < gate
        i, j = (i, j) if few is p else (j, i)
        return pd.DataFrame({"frame": key[0], "pred_id": p["id"].to_numpy()[i[near]], "gt_id": g["id"].to_numpy()[j[near]], "dist": d[near]})

    pred, truth = (side.select("frame", "id", "x", "y", "z").where("greatest(abs(x), abs(y), abs(z)) < double('infinity') and x + y + z is not null") for side in (pred, truth))
    n = parts(pred.sparkSession)
    pred, truth = pred.repartition(n, "frame"), truth.withColumnRenamed("frame", "gt_frame").repartition(n, "gt_frame")
    return pred.groupBy("frame").cogroup(truth.groupBy("gt_frame")).applyInPandas(solve, MATCHES)


def frame_counts(pred: DataFrame, truth: DataFrame, matches: DataFrame, switches: DataFrame | None = None) -> DataFrame:
    """frame, n_pred, n_gt, matches, fp, fn, dist_sum, id_switches for every frame that has either. switches: a row for each, with its frame."""
    n = lambda df, name: df.groupBy("frame").agg(F.count("*").alias(name))
    counts = n(pred, "n_pred").join(n(truth, "n_gt"), "frame", "full").join(matches.groupBy("frame").agg(F.count("*").alias("matches"), F.sum("dist").alias("dist_sum")), "frame", "left")
    counts = counts.join(n(switches, "id_switches"), "frame", "left") if switches is not None else counts.withColumn("id_switches", F.lit(0).cast("long"))
    counts = counts.fillna(0)
    return counts.withColumns({"fp": F.col("n_pred") - F.col("matches"), "fn": F.col("n_gt") - F.col("matches")})


def greedy_nearest(tracks: DataFrame, meas: DataFrame, gate: float = 15000.0) -> DataFrame:
    """(frame, track_id, seq): in order of track id each takes its nearest measurement; one already taken leaves the track unmatched."""
    nearest = nearest_in_gate(tracks, meas, gate)
    return nearest.groupBy("frame", "seq").agg(F.min("track_id").alias("track_id")).select("frame", "track_id", "seq")


def nearest_in_gate(tracks: DataFrame, meas: DataFrame, gate: float) -> DataFrame:
    """(frame, track_id, seq, dist): each track's nearest measurement nearer than the gate, ties to the smaller seq. However wide the gate,
    a track meets only the measurements near it."""
    found = nearest_of(tracks.withColumnsRenamed({"frame": "win", "track_id": "seq"}), meas.withColumnRenamed("frame", "win"), gate)
    return found.withColumnsRenamed({"win": "frame", "src": "track_id", "dst": "seq", "d": "dist"})
