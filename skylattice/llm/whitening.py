"""Whitening of embeddings with eigenvectors from FEAST contour integration.

Vectors become integers floor(scale * x). The fit list has every distinct integer vector once (found by a distributed
aggregation, pre-aggregated before its shuffle). One pass over it gives the sums of all dimensions, a second one the
covariance: vectors are centred by the nearest whole mean before they are multiplied, so products and sums stay integers,
exact up to 2^53 whatever their order, and the rest of the mean is taken off once. Only d sums and d x d products of a
vector length d come to the driver, never vectors.

The covariance's leading eigenvalues are found on the driver by FEAST. Inertia counts (numbers of positive pivots of an LDL^T
factorisation of the shifted covariance, Sylvester's law) are bisected for an interval that holds the wanted eigenvalues and
ends in a gap. A Gauss-Legendre quadrature along a circle around the interval, one complex shifted solve a point, filters a
block of vectors to the interval's eigenvectors; Rayleigh-Ritz extracts them, and this repeats until their residuals are
rounding. The number of Ritz values in the interval must equal the difference of the inertia counts at its ends: none is missed.

Rows whose vector is null or holds null or non-finite entries are dropped. Vectors of other lengths have a fit of their own;
empty vectors have no components. A component whose eigenvalue is zero to double precision (one distinct vector, or fewer
distinct vectors than components) cannot be whitened and has no rows. A deviation beyond 64 bits is null. floor(scale * x) is
clipped to 64 bits. Equal eigenvalues may give any basis of their space. Repeated rows count once in the fit and
come out once each; null ids are kept. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, read_table, staged

SCALE, COMPONENTS = 256, 4
#: Points of the quadrature on the upper half of the contour, rounds of filtering at most.
POINTS, ROUNDS = 8, 40
#: Rows of vectors that a task multiplies at a time.
BLOCK = 4096


# --- The eigenvalues, on a d x d matrix.


def above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix a lie above shift: the positive pivots of LDL^T with complete pivoting."""
    s = a - shift * np.eye(len(a))
    positive = 0
    while len(s):
        off = np.abs(s - np.diag(np.diag(s)))
        i, j = np.unravel_index(off.argmax(), off.shape)
        k = np.abs(np.diag(s)).argmax()
        if off[i, j] == 0 and s[k, k] == 0:
            break
        # A 1 x 1 pivot where the diagonal is large enough, else a 2 x 2 one, which has one eigenvalue of either sign.
        pivot = [k] if abs(s[k, k]) >= 0.6403882032022076 * off[i, j] else [i, j]
        positive += int(s[k, k] > 0) if len(pivot) == 1 else 1
        rest = np.setdiff1d(np.arange(len(s)), pivot)
        side = s[np.ix_(rest, pivot)]
        s = s[np.ix_(rest, rest)] - side @ np.linalg.solve(s[np.ix_(pivot, pivot)], side.T)
    return positive


def edge(a: np.ndarray, count: int, top: float, step: float) -> tuple[float, float]:
    """(low, high), closer than step: more than `count` eigenvalues or just as many lie above low, fewer above high."""
    low, high = -step, top
    while high - low > step:
        middle = (low + high) / 2
        if above(a, middle) >= count:
            low = middle
        else:
            high = middle
    return low, high


def feast(a: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The count eigenvalues of a in (low, high), falling, and their unit eigenvectors as columns."""
    d = len(a)
    x, w = np.polynomial.legendre.leggauss(POINTS)
    angle = np.pi / 2 * (x + 1)
    centre, radius = (low + high) / 2, (high - low) / 2
    shifts, weights = centre + radius * np.exp(1j * angle), w * radius * np.exp(1j * angle) / 2
    # The lower half of the circle gives the conjugates.
    solvers = [np.linalg.inv(z * np.eye(d) - a) for z in shifts]
    block = np.random.default_rng(0).standard_normal((d, min(d, max(count + 8, 2 * count))))
    scale = np.linalg.norm(a, 2) if d < 512 else np.abs(a).sum(0).max()
    best = None
    for _ in range(ROUNDS):
        filtered = sum((weight * (solver @ block)).real for weight, solver in zip(weights, solvers))
        q, _r = np.linalg.qr(filtered)
        values, turned = np.linalg.eigh(q.T @ a @ q)
        block = q @ turned
        inside = np.flatnonzero((values > low) & (values < high))[::-1]
        if len(inside) != count:
            continue
        off = np.linalg.norm(a @ block[:, inside] - block[:, inside] * values[inside], axis=0).max() / scale
        if best is None or off < best[0]:
            best = (off, values[inside], block[:, inside])
        elif off < 1e-13:
            break  # rounding is all that is left
    if best is None:
        raise ArithmeticError("the contour does not settle on the counted eigenvalues")
    return best[1], best[2] / np.linalg.norm(best[2], axis=0)


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the positive semidefinite a that are not zero to double precision, and their unit eigenvectors."""
    d, trace = len(a), float(np.trace(a))
    zero = d * np.finfo(float).eps * trace * 4
    if trace <= 0:
        return np.empty(0), np.empty((d, 0))
    top = trace * (1 + 1e-6) + zero
    nonzero = above(a, zero)
    k, step = min(k, nonzero), trace * 1e-12
    # The interval ends below the k-th eigenvalue, in a gap wide enough to tell its sides apart; a close cluster comes along.
    count, low = k, None
    while low is None:
        lower = edge(a, count, top, step)[0]
        if count == nonzero:
            low = max(lower / 2, zero)
            break
        following = edge(a, count + 1, lower + step, step)[1]
        if lower - following > 1e-9 * trace:
            low = (lower + following) / 2
        else:
            count += 1
    high = edge(a, 1, top, step)[1]
    high += max((high - low) * 0.25, step)
    if above(a, low) - above(a, high) != count:
        raise ArithmeticError("inertia counts disagree")
    values, vectors = feast(a, low, high, count)
    return values[:k], vectors[:, :k]


# --- Passes over the vectors.


@dataclass
class Fit:
    """What a vector length's whitening needs: n vectors, their exact sums, eigenvalues and unit eigenvectors (columns), trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, x) of the usable rows."""
    v = F.col("v")
    usable = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(usable)
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the batch's vectors of one length."""
    lists = batch.column(column)
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)]


def exact_sum(x: np.ndarray) -> list[int]:
    """Sums of columns, as Python's integers where 64 bits could overflow."""
    if len(x) * max(abs(int(x.max())), abs(int(x.min()))) < 2**62:
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


def sums(fit_list: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """dimension -> (vectors, sums)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for rows, x in blocks(batch, "x"):
                n, s = held.get(x.shape[1], (0, [0] * x.shape[1]))
                held[x.shape[1]] = (n + len(rows), [a + b for a, b in zip(s, exact_sum(x))])
        for d, (n, s) in held.items():
            yield pa.RecordBatch.from_pydict({"dim": [d] * d, "n": [n] * d, "at": list(range(d)), "total": [str(v) for v in s]}, schema=pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("at", pa.int32()), ("total", pa.string())]))

    parts = fit_list.select("x").mapInArrow(run, "dim int, n long, at int, total string")
    rows = parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(rows, key=lambda r: (r["dim"], r["at"])):
        found.setdefault(r["dim"], (r["n"], []))[1].append(int(r["total"]))
    return found


def covariances(fit_list: DataFrame, totals: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    centres = {d: [round(s / n) for s in t] for d, (n, t) in totals.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for _rows, x in blocks(batch, "x"):
                d = x.shape[1]
                for k in range(0, len(x), BLOCK):
                    y = x[k : k + BLOCK].astype(float) - np.array(centres[d], float)
                    held[d] = held.get(d, 0) + y.T @ y
        for d, g in held.items():
            for i in range(d):  # a row of the products at a time
                yield pa.RecordBatch.from_pydict({"dim": np.full(d, d, np.int32), "i": np.full(d, i, np.int32), "j": np.arange(d, dtype=np.int32), "g": g[i]})

    table = fit_list.select("x").mapInArrow(run, "dim int, i int, j int, g double").groupBy("dim", "i", "j").agg(F.sum("g").alias("g")).toArrow()
    dim, i, j, g = (table.column(c).to_numpy() for c in ("dim", "i", "j", "g"))
    found = {}
    for d, (n, total) in totals.items():
        own = dim == d
        products = np.zeros((d, d))
        products[i[own], j[own]] = g[own]
        rest = np.array([float(s - n * c) for s, c in zip(total, centres[d])]) / n
        found[d] = products / n - np.outer(rest, rest)
    return found


def fits(fit_list: DataFrame, k: int = COMPONENTS) -> dict[int, Fit]:
    totals = sums(fit_list)
    found = {}
    for d, v in covariances(fit_list, totals).items():
        values, vectors = leading((v + v.T) / 2, k)
        found[d] = Fit(*totals[d], values, vectors, float(np.trace(v)))
    return found


def centred(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, list[int | None]]:
    """x - S/n and sum((n*x - S)^2), which is null beyond 64 bits."""
    most = max(abs(int(x.max())), abs(int(x.min()))) * fit.n + max(map(abs, fit.sums))
    if most < 2**31.5 / np.sqrt(x.shape[1]):
        y = fit.n * x - np.array(fit.sums, np.int64)
        return y / fit.n, (y * y).sum(1).tolist()
    if most < 2**62:
        y = fit.n * x - np.array(fit.sums, np.int64)
        rounded = y / fit.n
        # Halves of 32 bits: high^2 + 2 high low + low^2 with sums that Python adds.
        high, low = y >> 20, y & (1 << 20) - 1
        if np.abs(high).max(initial=0) < 2**25:
            parts = ((high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist())
            exact = [(a << 40) + (b << 21) + c for a, b, c in zip(*parts)]
        else:
            exact = [sum(v * v for v in row) for row in y.tolist()]
    else:
        big = x.astype(object) * fit.n - np.array(fit.sums, dtype=object)
        rounded, exact = (big / fit.n).astype(float), [sum(v * v for v in row) for row in big.tolist()]
    return rounded, [e if e < 2**63 else None for e in exact]


def whitened(rows: DataFrame, by_dim: dict[int, Fit]) -> DataFrame:
    """vec_id, dim, deviation and w, the whitened components, of every row whose length has some."""
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("deviation", pa.int64()), ("w", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in blocks(batch, "x"):
                fit = by_dim[x.shape[1]]
                if not len(fit.values):
                    continue
                y, deviation = centred(x, fit)
                w = y @ fit.vectors / np.sqrt(fit.values)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array(deviation, pa.int64()), lists], schema=schema)

    return rows.mapInArrow(run, "vec_id long, dim int, deviation long, w array<double>")


def identity_errors(fit_list: DataFrame, by_dim: dict[int, Fit]) -> dict[int, float]:
    """dimension -> largest entry of the whitened fit list's covariance less the identity, measured on its vectors."""
    k = max((len(f.values) for f in by_dim.values()), default=0)
    if not k:
        return {}
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    measured = whitened(fit_list.select(F.lit(None).cast("long").alias("vec_id"), "x"), by_dim).groupBy("dim").agg(*[F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs])
    return {r["dim"]: max(abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if r[f"c{i}_{j}"] is not None) for r in measured.collect()}


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each usable row and component."""
    spark = vectors.sparkSession
    rows = integers(vectors, key, vector, scale)
    with arrow_rows(spark, BLOCK):
        fit_list = staged(rows.select("x").distinct(), "whitening-fit")
        by_dim = fits(fit_list, k)
        errors = identity_errors(fit_list, by_dim)
    facts = [(d, c + 1, f.n, float(e / f.trace), errors[d]) for d, f in by_dim.items() for c, e in enumerate(f.values)]
    # A row for each vector length and component.
    known = F.broadcast(spark.createDataFrame(facts, "dim int, component int, n long, explained double, identity_error double"))
    long = whitened(rows, by_dim).select("vec_id", "dim", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return long.join(known, ["dim", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
