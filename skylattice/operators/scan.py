"""Ordered folds of tracks of any length as parallel prefix scans, in SQL functions.

A track's rows are cut into pieces of at most PIECE rows: they are dealt to ranges of (track, time) and sorted there, so a long track
is in many tasks. Each piece is folded by itself to a map that can be put after the maps of earlier pieces: affine for the moving
average and the smoother, for the Kalman filter an element of its associative form. A track then has one row for each
piece, whose maps are applied in order. No array holds more than a piece, or the pieces of a track.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^PIECE_BITS rows of a piece at most.
PIECE_BITS = 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Names a value inside a Column expression, so that it is computed once."""
    return F.transform(F.array(value), body)[0]


def pieces(rows: DataFrame, key: str, order: list[str], *values: Column, bits: int = PIECE_BITS) -> DataFrame:
    """(key, piece, m): m holds a piece's rows in order, structs of `order` and values; pieces are numbered in the order of their rows."""
    cut = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("piece", F.shiftright(F.monotonically_increasing_id(), bits))
    return cut.groupBy(key, "piece").agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("m"))


def scanned(cut: DataFrame, key: str, piece: dict[str, Column], start: Callable[[Column], Column], go: Callable[[Column, Column], Column]) -> DataFrame:
    """(key, n, s): piece is what is kept of each; start(piece) is the state after a track's first one, go(state, piece) that after a later one."""
    kept = cut.select(key, F.struct("piece", F.size("m").cast("long").alias("n"), *[c.alias(name) for name, c in piece.items()]).alias("p"))
    ordered = kept.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    return ordered.select(key, n.alias("n"), F.aggregate(F.slice("p", 2, 2**30), start(F.col("p")[0]), go).alias("s"))


def ema(rows: DataFrame, value: str, keep: float = 0.95, key: str = "track_id", order: tuple[str, ...] = ("t_us", "seq"), bits: int = PIECE_BITS) -> DataFrame:
    """(key, n, ema): the exponential moving average, seeded with a track's first value."""
    cut = pieces(rows, key, list(order), F.col(value).cast("double").alias("v"), bits=bits)
    zero = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    rest = F.aggregate(F.slice("m", 2, 2**30), zero, lambda s, r: F.struct((s["a"] * keep).alias("a"), (s["b"] * keep + r["v"] * (1 - keep)).alias("b")))
    go = lambda s, p: p["rest"]["a"] * (s * keep + p["first"] * (1 - keep)) + p["rest"]["b"]
    done = scanned(cut, key, {"first": F.col("m")[0]["v"], "rest": rest}, lambda p: p["rest"]["a"] * p["first"] + p["rest"]["b"], go)
    return done.select(key, "n", F.col("s").alias("ema"))


def smoothed(rows: DataFrame, alpha: float = 0.7, gain: float = 0.2, key: str = "track_id", order: tuple[str, ...] = ("t_us", "seq"), bits: int = PIECE_BITS) -> DataFrame:
    """(key, n, s): the fixed-gain smoother, whose velocity follows the step from the position before its update."""
    cut = pieces(rows, key, list(order), *[F.col(c).cast("double").alias(c) for c in ("x", "y")], bits=bits)

    # x -> a * x + b, and the velocity after the last row as c * x + d. a and c are the same for both axes.
    def after(s: Column, r: Column) -> Column:
        return F.struct(
            (s["a"] * (1 - alpha)).alias("a"), (s["a"] * -gain).alias("c"),
            *[(s[f"b{x}"] * (1 - alpha) + r[x] * alpha).alias(f"b{x}") for x in ("x", "y")], *[((r[x] - s[f"b{x}"]) * gain).alias(f"d{x}") for x in ("x", "y")],
        )

    zero = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("c"), *[F.lit(0.0).alias(f"{n}{x}") for n in "bd" for x in ("x", "y")])
    rest = F.aggregate(F.slice("m", 2, 2**30), zero, after)
    still = lambda p, s: F.struct(*[(p["rest"]["a"] * s[x] + p["rest"][f"b{x}"]).alias(x) for x in ("x", "y")], *[F.when(p["n"] > 1, p["rest"]["c"] * s[x] + p["rest"][f"d{x}"]).otherwise(s[f"v{x}"]).alias(f"v{x}") for x in ("x", "y")])
    first = lambda p: F.struct(*[p["first"][x].alias(x) for x in ("x", "y")], *[F.lit(0.0).alias(f"v{x}") for x in ("x", "y")])
    one = lambda s, p: F.struct(*[(s[x] * (1 - alpha) + p["first"][x] * alpha).alias(x) for x in ("x", "y")], *[((p["first"][x] - s[x]) * gain).alias(f"v{x}") for x in ("x", "y")])
    done = scanned(cut, key, {"first": F.col("m")[0], "rest": rest}, lambda p: let(first(p), lambda s: still(p, s)), lambda s, p: let(one(s, p), lambda t: still(p, t)))
    return done.select(key, "n", "s")


# --- The Kalman filter -----------------------------------------------------------------------------
# What a piece does to any state before it is an element: the mean it leads to is A x + b with covariance C, and its measurements say of x
# what eta and J say (in information form). Axes share A, C and J. Expressions are written as SQL text: some hundred terms as Column
# objects take longer to make than a small table to filter.

AXES = ("x", "y")


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def bound(name: str, value: str, body: str) -> str:
    """let() in text."""
    return f"transform(array({value}), {name} -> {body})[0]"


def advanced(e: str, dt: str, m: str, q: float, r: float) -> str:
    """The element e after a prediction over dt and an update with m: by position, or by velocity too where one is given and not 0."""
    moved = struct(
        t=f"{m}.t", a11=f"{e}.a11 + {dt} * {e}.a21", a12=f"{e}.a12 + {dt} * {e}.a22", a21=f"{e}.a21", a22=f"{e}.a22",
        c11=f"{e}.c11 + 2 * {dt} * {e}.c12 + {dt} * {dt} * {e}.c22 + {q}D", c12=f"{e}.c12 + {dt} * {e}.c22", c22=f"{e}.c22 + {q}D",
        j11=f"{e}.j11", j12=f"{e}.j12", j22=f"{e}.j22", **{f"e{n}{x}": f"{e}.e{n}{x}" for x in AXES for n in "12"},
        **{f"b1{x}": f"{e}.b1{x} + {dt} * {e}.b2{x}" for x in AXES}, **{f"b2{x}": f"{e}.b2{x}" for x in AXES},
    )

    def updated(moving: bool) -> str:
        # Gain k, inverse innovation covariance s, innovations y and w of position and velocity.
        if moving:
            d = f"((p.c11 + {r}D) * (p.c22 + {r}D) - p.c12 * p.c12)"
            gains = {"k11": f"(p.c11 * (p.c22 + {r}D) - p.c12 * p.c12) / {d}", "k12": f"{r}D * p.c12 / {d}", "k22": f"(p.c22 * (p.c11 + {r}D) - p.c12 * p.c12) / {d}"}
            gains |= {"s11": f"(p.c22 + {r}D) / {d}", "s12": f"-p.c12 / {d}", "s22": f"(p.c11 + {r}D) / {d}"}
        else:
            gains = {"k11": f"p.c11 / (p.c11 + {r}D)", "k12": f"p.c12 / (p.c11 + {r}D)", "s11": f"1 / (p.c11 + {r}D)"}
        gains |= {f"y{x}": f"{m}.{x} - p.b1{x}" for x in AXES} | ({f"w{x}": f"{m}.v{x} - p.b2{x}" for x in AXES} if moving else {})
        out = {"t": "p.t"}
        for c in "12":
            out[f"a1{c}"] = f"p.a1{c} - g.k11 * p.a1{c}" + (f" - g.k12 * p.a2{c}" if moving else "")
            out[f"a2{c}"] = f"p.a2{c} - g.k12 * p.a1{c}" + (f" - g.k22 * p.a2{c}" if moving else "")
        out |= {"c11": f"{r}D * g.k11", "c12": f"{r}D * g.k12", "c22": f"{r}D * g.k22"} if moving else {"c11": "(1 - g.k11) * p.c11", "c12": "(1 - g.k11) * p.c12", "c22": "p.c22 - g.k12 * p.c12"}
        sa = lambda r_, c: f"(g.s1{r_} * p.a1{c} + g.s{r_}2 * p.a2{c})" if r_ == "2" else f"(g.s11 * p.a1{c} + g.s12 * p.a2{c})"
        for r_, c in (("1", "1"), ("1", "2"), ("2", "2")):
            out[f"j{r_}{c}"] = f"p.j{r_}{c} + " + (f"p.a1{r_} * {sa('1', c)} + p.a2{r_} * {sa('2', c)}" if moving else f"p.a1{r_} * p.a1{c} * g.s11")
        for x in AXES:
            for c in "12":
                out[f"e{c}{x}"] = f"p.e{c}{x} + " + (f"p.a1{c} * (g.s11 * g.y{x} + g.s12 * g.w{x}) + p.a2{c} * (g.s12 * g.y{x} + g.s22 * g.w{x})" if moving else f"p.a1{c} * g.s11 * g.y{x}")
            out[f"b1{x}"] = f"p.b1{x} + g.k11 * g.y{x}" + (f" + g.k12 * g.w{x}" if moving else "")
            out[f"b2{x}"] = f"p.b2{x} + g.k12 * g.y{x}" + (f" + g.k22 * g.w{x}" if moving else "")
        return bound("g", struct(**gains), struct(**{n: out[n] for n in FIELDS}))

    return bound("p", moved, f"case when {m}.vx != 0 or {m}.vy != 0 then {updated(True)} else {updated(False)} end")


FIELDS = ("t", "a11", "a12", "a21", "a22", "c11", "c12", "c22", "j11", "j12", "j22", *[f"{v}{x}" for x in AXES for v in ("e1", "e2", "b1", "b2")])
NOTHING = {"a11": "1D", "a22": "1D"}  # the element of no rows: what was before stays


def element(t: str, **values: str) -> str:
    return struct(**{n: t if n == "t" else f"cast({values.get(n, '0D')} as double)" for n in FIELDS})


def applied(s: str, e: str) -> str:
    """The state s, an element that nothing before it matters to (A = 0), after the element e."""
    det = f"((1 + {s}.c11 * {e}.j11 + {s}.c12 * {e}.j12) * (1 + {s}.c12 * {e}.j12 + {s}.c22 * {e}.j22) - ({s}.c11 * {e}.j12 + {s}.c12 * {e}.j22) * ({s}.c12 * {e}.j11 + {s}.c22 * {e}.j12))"
    d = struct(
        d11=f"(1 + {s}.c12 * {e}.j12 + {s}.c22 * {e}.j22) / {det}", d12=f"-({s}.c11 * {e}.j12 + {s}.c12 * {e}.j22) / {det}",
        d21=f"-({s}.c12 * {e}.j11 + {s}.c22 * {e}.j12) / {det}", d22=f"(1 + {s}.c11 * {e}.j11 + {s}.c12 * {e}.j12) / {det}",
    )
    g = struct(**{f"g{r}{c}": f"{e}.a{r}1 * d.d1{c} + {e}.a{r}2 * d.d2{c}" for r in "12" for c in "12"})
    out = {"t": f"{e}.t"}
    gc = lambda r, c: f"(g.g{r}1 * {s}.c{'12' if c == '2' else '11'} + g.g{r}2 * {s}.c{'22' if c == '2' else '12'})"
    for r, c in (("1", "1"), ("1", "2"), ("2", "2")):
        out[f"c{r}{c}"] = f"{gc(r, '1')} * {e}.a{c}1 + {gc(r, '2')} * {e}.a{c}2 + {e}.c{r}{c}"
    for x in AXES:
        u1, u2 = f"({s}.b1{x} + {s}.c11 * {e}.e1{x} + {s}.c12 * {e}.e2{x})", f"({s}.b2{x} + {s}.c12 * {e}.e1{x} + {s}.c22 * {e}.e2{x})"
        out |= {f"b{r}{x}": f"g.g{r}1 * {u1} + g.g{r}2 * {u2} + {e}.b{r}{x}" for r in "12"}
    return bound("d", d, bound("g", g, element(out.pop("t"), **out)))


def kalman(rows: DataFrame, p_pos: float, p_vel: float, q: float, r: float, key: str = "track_id", order: tuple[str, ...] = ("t", "seq"), bits: int = PIECE_BITS) -> DataFrame:
    """(key, n, x, y, vx, vy, p_pos): the filter's last state, rows with t, x, y, vx, vy; null velocities count as 0."""
    values = [F.col(c).cast("double").alias(c) for c in ("x", "y")] + [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("vx", "vy")]
    cut = pieces(rows, key, list(order), *values, bits=bits)
    later = lambda s, m: advanced(s, f"greatest({m}.t - {s}.t, 0D)", m, q, r)
    # All rows of a piece but its first, which needs the time of the piece before.
    rest = F.expr(f"aggregate(slice(m, 2, 1073741824), {element('m[0].t', **NOTHING)}, (s, m1) -> {later('s', 'm1')})")
    born = element("p[0].first.t", c11=f"{p_pos}D", c22=f"{p_vel}D", **{f"b1{x}": f"p[0].first.{x}" for x in AXES}, **{f"b2{x}": f"p[0].first.v{x}" for x in AXES})
    kept = cut.select(key, F.struct("piece", F.size("m").cast("long").alias("n"), F.col("m")[0].alias("first"), rest.alias("rest")).alias("p"))
    ordered = kept.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("p"))
    onto = bound("f", later("s", "p1.first"), applied("f", "p1.rest"))
    last = F.expr(f"aggregate(slice(p, 2, 1073741824), {bound('s0', born, applied('s0', 'p[0].rest'))}, (s, p1) -> {onto})")
    n = F.aggregate("p", F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
    done = ordered.select(key, n.alias("n"), last.alias("s"))
    return done.select(key, "n", *[F.col(f"s.{c}").alias(name) for c, name in (("b1x", "x"), ("b1y", "y"), ("b2x", "vx"), ("b2y", "vy"), ("c11", "p_pos"))])
