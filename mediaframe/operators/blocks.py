"""Block and pixel kernels as column arithmetic, bounded windows and equi-joins.

Small blocks (4x4) live in arrays and stay on their row. Pixel planes are long tables, cut into tiles that carry copies of the pixels
around them; planes are hashed by tile once, so the horizontal and vertical windows of all filters share that one shuffle and
none spans more than a tile, however large the picture.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediaframe import schemas as S
from mediaframe.functions.bits import clip, clip255, int_div
from mediaframe.functions.ordered import row_index

# ------------------------------------------------------------- 4x4 transforms


def _at(name: str, i: int) -> Column:
    return F.get(F.col(name), F.lit(i))


def _butterfly(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column, Column]:
    """Four-point inverse step with the halved odd terms."""
    even0, even1 = a + c, a - c
    odd0, odd1 = F.shiftright(b, 1) - d, b + F.shiftright(d, 1)
    return even0 + odd1, even1 + odd0, even1 - odd0, even0 - odd1


def inverse_transform(df: DataFrame, coeffs: str, out: str = "residual", transposed: bool = False) -> DataFrame:
    """4x4 inverse transform of an integer array (row-major), rounded by (v + 32) >> 6."""
    cols = [_butterfly(*[_at(coeffs, r * 4 + j) for r in range(4)]) for j in range(4)]
    mid = df.withColumn("__m", F.array(*[cols[j][r] for r in range(4) for j in range(4)]))
    rows = [_butterfly(*[_at("__m", r * 4 + j) for j in range(4)]) for r in range(4)]
    natural = mid.withColumn(out, F.array(*[F.shiftright(rows[r][k] + 32, 6) for r in range(4) for k in range(4)])).drop("__m")
    return natural.withColumn(out, transpose4(F.col(out))) if transposed else natural


def transpose4(block: Column) -> Column:
    """4x4 array with rows and columns exchanged."""
    return F.array(*[F.get(block, F.lit(k * 4 + r)) for r in range(4) for k in range(4)])


def luma_dc(df: DataFrame, dc: str, qmul: Column, out: str = "dc_out") -> DataFrame:
    """4x4 Hadamard of the DC values, scaled by (v * qmul + 128) >> 8."""

    def four(a, b, c, d):
        return a + b + c + d, a + b - c - d, a - b - c + d, a - b + c - d

    rows = [four(*[_at(dc, r * 4 + j) for j in range(4)]) for r in range(4)]
    mid = df.withColumn("__m", F.array(*[rows[r][j] for r in range(4) for j in range(4)])).withColumn("__q", qmul.cast("bigint"))
    cols = [four(*[_at("__m", r * 4 + j) for r in range(4)]) for j in range(4)]
    scaled = lambda v: F.shiftright(v.cast("bigint") * F.col("__q") + 128, 8)
    return mid.withColumn(out, F.array(*[scaled(cols[j][r]) for r in range(4) for j in range(4)])).drop("__m", "__q")


def chroma_dc(a: Column, b: Column, c: Column, d: Column, qmul: Column) -> Column:
    """2x2 Hadamard scaled by (v * qmul) >> 7."""
    q = qmul.cast("bigint")
    return F.array(*[F.shiftright(v * q, 7) for v in (a + b + c + d, a - b + c - d, a + b - c - d, a - b - c + d)])


def scatter(df: DataFrame, keys: Sequence[str], block: str, values: str) -> DataFrame:
    """Pixels of numbered 4x4 blocks: 0..15 luma in z-order, 16..19 and 20..23 the two chroma planes, row-major.

    The position tables are constants, so no join is needed.
    """
    lookup = lambda table, i: F.get(F.array(*[F.lit(v) for v in table]), i)
    b = F.col(block).cast("int")
    chroma = b >= 16
    k = (b - 16) % 4
    row = F.when(chroma, F.shiftright(k, 1)).otherwise(lookup(S.LUMA_ROW, b)) * 4
    col = F.when(chroma, k % 2).otherwise(lookup(S.LUMA_COL, b)) * 4
    plane = F.when(chroma, F.shiftright(b - 16, 2) + 1).otherwise(0)
    # the outer form: a plain explode infers a filter on the array and copies the whole transform into it
    e = df.select(*keys, plane.alias("plane"), row.alias("__r"), col.alias("__c"), F.posexplode_outer(values).alias("__i", "v"))
    return e.select(*keys, "plane", (F.col("__r") + F.shiftright("__i", 2)).alias("y"), (F.col("__c") + F.col("__i") % 4).alias("x"), "v")


def dc_order(dc: Column) -> Column:
    """Transformed DC values put into z-order block order."""
    return F.array(*[F.get(dc, F.lit(i)) for i in S.LUMA_DC_FROM])


# ------------------------------------------------------------- pixel filters


def tap6(values: Sequence[Column]) -> Column:
    """Weights 1 -5 20 20 -5 1."""
    a, b, c, d, e, f = values
    return (c + d) * 20 - (b + e) * 5 + (a + f)


def _neighbours(value: str, group: Sequence[str], axis: str, clamp: bool) -> list[Column]:
    """The six values at -2..+3 along an axis; NULL or the edge value outside the plane."""
    w = Window.partitionBy(*group).orderBy(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = []
    for k in range(-2, 4):
        v = F.col(value) if k == 0 else (F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w))
        if clamp and k:
            v = F.coalesce(v, F.first(value).over(whole) if k < 0 else F.last(value).over(whole))
        out.append(v)
    return out


TILE = 64
TILES = ["__ty", "__tx"]
#: pixels a tile sees before and after its own: the filter's taps, and one neighbour of a filtered pixel behind them
BEFORE, AFTER = 2, 4


def in_tiles(px: DataFrame, picture: Sequence[str], size: int | None = None, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """Pixels (picture, y, x, ...) with the tile that works on them: each pixel once as its tile's own (``__own``), and as a copy for the tiles
    within ``before`` and ``after`` pixels. A picture of any size so is many small groups, shuffled once."""
    size = size or TILE

    def tiles(c: str) -> tuple[Column, Column]:
        t = F.floor(F.col(c) / size).cast("int")
        r = F.col(c) - t * size
        return t, F.array_compact(F.array(t, F.when(r >= size - before, t + 1), F.when(r < after, t - 1)))

    (own_y, ys), (own_x, xs) = tiles("y"), tiles("x")
    cut = px.withColumn("__ty", F.explode(ys)).withColumn("__tx", F.explode(xs)).withColumn("__own", (F.col("__ty") == own_y) & (F.col("__tx") == own_x))
    return cut.repartition(*picture, *TILES)


def own(tiled: DataFrame) -> DataFrame:
    """The tiles' own pixels, without the copies."""
    return tiled.where("__own").drop("__own", *TILES)


def _half_pel(p: DataFrame, group: Sequence[str], clamp: bool, value: str = "v") -> DataFrame:
    p = p.withColumn("h_raw", tap6(_neighbours(value, [*group, "y"], "x", clamp)))
    p = p.withColumn("v_raw", tap6(_neighbours(value, [*group, "x"], "y", clamp)))
    rnd = lambda c: clip255(F.shiftright(F.col(c) + 16, 5))
    full = lambda c: F.when(F.col(c).isNotNull(), rnd(c))  # noqa: E731  (least/greatest skip NULL)
    return p.withColumn("half_h", full("h_raw")).withColumn("half_v", full("v_raw"))


def half_pel(px: DataFrame, picture: Sequence[str], clamp: bool = True, value: str = "v") -> DataFrame:
    """Add h_raw, v_raw (filter sums), half_h and half_v; without clamp, pixels too near an edge get NULL."""
    return own(_half_pel(in_tiles(px, picture), [*picture, *TILES], clamp, value))


def _centre(px: DataFrame, group: Sequence[str], clamp: bool, rounded_middle: bool = False) -> DataFrame:
    src = px.withColumn("__s", F.shiftright(F.col("h_raw") + 16, 5) if rounded_middle else F.col("h_raw"))
    raw = src.withColumn("__c", tap6(_neighbours("__s", [*group, "x"], "y", clamp)))
    done = F.shiftright(F.col("__c") + 16, 5) if rounded_middle else F.shiftright(F.col("__c") + 512, 10)
    return raw.withColumn("half_c", F.when(F.col("__c").isNotNull(), clip255(done))).drop("__s", "__c")


def centre(px: DataFrame, picture: Sequence[str], clamp: bool = True, rounded_middle: bool = False) -> DataFrame:
    """Add half_c, the two-stage centre sample; ``px`` comes from half_pel."""
    return own(_centre(in_tiles(px, picture), [*picture, *TILES], clamp, rounded_middle))


PHASE_INPUTS = ("v", "half_h", "half_v", "half_c", "v_right", "v_below", "half_v_right", "half_h_below")


def phase_inputs(px: DataFrame, picture: Sequence[str], clamp: bool = True) -> DataFrame:
    """Everything the 16 quarter-pel phases select from.

    What looks along x comes first, then all that looks along y, so a tile is sorted twice; the vertical filter of a right neighbour runs over ``v_right``.
    """
    group = [*picture, *TILES]
    right, below = Window.partitionBy(*group, "y").orderBy("x"), Window.partitionBy(*group, "x").orderBy("y")

    def near(col: str, w) -> Column:
        nxt = F.lead(col, 1).over(w)
        return F.coalesce(nxt, F.col(col)) if clamp else nxt

    c = _half_pel(in_tiles(px, picture).withColumn("v_right", near("v", right)), group, clamp)
    c = c.withColumn("__vr", tap6(_neighbours("v_right", [*group, "x"], "y", clamp)))
    c = c.withColumn("half_v_right", F.when(F.col("__vr").isNotNull(), clip255(F.shiftright(F.col("__vr") + 16, 5)))).drop("__vr")
    c = _centre(c, group, clamp)
    return own(c.withColumn("v_below", near("v", below)).withColumn("half_h_below", near("half_h", below)))


def quarter_pel(fx: Column, fy: Column) -> Column:
    """Sample for phase (fx, fy) out of the phase_inputs columns."""
    c = F.col
    avg = lambda a, b: F.shiftright(a + b + 1, 1)
    table = {
        (0, 0): c("v"), (1, 0): avg(c("v"), c("half_h")), (2, 0): c("half_h"), (3, 0): avg(c("v_right"), c("half_h")),
        (0, 1): avg(c("v"), c("half_v")), (0, 2): c("half_v"), (0, 3): avg(c("v_below"), c("half_v")),
        (2, 2): c("half_c"), (2, 1): avg(c("half_h"), c("half_c")), (2, 3): avg(c("half_h_below"), c("half_c")),
        (1, 2): avg(c("half_v"), c("half_c")), (3, 2): avg(c("half_v_right"), c("half_c")),
        (1, 1): avg(c("half_h"), c("half_v")), (3, 1): avg(c("half_h"), c("half_v_right")),
        (1, 3): avg(c("half_h_below"), c("half_v")), (3, 3): avg(c("half_h_below"), c("half_v_right")),
    }
    out = F.lit(None)
    for (x, y), v in table.items():
        out = F.when((fx == x) & (fy == y), v).otherwise(out)
    return out


MARGIN_LOW, MARGIN_HIGH = 7, 5


def padded_plane(px: DataFrame, width: int, height: int) -> DataFrame:
    """Plane extended by repeating its edge pixels, so every filter tap of an out-of-plane position exists.

    Farther out all taps read the same edge pixel, so positions clamp to [-4, size + 1].
    """

    def spread(c: str, size: int) -> Column:
        low, high = F.sequence(F.lit(-MARGIN_LOW), F.lit(0)), F.sequence(F.lit(size - 1), F.lit(size - 1 + MARGIN_HIGH))
        v = F.col(c).cast("int")
        return F.explode(F.when(v == 0, low).when(v == size - 1, high).otherwise(F.array(v)))

    rest = [c for c in px.columns if c not in ("x", "y")]
    wide = px.select(*rest, "y", spread("x", width).alias("x"))
    return wide.select(*rest, "x", spread("y", height).alias("y"))


def motion_compensate(px: DataFrame, grid: DataFrame, ref: DataFrame, width: int, height: int, cell: int = 8, picture: Sequence[str] = ("frame",)) -> DataFrame:
    """Predict every pixel of px (picture, y, x) from ref (picture, y, x, v) moved by its cell's quarter-pel vector.

    Two equi-joins: pixel to cell, then pixel to the filtered reference at its moved position.
    """
    picture = list(picture)
    at = px.select(*picture, "y", "x", int_div(F.col("y"), cell).alias("brow"), int_div(F.col("x"), cell).alias("bcol"))
    moved = at.join(grid.select(*picture, "brow", "bcol", "mv_x", "mv_y"), [*picture, "brow", "bcol"])
    source = lambda c, mv, size: clip(F.col(c) + F.shiftright(F.col(mv), 2), -4, size + 1).cast("int")
    moved = moved.select(
        *picture, "y", "x", source("x", "mv_x", width).alias("sx"), source("y", "mv_y", height).alias("sy"),
        F.col("mv_x").bitwiseAND(F.lit(3)).alias("fx"), F.col("mv_y").bitwiseAND(F.lit(3)).alias("fy"),
    )
    # moved so that the margin lies in the picture's first tiles, not in tiles of its own
    plane = padded_plane(ref, width, height).withColumns({c: F.col(c) + MARGIN_LOW for c in ("x", "y")})
    planes = phase_inputs(plane, picture, clamp=False)
    sx, sy = (F.col(c) - MARGIN_LOW for c in ("x", "y"))
    keep = planes.where(sx.between(-4, width + 1) & sy.between(-4, height + 1)).select(*picture, sx.alias("sx"), sy.alias("sy"), *PHASE_INPUTS)
    j = moved.join(keep, [*picture, "sx", "sy"])
    return j.select(*picture, "y", "x", quarter_pel(F.col("fx"), F.col("fy")).alias("pred"))


def bilinear(px: DataFrame, picture: Sequence[str], fx: Column, fy: Column, value: str = "v") -> DataFrame:
    """Eighth-pel bilinear sample; a neighbour outside the plane counts only if its weight is zero, else NULL."""
    group = [*picture, *TILES]
    p = in_tiles(px, picture, before=0, after=1)
    right, below = Window.partitionBy(*group, "y").orderBy("x"), Window.partitionBy(*group, "x").orderBy("y")
    p = p.withColumn("__r", F.lead(value, 1).over(right))
    p = p.withColumn("__b", F.lead(value, 1).over(below)).withColumn("__d", F.lead("__r", 1).over(below))
    term = lambda weight, v: F.when(weight == 0, 0).otherwise(weight * v)
    total = (
        term((8 - fx) * (8 - fy), F.col(value)) + term(fx * (8 - fy), F.col("__r")) + term((8 - fx) * fy, F.col("__b")) + term(fx * fy, F.col("__d"))
    )
    return own(p.withColumn("sample", F.shiftright((total + 32).cast("int"), 6)).drop("__r", "__b", "__d"))


def add_residual(pred: DataFrame, residual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Prediction plus residual, clipped; ``residual`` (keys, r) holds coded pixels only."""
    j = pred.join(residual, list(keys), "left")
    return j.select(*keys, clip255(F.col("pred") + F.coalesce("r", F.lit(0))).alias("v"))


def coded_ids(blocks: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, coeffs: str) -> DataFrame:
    """Blocks with any non-zero coefficient, numbered densely per group; the others are dropped before the shuffle."""
    coded = blocks.where(F.exists(coeffs, lambda v: v != 0))
    return row_index(coded.select(*keys, *order), keys, order, block, "coded_id")


def edge_strength(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges towards the left and upper neighbour: 2 if either side is coded, 1 if the vectors differ, else none.

    ``grid`` has keys, brow, bcol, coded, mv_x, mv_y. Every block offers itself to its right and lower neighbour, so
    both directions share one join.
    """
    offers = F.array(
        F.struct(F.lit("V").alias("edge"), F.col("brow").alias("r"), (F.col("bcol") + 1).alias("c")),
        F.struct(F.lit("H").alias("edge"), (F.col("brow") + 1).alias("r"), F.col("bcol").alias("c")),
    )
    side = grid.select(*keys, F.explode(offers).alias("o"), F.col("coded").alias("n_coded"), F.col("mv_x").alias("n_x"), F.col("mv_y").alias("n_y"))
    side = side.select(*keys, "o.edge", F.col("o.r").alias("brow"), F.col("o.c").alias("bcol"), "n_coded", "n_x", "n_y")
    j = grid.join(side, [*keys, "brow", "bcol"])
    bs = F.when(F.col("coded") | F.col("n_coded"), 2).when((F.col("mv_x") != F.col("n_x")) | (F.col("mv_y") != F.col("n_y")), 1)
    return j.select(*keys, "brow", "bcol", "edge", bs.alias("strength")).where("strength is not null")


# ------------------------------------------------------------- edge smoothing


def _near(w: Column, alpha: Column, beta: Column) -> Column:
    p1, p0, q0, q1 = w[1], w[2], w[3], w[4]
    return (F.abs(p0 - q0) < alpha) & (F.abs(p1 - p0) < beta) & (F.abs(q1 - q0) < beta)


def _delta(w: Column, beta: Column, tc0: Column) -> Column:
    tc = tc0 + F.when(F.abs(w[0] - w[2]) < beta, 1).otherwise(0) + F.when(F.abs(w[5] - w[3]) < beta, 1).otherwise(0)
    return clip(F.shiftright((w[3] - w[2]) * 4 + (w[1] - w[4]) + 4, 3), -tc, tc)


def smooth_edge(window: Column, alpha: Column, beta: Column, tc0: Column) -> Column:
    """(p1, p0, q0, q1) after the conditional filter on one window (p2, p1, p0, q0, q1, q2); tc0 < 0 changes nothing."""

    def outer(side: Column, edge: Column, far: Column) -> Column:
        pull = clip(F.shiftright(far + F.shiftright(window[2] + window[3] + 1, 1), 1) - side, -tc0, tc0)
        return F.when(F.abs(far - edge) < beta, side + pull).otherwise(side)

    d = _delta(window, beta, tc0)
    changed = F.array(
        outer(window[1], window[2], window[0]), clip255(window[2] + d), clip255(window[3] - d), outer(window[4], window[3], window[5])
    )
    return F.when((tc0 >= 0) & _near(window, alpha, beta), changed).otherwise(F.array(window[1], window[2], window[3], window[4]))


def would_change(windows: Column, alpha: Column, beta: Column, tc0: Column) -> Column:
    """True if tc0 > 0 and some window of the edge gets a non-zero correction."""
    return (tc0 > 0) & F.exists(windows, lambda w: _near(w, alpha, beta) & (_delta(w, beta, tc0) != 0))


def first_candidates(edges: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """First edge per group that the filter would really change."""
    hit = edges.where(would_change(F.col("window"), F.col("alpha"), F.col("beta"), F.get("tc0", F.lit(0))))
    return hit.groupBy(*by).agg(F.min(order).alias("first"), F.count("*").alias("candidates"))


# ------------------------------------------------------------- colour


def rgb_limited(y: Column, u: Column, v: Column) -> list[Column]:
    """Studio-range conversion: half added, then truncated, then clipped."""
    yy, uu, vv = y - 16, u - 128, v - 128
    to = lambda e: clip255((e + 0.5).cast("int"))
    return [to(1.164 * yy + 1.596 * vv).alias("r"), to(1.164 * yy - 0.392 * uu - 0.813 * vv).alias("g"), to(1.164 * yy + 2.017 * uu).alias("b")]


def rgb_full(y: Column, u: Column, v: Column) -> list[Column]:
    """Full-range conversion: every product truncated on its own."""
    uu, vv = u - 128, v - 128
    t = lambda f, c: (f * c).cast("int")
    return [
        clip255(y + t(1.402, vv)).alias("r"), clip255(y - t(0.344136, uu) - t(0.714136, vv)).alias("g"), clip255(y + t(1.772, uu)).alias("b")
    ]


def upsample_join(luma: DataFrame, chroma: DataFrame, picture: Sequence[str] = ("frame",)) -> DataFrame:
    """Luma pixels (y, x, v) with their half-resolution chroma (y, x, u, v)."""
    picture = list(picture)
    fine = luma.select(*picture, "y", "x", F.col("v").alias("luma"), int_div(F.col("y"), 2).alias("cy"), int_div(F.col("x"), 2).alias("cx"))
    coarse = chroma.select(*picture, F.col("y").cast("bigint").alias("cy"), F.col("x").cast("bigint").alias("cx"), "u", "v")
    return fine.join(coarse, [*picture, "cy", "cx"]).drop("cy", "cx")


