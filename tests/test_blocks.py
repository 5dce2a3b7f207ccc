"""Pixel kernels against direct evaluation on small synthetic planes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.operators import blocks as B
from mediaframe.operators import diff as D
from tests import synthetic as G

W, H = 32, 16


@pytest.fixture(scope="module")
def plane(spark):
    return G.plane(spark, 2, W, H).cache()


@pytest.fixture(scope="module")
def pixels(plane):
    return {(r.frame, r.x, r.y): r.v for r in plane.collect()}


def clip(v, lo=0, hi=255):
    return max(lo, min(hi, v))


class Plane:
    def __init__(self, px, frame):
        self.px, self.f = px, frame

    def r(self, x, y):
        return self.px[self.f, clip(x, 0, W - 1), clip(y, 0, H - 1)]

    def hraw(self, x, y):
        return sum(w * self.r(x + k, y) for k, w in zip(range(-2, 4), (1, -5, 20, 20, -5, 1)))

    def vraw(self, x, y):
        return sum(w * self.r(x, y + k) for k, w in zip(range(-2, 4), (1, -5, 20, 20, -5, 1)))

    def h(self, x, y):
        return clip((self.hraw(x, y) + 16) >> 5)

    def v(self, x, y):
        return clip((self.vraw(x, y) + 16) >> 5)

    def c(self, x, y):
        return clip((sum(w * self.hraw(x, y + k) for k, w in zip(range(-2, 4), (1, -5, 20, 20, -5, 1))) + 512) >> 10)

    def sample(self, x, y, fx, fy):
        full, half = [], []
        if fx % 2 == 0 and fy % 2 == 0:
            return {(0, 0): self.r, (2, 0): self.h, (0, 2): self.v, (2, 2): self.c}[fx, fy](x, y)
        # nearest two of the full/half grid around the quarter position
        if fy == 0:
            full, half = self.r(x + (fx == 3), y), self.h(x, y)
        elif fx == 0:
            full, half = self.r(x, y + (fy == 3)), self.v(x, y)
        elif fx == 2:
            full, half = self.h(x, y + (fy == 3)), self.c(x, y)
        elif fy == 2:
            full, half = self.v(x + (fx == 3), y), self.c(x, y)
        else:
            full, half = self.h(x, y + (fy == 3)), self.v(x + (fx == 3), y)
        return (full + half + 1) >> 1


def test_motion_compensation_with_far_vectors(spark, plane, pixels):
    grid = G.vector_grid(spark, 2, W, H, split_pct=50, reach=80).cache()
    mv = {(r.frame, r.brow, r.bcol): (r.mv_x, r.mv_y) for r in grid.collect()}
    got = B.motion_compensate(plane.drop("v"), grid, plane, W, H).collect()
    assert len(got) == 2 * W * H
    phases = set()
    for r in got:
        mx, my = mv[r.frame, r.y // 8, r.x // 8]
        phases.add((mx & 3, my & 3))
        assert r.pred == Plane(pixels, r.frame).sample(r.x + (mx >> 2), r.y + (my >> 2), mx & 3, my & 3), (r, mx, my)
    assert len(phases) >= 6


def test_synthetic_frame_bit_exact(spark, plane):
    grid, coded = G.vector_grid(spark, 2, W, H), G.coded_blocks(spark, 2, W, H)
    pred = B.motion_compensate(plane.drop("v"), grid, plane, W, H)
    res = B.inverse_transform(coded, "c").select("frame", "brow", "bcol", F.posexplode_outer("residual").alias("i", "r"))
    res = res.select("frame", (F.col("brow") * 4 + F.shiftright("i", 2)).alias("y"), (F.col("bcol") * 4 + F.col("i") % 4).alias("x"), "r")
    out = B.add_residual(pred, res, ["frame", "y", "x"]).withColumn("plane", F.lit(0))
    again = B.add_residual(pred, res, ["frame", "y", "x"]).withColumn("plane", F.lit(0))
    r = D.tolerance_counts(D.align(out, again), [])
    assert r.first().over_0 == 0 and r.first().total == 2 * W * H


def test_transform_dc_only(spark):
    df = spark.createDataFrame([([64] + [0] * 15,), ([-64 * 3] + [0] * 15,)], "c array<int>")
    assert [set(r.residual) for r in B.inverse_transform(df, "c").collect()] == [{1}, {-3}]
    d = spark.createDataFrame([([16] + [0] * 15,)], "c array<int>")
    assert set(B.luma_dc(d, "c", F.lit(16)).first().dc_out) == {1}


def test_edge_smoothing(spark):
    df = spark.createDataFrame([([100, 100, 100, 104, 104, 104], 20, 10, t) for t in (-1, 0, 2)], "w array<int>, a int, b int, t int")
    out = [r.o for r in df.select(B.smooth_edge(F.col("w"), F.col("a"), F.col("b"), F.col("t")).alias("o"), "t").orderBy("t").collect()]
    assert out == [[100, 100, 104, 104], [100, 102, 102, 104], [101, 102, 102, 103]]


def test_round_trip_of_edge_values(spark):
    v = G.edge_values(spark)
    assert v.count() == 150
    hi, lo = D.split16(F.col("v"))
    assert D.round_trip(v, "v", D.join16(hi, lo), ["i"]).count() == 0
    assert v.where((hi < 0) | (hi > 255) | (lo < 0) | (lo > 255)).count() == 0


def test_generator_shares(spark):
    n = G.coded_blocks(spark, 4, 320, 160)
    total = 4 * 80 * 40
    assert 0.17 * total < n.count() < 0.23 * total
    assert n.where(F.exists("c", lambda c: F.abs(c) > 200)).count() == 0


@pytest.mark.parametrize("size", [4, 7])
def test_any_tile_gives_the_same_samples(spark, plane, monkeypatch, size):
    """Tiles smaller than the picture, and as small as their borders, against one tile for all of it."""
    shifted = plane.select("frame", (F.col("y") - 6).alias("y"), (F.col("x") - 5).alias("x"), "v")

    def results():
        out = []
        for px in (plane, shifted):
            for clamp in (True, False):
                h = B.half_pel(px, ["frame"], clamp)
                out += [h, B.centre(h, ["frame"], clamp), B.centre(h, ["frame"], clamp, rounded_middle=True), B.phase_inputs(px, ["frame"], clamp)]
            out.append(B.bilinear(px, ["frame"], F.col("x") % 8, F.col("y") % 8))
        return [sorted(map(str, df.collect())) for df in out]

    want = results()
    monkeypatch.setattr(B, "TILE", size)
    assert results() == want


def test_a_wide_picture_is_many_groups(spark):
    """A strip as wide as an 8K picture: no group of a filter is larger than a tile and its border."""
    width, height = 7680, 80
    px = spark.range(width * height).select(F.lit(0).alias("frame"), (F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    px = px.withColumn("v", ((F.col("x") * 7 + F.col("y") * 13 + F.col("x") * F.col("y")) % 256).cast("int"))
    tiled = B.in_tiles(px, ["frame"])
    sizes = tiled.groupBy("frame", *B.TILES).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= (B.TILE + B.BEFORE + B.AFTER) ** 2 and sizes[1] >= (width // B.TILE) * 2
    got = np.array(B.phase_inputs(px, ["frame"]).orderBy("y", "x").select("half_h", "half_v", "half_c", "half_v_right", "half_h_below").collect())
    y, x = np.mgrid[0:height, 0:width]
    v = ((x * 7 + y * 13 + x * y) % 256).astype(np.int64)
    tap = lambda a, axis: sum(w * np.take(a, np.clip(np.arange(a.shape[axis]) + k, 0, a.shape[axis] - 1), axis) for k, w in zip(range(-2, 4), (1, -5, 20, 20, -5, 1)))
    half = lambda raw: np.clip((raw + 16) >> 5, 0, 255)
    h, w = half(tap(v, 1)), half(tap(v, 0))
    c = np.clip((tap(tap(v, 1), 0) + 512) >> 10, 0, 255)
    right, below = np.c_[w[:, 1:], w[:, -1:]], np.r_[h[1:], h[-1:]]
    assert (got == np.stack([h.ravel(), w.ravel(), c.ravel(), right.ravel(), below.ravel()], 1)).all()


def test_no_filter_deals_by_picture(spark, plane):
    for df in (B.phase_inputs(plane, ["frame"]), B.bilinear(plane, ["frame"], F.lit(1), F.lit(1))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert len(dealt) == 1 and "__ty" in dealt[0] and "__tx" in dealt[0]


def test_phase_inputs_sort_a_tile_twice(spark, capsys):
    """Also where the plane has a margin: that lies in the tile of the picture."""
    px = spark.createDataFrame([(0, y, x, 3 * x + 5 * y) for y in range(8) for x in range(8)], "frame long, y int, x int, v int")
    B.phase_inputs(px, ["frame"], clamp=False).explain()
    assert capsys.readouterr().out.count("Sort [") == 2
    grid = spark.createDataFrame([(0, r, c, 0, 0) for r in range(2) for c in range(2)], "frame long, brow int, bcol int, mv_x int, mv_y int")
    out = B.motion_compensate(px.drop("v"), grid, px, 8, 8, cell=4)
    assert {(r.y, r.x, r.pred) for r in out.collect()} == {(r.y, r.x, r.v) for r in px.collect()}
