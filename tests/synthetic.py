"""Synthetic inputs for tests; every value depends only on its own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.functions.bits import clip255, int_div

SEED = 7


def draw(n: int, *parts: Column | str, salt: int) -> Column:
    """Uniform integer in [0, n) keyed by row values."""
    return F.pmod(F.xxhash64(*parts, F.lit(salt), F.lit(SEED)), F.lit(n)).cast("int")


def plane(spark: SparkSession, frames: int, width: int, height: int) -> DataFrame:
    """Ramps that fold back, diagonal stripes and a little noise: frame, y, x, v."""
    i = F.col("id")
    p = spark.range(frames * width * height).select(
        int_div(i, width * height).alias("frame"), int_div(i % (width * height), width).cast("int").alias("y"), (i % width).cast("int").alias("x")
    )
    fold = lambda c, n: F.abs(c % (2 * n) - n)
    ramps = fold(F.col("x") * 3 + F.col("frame"), 90) + fold(F.col("y") * 2, 70)
    stripes = F.when((F.col("x") + 2 * F.col("y")) % 11 < 4, 25).otherwise(0)
    return p.withColumn("v", clip255((40 + ramps + stripes + draw(9, "frame", "y", "x", salt=1)).cast("int")))


def vector_grid(spark: SparkSession, frames: int, width: int, height: int, split_pct: int = 25, reach: int = 40) -> DataFrame:
    """Quarter-pel vectors per 8x8 cell; a share of the 16x16 blocks has its own vector per cell."""
    w, h = width // 8, height // 8
    i = F.col("id")
    g = spark.range(frames * w * h).select(
        int_div(i, w * h).alias("frame"), int_div(i % (w * h), w).cast("int").alias("brow"), (i % w).cast("int").alias("bcol")
    )
    mb = ("frame", F.shiftright("brow", 1), F.shiftright("bcol", 1))
    split = draw(100, *mb, salt=2) < split_pct
    span = 2 * reach + 1
    own = lambda s: F.when(split, draw(span, "frame", "brow", "bcol", salt=s)).otherwise(draw(span, *mb, salt=s)) - reach
    return g.withColumn("mv_x", own(3)).withColumn("mv_y", own(4))


def coded_blocks(spark: SparkSession, frames: int, width: int, height: int, coded_pct: int = 20) -> DataFrame:
    """4x4 blocks with 1..6 low-frequency coefficients in [-200, 200]; only coded blocks are kept."""
    w, h = width // 4, height // 4
    i = F.col("id")
    b = spark.range(frames * w * h).select(
        int_div(i, w * h).alias("frame"), int_div(i % (w * h), w).cast("int").alias("brow"), (i % w).cast("int").alias("bcol")
    )
    b = b.where(draw(100, "frame", "brow", "bcol", salt=5) < coded_pct)
    n = draw(6, "frame", "brow", "bcol", salt=6) + 1
    key = ("frame", "brow", "bcol")

    drawn = F.array(*[
        F.struct((draw(3, *key, salt=10 + k) * 4 + draw(3, *key, salt=20 + k)).alias("pos"), (draw(401, *key, salt=30 + k) - 200).alias("v")) for k in range(6)
    ])
    b = b.select(*key, F.slice(drawn, 1, n).alias("drawn"))
    at = lambda p: F.try_element_at(F.filter("drawn", lambda d: d["pos"] == p), F.lit(-1))["v"]  # noqa: E731  (a later draw wins)
    return b.select(*key, F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.coalesce(at(p), F.lit(0))).alias("c"))


# Wide test values appended to the dense range.
WIDE_VALUES = [-8192, -4096, -2048, -1024, -512, -256, -128, 128, 256, 512, 1024, 2048, 4096, 8192, -1, 0, 1, -2, 2, 32767, -32767]


def edge_values(spark: SparkSession) -> DataFrame:
    """Every integer in [-64, 64] followed by the wide values: i, v (150 rows)."""
    v = F.concat(F.sequence(F.lit(-64), F.lit(64)), F.array(*[F.lit(e) for e in WIDE_VALUES]))
    return spark.range(1).select(F.posexplode(v).alias("i", "v"))
