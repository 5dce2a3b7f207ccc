"""Compare two versions of a pixel table.

A version has frame, plane, y, x, v, or, packed, frame, plane, y, vs (one array per picture row). Packed
rows join on a thousandth of the keys and open up to pixels only after the shuffle, next to the partial
aggregation, so they are the form for large tables. Keys are unique: no frame can overload a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.bits import bits, int_div, lit_long
from mediaframe.functions.ordered import first_k

PIXEL_KEY = ["frame", "plane", "y", "x"]


def align(live: DataFrame, ref: DataFrame, keys: Sequence[str] = PIXEL_KEY) -> DataFrame:
    """Inner join on the key: v_live, v_ref and d = |live - ref|."""
    left = live.select(*keys, F.col("v").alias("v_live"))
    right = ref.select(*keys, F.col("v").alias("v_ref"))
    return left.join(right, list(keys)).withColumn("d", F.abs(F.col("v_live") - F.col("v_ref")))


def pack_rows(px: DataFrame) -> DataFrame:
    """Pixel table to one array per picture row (x = 0..width-1 present); a row is bounded by the picture width."""
    g = px.groupBy("frame", "plane", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("a"))
    return g.select("frame", "plane", "y", F.col("a.v").alias("vs"))


def align_packed(live: DataFrame, ref: DataFrame) -> DataFrame:
    """As ``align``, from packed rows; where one row is shorter, only the common pixels are compared."""
    key = ["frame", "plane", "y"]
    j = live.select(*key, F.col("vs").alias("__l")).join(ref.select(*key, F.col("vs").alias("__r")), key)
    n = F.least(F.size("__l"), F.size("__r"))
    both = F.arrays_zip(F.slice("__l", F.lit(1), n).alias("v_live"), F.slice("__r", F.lit(1), n).alias("v_ref"))
    # outer only to keep the optimizer from filtering on the zipped array twice; rows are never empty
    e = j.where(n > 0).select(*key, F.posexplode_outer(both).alias("x", "p"))
    e = e.select(*key, "x", F.col("p.v_live").alias("v_live"), F.col("p.v_ref").alias("v_ref"))
    return e.withColumn("d", F.abs(F.col("v_live") - F.col("v_ref")))


def missing_keys(live: DataFrame, ref: DataFrame, keys: Sequence[str] = PIXEL_KEY) -> DataFrame:
    """Keys only one version has, with the side that lacks them; one full join finds both directions."""
    a = live.select(*keys, F.lit(True).alias("__l"))
    b = ref.select(*keys, F.lit(True).alias("__r"))
    side = F.when(F.col("__l").isNull(), "live").when(F.col("__r").isNull(), "ref")
    return a.join(b, list(keys), "full_outer").select(*keys, side.alias("missing_in")).where("missing_in is not null")


def frame_counts(live: DataFrame, ref: DataFrame) -> DataFrame:
    """Frames per version, how many are compared, and whether the counts disagree."""
    both = live.select(F.lit("live").alias("version"), "frame").unionByName(ref.select(F.lit("ref").alias("version"), "frame"))
    n = both.distinct().groupBy().agg(
        F.count_if(F.col("version") == "live").alias("n_live"), F.count_if(F.col("version") == "ref").alias("n_ref")
    )
    return n.select("n_live", "n_ref", F.least("n_live", "n_ref").alias("compared"), (F.col("n_live") != F.col("n_ref")).alias("warn"))


def tolerance_counts(diff: DataFrame, by: Sequence[str], tolerances: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Rows, rows beyond each tolerance and the largest difference."""
    over = [F.count_if(F.col("d") > t).alias(f"over_{t}") for t in tolerances]
    return diff.groupBy(*by).agg(F.count("*").alias("total"), *over, F.max("d").alias("max_d"))


def frame_report(diff: DataFrame, tol: int = 2, significant_pct: float = 1.0) -> DataFrame:
    """One row per frame: luma and chroma mismatches, percent of all pixels, significance flag."""
    luma, chroma = F.col("plane") == 0, F.col("plane") > 0
    bad = F.col("d") > tol
    r = diff.groupBy("frame").agg(
        F.count_if(luma & bad).alias("luma_bad"),
        F.count_if(luma).alias("luma_total"),
        F.coalesce(F.max(F.when(luma, F.col("d"))), F.lit(0)).alias("luma_max"),
        F.count_if(chroma & bad).alias("chroma_bad"),
        F.count_if(chroma).alias("chroma_total"),
        F.coalesce(F.max(F.when(chroma, F.col("d"))), F.lit(0)).alias("chroma_max"),
    )
    pct = F.lit(100.0) * (F.col("luma_bad") + F.col("chroma_bad")) / (F.col("luma_total") + F.col("chroma_total"))
    return r.withColumn("pct", pct).withColumn("significant", F.col("pct") >= significant_pct)


def verdict(report: DataFrame) -> DataFrame:
    """Single row: does any frame differ significantly, and the exit status for it."""
    r = report.agg(F.coalesce(F.bool_or("significant"), F.lit(False)).alias("failed"), F.count("*").alias("frames"))
    return r.withColumn("exit_status", F.when(F.col("failed"), 1).otherwise(0))


def _rank() -> Column:
    """Difference and place in one BIGINT, larger for a larger difference and, on ties, for an earlier place.

    Rows and columns take 20 bits each, the plane 2. One number keeps the maximum on hash aggregation; a struct would
    sort every pixel first.
    """
    place = F.col("plane").cast("bigint") * (1 << 40) + F.col("y").cast("bigint") * (1 << 20) + F.col("x")
    fits = F.col("plane").between(0, 3) & F.col("y").between(0, (1 << 20) - 1) & F.col("x").between(0, (1 << 20) - 1) & F.col("d").between(0, (1 << 21) - 1)
    place = F.when(fits, place).otherwise(F.raise_error(F.lit("a pixel's plane, row, column or difference is out of range")))
    return F.col("d").cast("bigint") * (1 << 42) + (lit_long((1 << 42) - 1) - place)


def _unrank(rank: Column) -> list[Column]:
    place = lit_long((1 << 42) - 1) - rank.bitwiseAND(lit_long((1 << 42) - 1))
    return [F.shiftright(rank, 42).alias("max_d"), bits(place, 41, 40).alias("plane"), bits(place, 39, 20).alias("y"), bits(place, 19, 0).alias("x")]


def worst_pixel(diff: DataFrame, by: Sequence[str] = ("frame",)) -> DataFrame:
    """Largest difference per group and where it is; the first in raster order wins a tie."""
    return diff.groupBy(*by).agg(F.max(_rank()).alias("__k")).select(*by, *_unrank(F.col("__k")))


def with_blocks(diff: DataFrame, size: int) -> DataFrame:
    return diff.withColumn("brow", int_div(F.col("y"), size)).withColumn("bcol", int_div(F.col("x"), size))


def drill_down(diff: DataFrame, size: int = 16, tol: int = 2) -> DataFrame:
    """Mismatch counts per block, block row and frame (NULL marks a summed level); only non-zero rows.

    Pixels collapse to blocks first, so the rollup expands block rows rather than pixel rows.
    """
    blocks = with_blocks(diff, size).groupBy("frame", "brow", "bcol").agg(
        F.count_if(F.col("d") > tol).alias("n"), F.max("d").alias("m")
    )
    return (
        blocks.where(F.col("n") > 0)
        .rollup("frame", "brow", "bcol")
        .agg(F.sum("n").alias("n_bad"), F.max("m").alias("max_d"), F.grouping_id().alias("level"))
    )


def block_errors(diff: DataFrame, size: int = 16) -> DataFrame:
    """Total error, worst difference and its pixel per block."""
    g = with_blocks(diff, size).groupBy("frame", "brow", "bcol").agg(F.sum("d").alias("err"), F.max(_rank()).alias("__k"))
    return g.select("frame", "brow", "bcol", "err", *_unrank(F.col("__k")))


def tracked_errors(diff: DataFrame, tracked: DataFrame, size: int = 16) -> DataFrame:
    """Error of every tracked block that has any."""
    e = block_errors(diff.where(F.col("d") > 0), size)
    return e.join(tracked, ["frame", "brow", "bcol"])


def worst_block_per_class(diff: DataFrame, tracked: DataFrame, size: int = 16) -> DataFrame:
    """Tracked block with the largest total error per class; the earliest tracked wins a tie."""
    t = tracked_errors(diff, tracked, size)
    pick = F.max_by(F.struct("frame", "brow", "bcol", "track_no", "err"), F.struct(F.col("err"), -F.col("track_no")))
    r = t.groupBy("class").agg(pick.alias("w"))
    return r.select("class", "w.frame", "w.brow", "w.bcol", "w.track_no", "w.err")


def first_bad_block(diff: DataFrame, tracked: DataFrame, plane: int = 1, min_err: int = 200, size: int = 8) -> DataFrame:
    """Earliest tracked block whose error in one plane exceeds min_err, per frame."""
    t = tracked_errors(diff.where(F.col("plane") == plane), tracked, size).where(F.col("err") > min_err)
    r = t.groupBy("frame").agg(F.min_by(F.struct("brow", "bcol", "track_no", "err"), F.col("track_no")).alias("w"))
    return r.select("frame", "w.brow", "w.bcol", "w.track_no", "w.err")


def origin_block(diff: DataFrame, tracked: DataFrame, plane: int = 1, min_err: int = 8, size: int = 8) -> DataFrame:
    """Earliest tracked block that is wrong itself while the pixels left of, above and above-left of it are right.

    Each wrong pixel on a block's last row or column names the (at most three) blocks it borders; blocks
    named that way have a wrong neighbour and cannot be the origin.
    """
    wrong = with_blocks(diff.where((F.col("plane") == plane) & (F.col("d") > 0)), size)
    last_row, last_col = F.col("y") % size == size - 1, F.col("x") % size == size - 1
    here = lambda dy, dx, cond: F.when(cond, F.struct((F.col("brow") + dy).alias("brow"), (F.col("bcol") + dx).alias("bcol")))
    named = F.array_compact(F.array(here(0, 1, last_col), here(1, 0, last_row), here(1, 1, last_row & last_col)))
    tainted = wrong.where(last_row | last_col).select("frame", F.explode(named).alias("b")).select("frame", "b.brow", "b.bcol").distinct()
    bad = wrong.groupBy("frame", "brow", "bcol").agg(F.sum("d").alias("err")).where(F.col("err") > min_err)
    clean = bad.join(tracked, ["frame", "brow", "bcol"]).join(tainted, ["frame", "brow", "bcol"], "left_anti")
    r = clean.groupBy("frame").agg(F.min_by(F.struct("brow", "bcol", "track_no", "err"), F.col("track_no")).alias("w"))
    return r.select("frame", "w.brow", "w.bcol", "w.track_no", "w.err")


def block_dump(diff: DataFrame, blocks: DataFrame, size: int = 16) -> DataFrame:
    """Live and reference values of the wanted blocks, one row per pixel row."""
    px = with_blocks(diff, size).join(blocks.select("frame", "brow", "bcol"), ["frame", "brow", "bcol"], "left_semi")
    r = px.groupBy("frame", "plane", "brow", "bcol", "y").agg(F.array_sort(F.collect_list(F.struct("x", "v_live", "v_ref"))).alias("r"))
    line = lambda f: F.array_join(F.transform(F.col("r"), lambda s: s[f].cast("string")), " ")
    return r.select("frame", "plane", "brow", "bcol", "y", line("v_live").alias("live"), line("v_ref").alias("ref"))


def mismatch_by_class(diff: DataFrame, grid: DataFrame, phase_class: Column, cell: int = 8) -> DataFrame:
    """Wrong pixels per motion phase class; diff collapses to cells before the join."""
    cells = with_blocks(diff.where(F.col("d") > 0), cell).groupBy("frame", "brow", "bcol").agg(F.count("*").alias("n"))
    joined = cells.join(grid, ["frame", "brow", "bcol"])
    return joined.withColumn("phase_class", phase_class).groupBy("phase_class").agg(F.sum("n").alias("n_bad"))


def coded_split(diff: DataFrame, coded: DataFrame, size: int = 4) -> DataFrame:
    """Wrong and all pixels by coded flag; wrong uncoded pixels by position modulo 8."""
    # one small code per pixel, one array of size * size codes per block: the flag join then moves blocks, not pixels
    code = (F.col("y") % 8) * 16 + (F.col("x") % 8) * 2 + F.when(F.col("d") > 0, 1).otherwise(0)
    blocks = with_blocks(diff, size).groupBy("frame", "brow", "bcol").agg(F.collect_list(code.cast("int")).alias("codes"))
    flags = coded.select("frame", "brow", "bcol").withColumn("coded", F.lit(True))
    j = blocks.join(flags, ["frame", "brow", "bcol"], "left")
    px = j.select(F.coalesce("coded", F.lit(False)).alias("coded"), F.explode("codes").alias("c"))
    pre = px.groupBy("coded", F.shiftright("c", 4).alias("y7"), (F.shiftright("c", 1) % 8).alias("x7")).agg(
        F.count_if(F.col("c") % 2 == 1).alias("nb"), F.count("*").alias("n")
    )
    uncoded_bad = F.sum(F.when(~F.col("coded"), F.col("nb")).otherwise(0))
    return pre.groupingSets([["coded"], ["y7"], ["x7"]], "coded", "y7", "x7").agg(
        F.grouping_id().alias("level"),
        F.sum("nb").alias("n_bad"),
        F.sum("n").alias("n_total"),
        uncoded_bad.alias("n_bad_uncoded"),
    )


def coded_blocks(diff: DataFrame, coded: DataFrame, size: int = 4) -> DataFrame:
    """Wrong pixels per coded block, zero included."""
    px = with_blocks(diff, size).groupBy("frame", "brow", "bcol").agg(F.count_if(F.col("d") > 0).alias("nb"))
    return px.join(coded.select("frame", "brow", "bcol"), ["frame", "brow", "bcol"], "left_semi")


def block_level(diff: DataFrame, coded: DataFrame, size: int = 4) -> DataFrame:
    """Coded blocks with any mismatch, with every pixel wrong, and in total."""
    n = F.col("nb")
    return coded_blocks(diff, coded, size).agg(
        F.count("*").alias("blocks"), F.count_if(n > 0).alias("any_bad"), F.count_if(n == size * size).alias("all_bad")
    )


def position_histogram(diff: DataFrame, coded: DataFrame, size: int = 4) -> DataFrame:
    """Wrong pixels of coded blocks by position inside the block."""
    px = with_blocks(diff.where(F.col("d") > 0), size).join(coded.select("frame", "brow", "bcol"), ["frame", "brow", "bcol"], "left_semi")
    pos = (F.col("y") % size) * size + F.col("x") % size
    return px.groupBy(pos.alias("pos")).agg(F.count("*").alias("n_bad"))


def wrong_block_buckets(blocks: DataFrame, row_bucket: int = 8, col_bucket: int = 32, id_bucket: int = 4000, id_classes: int = 8) -> DataFrame:
    """Where fully wrong blocks lie: counts by block row, block column and dense-id bucket (long form)."""
    parts = F.array(
        F.struct(F.lit("row").alias("kind"), int_div(F.col("brow"), row_bucket).cast("bigint").alias("bucket")),
        F.struct(F.lit("col").alias("kind"), int_div(F.col("bcol"), col_bucket).cast("bigint").alias("bucket")),
        F.struct(F.lit("id").alias("kind"), F.pmod(int_div(F.col("block_id"), id_bucket), F.lit(id_classes)).cast("bigint").alias("bucket")),
    )
    return blocks.select(F.inline(parts)).groupBy("kind", "bucket").agg(F.count("*").alias("n"))


def first_mismatches(diff: DataFrame, k: int = 6) -> DataFrame:
    """First k wrong pixels of every frame in raster order."""
    bad = diff.where(F.col("d") > 0)
    return first_k(bad, ["frame"], ["plane", "y", "x"], k)


def block_totals(diff: DataFrame, size: int = 16) -> DataFrame:
    """Mismatches and worst difference per block, with grand total (NULL keys)."""
    b = with_blocks(diff, size).groupBy("frame", "brow", "bcol").agg(F.count_if(F.col("d") > 0).alias("n"), F.max("d").alias("m"))
    return b.groupingSets([["frame", "brow", "bcol"], []], "frame", "brow", "bcol").agg(F.sum("n").alias("n_bad"), F.max("m").alias("max_d"))


def channel_check(df: DataFrame, expected: Mapping[str, int], tol: int = 0) -> DataFrame:
    """Values per channel column that differ from the expected constant."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(c).cast("bigint").alias("v"), F.lit(e).cast("bigint").alias("want")) for c, e in expected.items()
    ])))
    off = F.abs(F.col("v") - F.col("want"))
    return long.groupBy("channel").agg(
        F.count("*").alias("total"), F.count_if(off > tol).alias("n_bad"), F.max(off).alias("max_off")
    )


def split16(v: Column) -> tuple[Column, Column]:
    """Biased 16-bit code of a signed value as high and low byte."""
    code = v + F.lit(32768)
    return F.shiftright(code, 8), code.bitwiseAND(F.lit(255))


def join16(hi: Column, lo: Column) -> Column:
    return hi * 256 + lo - 32768


def round_trip(df: DataFrame, value: str, decoded: Column, keys: Sequence[str]) -> DataFrame:
    """Rows whose decoded value is not the input."""
    return df.withColumn("decoded", decoded).where(~F.col(value).eqNullSafe(F.col("decoded"))).select(*keys, value, "decoded")


def content_equal(live: DataFrame, ref: DataFrame, by: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Whole-payload equality per group from an order-free hash, without joining rows."""

    def side(df: DataFrame, n: str) -> DataFrame:
        h = F.xxhash64(*payload)
        return df.groupBy(*by).agg(F.bit_xor(h).alias("x" + n), F.sum(h.cast("decimal(20,0)")).alias("s" + n), F.count("*").alias("n" + n))

    j = side(live, "a").join(side(ref, "b"), list(by), "full_outer")
    same = F.col("xa").eqNullSafe(F.col("xb")) & F.col("sa").eqNullSafe(F.col("sb")) & F.col("na").eqNullSafe(F.col("nb"))
    return j.select(*by, same.alias("equal"))


def invariant_breaks(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows present in only one snapshot; empty means nothing changed."""
    n = F.sum("__n")
    both = before.withColumn("__n", F.lit(1)).unionByName(after.withColumn("__n", F.lit(-1)))
    extra = both.groupBy(*[F.col(f"`{c}`") for c in before.columns]).agg(n.alias("__n")).where(F.col("__n") != 0)
    side = F.array_repeat(F.when(F.col("__n") > 0, "before").otherwise("after"), F.abs("__n").cast("int"))
    return extra.select(*[F.col(f"`{c}`") for c in before.columns], F.explode(side).alias("side"))


def parse_tuples(text: Column) -> Column:
    """'r,g,b,a r,g,b,a ...' to an array of integer arrays."""
    return F.transform(F.split(F.trim(text), " +"), lambda t: F.transform(F.split(t, ","), lambda v: v.cast("int")))


def reversed_rgb(before: Column, after: Column) -> Column:
    """True if every pixel of after is before with its first three channels reversed."""
    want = F.transform(before, lambda p: F.concat(F.reverse(F.slice(p, 1, 3)), F.slice(p, 4, 1)))
    return (F.size(before) == F.size(after)) & F.forall(F.zip_with(want, after, lambda a, b: a.eqNullSafe(b)), lambda t: t)


def with_evidence(report: DataFrame, taken: DataFrame) -> DataFrame:
    """Verdict that also fails when nothing was exercised; ``taken`` has a boolean column taken."""
    none = F.lit(None).cast("boolean")
    rows = report.select("significant", none.alias("taken"), F.lit(1).alias("frame"))
    both = rows.unionByName(taken.select(none.alias("significant"), "taken", F.lit(None).cast("int").alias("frame")))
    r = both.agg(F.coalesce(F.bool_or("significant"), F.lit(False)).alias("failed"), F.count("frame").alias("frames"), F.count_if("taken").alias("n_taken"))
    r = r.withColumn("exit_status", F.when(F.col("failed"), 1).otherwise(0))
    return r.withColumn("ok", ~F.col("failed") & (F.col("n_taken") > 0))
