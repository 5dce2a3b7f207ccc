"""Macroblock and motion operators.

Everything about one macroblock is decided on its own row (CASE ladders, arrays of partitions), so
routing, partitions and decline reasons need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediaframe import schemas as S
from mediaframe.functions.bits import has_bit, int_div
from mediaframe.functions.lineage import cut_lineage
from mediaframe.functions.ordered import by_width, first_k, last_at, row_index, running_sum, scan
from mediaframe.functions.reach import reachable

# ------------------------------------------------------------- classification


def type_flags(mb_type: Column) -> list[Column]:
    names = {
        "intra4x4": S.INTRA4X4, "intra16x16": S.INTRA16X16, "pcm": S.INTRA_PCM, "p16x16": S.T16X16, "p16x8": S.T16X8,
        "p8x16": S.T8X16, "p8x8": S.T8X8, "list1": S.LIST1, "skip": S.SKIP, "dct8x8": S.DCT8X8,
    }
    return [has_bit(mb_type, m).alias(n) for n, m in names.items()]


def is_intra(mb_type: Column) -> Column:
    return has_bit(mb_type, S.INTRA_ANY)


def route(mb_type: Column, slice_kind: Column, mb_x: Column, mb_y: Column) -> Column:
    """Which path handles a block; skip blocks also carry the 16x16 bit, so the order counts."""
    return (
        F.when(has_bit(mb_type, S.SKIP), "skip")
        .when(has_bit(mb_type, S.T16X16), "p16x16")
        .when(has_bit(mb_type, S.T16X8 | S.T8X16), "p16x8")
        .when(has_bit(mb_type, S.T8X8), "p8x8")
        .when(~has_bit(mb_type, S.INTRA16X16), "not_intra16x16")
        .when(slice_kind == S.SLICE_I, "intra_slice_i")
        .when((mb_x == 0) | (mb_y == 0), "intra_edge")
        .otherwise("intra")
    )


def phase_family(h: Column, v: Column) -> Column:
    """'diag' for the phases that need the two-stage filter, else 'single'."""
    odd = lambda c: (c == 1) | (c == 3)
    diag = ((h == 2) & (v == 2)) | ((v == 2) & odd(h)) | ((h == 2) & odd(v))
    return F.when(diag, "diag").otherwise("single")


def phase_class9(mv_x: Column, mv_y: Column) -> Column:
    """0 full, 1 half-h, 2 half-v, 3 h-only, 4 v-only, 5 both odd, 6 centre, 7 fx half, 8 fy half."""
    fx, fy = mv_x.bitwiseAND(F.lit(3)), mv_y.bitwiseAND(F.lit(3))
    return (
        F.when((fx == 0) & (fy == 0), 0)
        .when((fx == 2) & (fy == 0), 1)
        .when((fx == 0) & (fy == 2), 2)
        .when(fy == 0, 3)
        .when(fx == 0, 4)
        .when((fx % 2 == 1) & (fy % 2 == 1), 5)
        .when((fx == 2) & (fy == 2), 6)
        .when(fx == 2, 7)
        .otherwise(8)
    )


def phase_pattern4(mv_x: Column, mv_y: Column) -> Column:
    """full+halfH, full+halfV, halfH+halfV, half+diagonal; NULL for the phases that average nothing."""
    fx, fy = mv_x.bitwiseAND(F.lit(3)), mv_y.bitwiseAND(F.lit(3))
    ox, oy = fx % 2 == 1, fy % 2 == 1
    return (
        F.when((fy == 0) & ox, "full_h")
        .when((fx == 0) & oy, "full_v")
        .when(ox & oy, "h_v")
        .when(((fx == 2) & oy) | ((fy == 2) & ox), "half_diag")
    )


# ------------------------------------------------------------- partitions


def _parts(*rows: tuple[int, int, int, int, int]) -> Column:
    names = ("n", "x_off", "y_off", "w", "h")
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, r)]) for r in rows])


def partitions(mb_type: Column, sub: Column) -> Column:
    """Array of (n, x_off, y_off, w, h) in decode order; NULL for blocks without motion.

    ``n`` is the z-order index of the partition's first 4x4 block. Quadrant types reuse the whole-block bits.
    """

    def quad(code: Column, q: int) -> Column:
        x, y, n = 8 * (q & 1), 8 * (q >> 1), 4 * q
        return (
            F.when(has_bit(code, S.T16X16), _parts((n, x, y, 8, 8)))
            .when(has_bit(code, S.T16X8), _parts((n, x, y, 8, 4), (n + 2, x, y + 4, 8, 4)))
            .when(has_bit(code, S.T8X16), _parts((n, x, y, 4, 8), (n + 1, x + 4, y, 4, 8)))
            .otherwise(_parts((n, x, y, 4, 4), (n + 1, x + 4, y, 4, 4), (n + 2, x, y + 4, 4, 4), (n + 3, x + 4, y + 4, 4, 4)))
        )

    return (
        F.when(has_bit(mb_type, S.SKIP) | has_bit(mb_type, S.T16X16), _parts((0, 0, 0, 16, 16)))
        .when(has_bit(mb_type, S.T16X8), _parts((0, 0, 0, 16, 8), (8, 0, 8, 16, 8)))
        .when(has_bit(mb_type, S.T8X16), _parts((0, 0, 0, 8, 16), (4, 8, 0, 8, 16)))
        .when(has_bit(mb_type, S.T8X8), F.concat(*[quad(F.get(sub, F.lit(q)), q) for q in range(4)]))
    )


def grid_index(n: Column) -> Column:
    """0-based cell of z-order block n in the padded neighbour grid."""
    return F.get(F.array(*[F.lit(v) for v in S.GRID_INDEX]), n)


def part_vector(mv: Column, ref: Column, n: Column) -> tuple[Column, Column, Column]:
    """Motion vector and reference of partition n from the cached per-cell arrays."""
    i = grid_index(n)
    return F.get(mv, i * 2), F.get(mv, i * 2 + 1), F.get(ref, i)


def absolute(mv: Column, mb: Column, off: Column | int = 0) -> Column:
    """Quarter-pel position in the reference plane."""
    return mv + (mb * 16 + off) * 4


def phase_and_pel(full: Column) -> dict[str, Column]:
    return {
        "phase": full.bitwiseAND(F.lit(3)), "pel": F.shiftright(full, 2),
        "cphase": full.bitwiseAND(F.lit(7)), "cpel": F.shiftright(full, 3),
    }


def luma_inside(full_x: Column, full_y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    """pel - 2 >= 0 and pel + size + 2 < frame on both axes, as bounds on the quarter-pel position."""
    return (full_x >= 8) & (full_y >= 8) & (full_x < (frame_w - w - 2) * 4) & (full_y < (frame_h - h - 2) * 4)


def chroma_inside(full_x: Column, full_y: Column, w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    """pel >= 0 and pel + size + 1 < frame on both axes of the half-size plane, as bounds on its eighth-pel position."""
    room = lambda frame, size: (F.shiftright(frame, 1) - F.shiftright(size, 1) - 1) * 8
    return (full_x >= 0) & (full_y >= 0) & (full_x < room(frame_w, w)) & (full_y < room(frame_h, h))


def explode_partitions(mb: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per partition with its vector, phases, positions, margins and family."""
    def placed(p: Column) -> Column:
        mvx, mvy, ref = part_vector(F.col("mv_l0"), F.col("ref_l0"), p["n"])
        return F.struct(*[p[c].alias(c) for c in ("n", "x_off", "y_off", "w", "h")], mvx.alias("mv_x"), mvy.alias("mv_y"), ref.alias("part_ref"))

    # vectors are looked up before the explode, so the cell arrays are not copied to every partition
    parts = F.transform(partitions(F.col("mb_type"), F.col("sub")), placed)
    p = mb.select(*keys, "mb_x", "mb_y", "mb_width", "mb_height", "base_ref", F.inline(parts))
    p = p.withColumn("full_x", absolute(F.col("mv_x"), F.col("mb_x"), F.col("x_off")))
    p = p.withColumn("full_y", absolute(F.col("mv_y"), F.col("mb_y"), F.col("y_off")))
    px, py = phase_and_pel(F.col("full_x")), phase_and_pel(F.col("full_y"))
    args = (F.col("full_x"), F.col("full_y"), F.col("w"), F.col("h"), F.col("mb_width") * 16, F.col("mb_height") * 16)
    return p.select(
        *keys, "n", "x_off", "y_off", "w", "h", "mv_x", "mv_y", "part_ref",
        px["phase"].alias("h_phase"), py["phase"].alias("v_phase"), px["pel"].alias("pel_x"), py["pel"].alias("pel_y"),
        px["cphase"].alias("ch_phase"), py["cphase"].alias("cv_phase"), px["cpel"].alias("cpel_x"), py["cpel"].alias("cpel_y"),
        (F.col("part_ref") == F.col("base_ref")).alias("ref_agrees"),
        luma_inside(*args).alias("luma_ok"), chroma_inside(*args).alias("chroma_ok"),
        phase_family(px["phase"], py["phase"]).alias("family"),
    )


def refs_agree(mb_type: Column, sub: Column, ref: Column, base_ref: Column) -> Column:
    """True if every partition uses the block's own reference; NULL without motion."""
    return F.forall(partitions(mb_type, sub), lambda p: F.get(ref, grid_index(p["n"])) == base_ref)


def first_part_reason() -> Column:
    """Why the first partition that fails is declined; NULL if all pass, or without motion. All partitions are judged on the block's row."""
    fw, fh = F.col("mb_width") * 16, F.col("mb_height") * 16

    def first(cells: Column) -> Column:
        def place(p: Column) -> Column:
            mx, my, ref = part_vector(cells["mv"], cells["ref"], p["n"])
            ax, ay = absolute(mx, F.col("mb_x"), p["x_off"]), absolute(my, F.col("mb_y"), p["y_off"])
            return F.struct(ref.alias("ref"), ax.alias("x"), ay.alias("y"), p["w"].alias("w"), p["h"].alias("h"))

        def judge(p: Column) -> Column:
            at = (p["x"], p["y"], p["w"], p["h"], fw, fh)
            return F.when(p["ref"] != F.col("base_ref"), "ref_differs").when(~luma_inside(*at), "luma_margin").when(~chroma_inside(*at), "chroma_margin")

        parts = partitions(F.col("mb_type"), F.col("sub"))
        return F.get(F.filter(F.transform(F.transform(parts, place), judge), lambda r: r.isNotNull()), F.lit(0))

    # the cell arrays are bound once a row: a filter on the reason is pushed down with its columns written out, which would build them anew for every partition
    return F.get(F.transform(F.array(F.struct(F.col("mv_l0").alias("mv"), F.col("ref_l0").alias("ref"))), first), F.lit(0))


def outcomes(mb: DataFrame) -> DataFrame:
    """Add route, reason (first failing rule, NULL if none) and taken."""
    t, kind = F.col("mb_type"), F.col("slice")
    fw, fh = F.col("mb_width") * 16, F.col("mb_height") * 16
    dct = F.when(has_bit(t, S.DCT8X8), "dct8x8")
    b_slice = F.when(kind == S.SLICE_B, "b_slice")
    list1 = F.when(has_bit(t, S.LIST1), "list1")
    no_ref = F.when(~F.col("has_ref"), "no_ref")
    fx, fy = absolute(F.col("base_mv_x"), F.col("mb_x")), absolute(F.col("base_mv_y"), F.col("mb_y"))
    sixteen = F.lit(16)
    whole = (
        F.when(~luma_inside(fx, fy, sixteen, sixteen, fw, fh), "luma_margin")
        .when(~chroma_inside(fx, fy, sixteen, sixteen, fw, fh), "chroma_margin")
    )

    reason = (
        F.when(F.col("route") == "skip", F.coalesce(b_slice, list1, no_ref, whole))
        .when(F.col("route") == "p16x16", F.coalesce(dct, b_slice, list1, no_ref, whole))
        .when(F.col("route").isin("p16x8", "p8x8"), F.coalesce(b_slice, list1, dct, no_ref, first_part_reason()))
        .when(F.col("route") != "intra", F.col("route"))
    )
    out = mb.withColumn("route", route(t, kind, F.col("mb_x"), F.col("mb_y"))).withColumn("reason", reason)
    return out.withColumn("taken", F.col("reason").isNull())


def outcome_counts(out: DataFrame, by: Sequence[str] = ("route",)) -> DataFrame:
    return out.groupBy(*by).agg(F.count_if("taken").alias("taken"), F.count_if(~F.col("taken")).alias("declined"))


def shape_census(mb: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inter blocks by shape; 8x8 blocks count once per quadrant."""
    t = F.col("mb_type")
    quad = lambda s: (
        F.when(has_bit(s, S.T16X16), "8x8").when(has_bit(s, S.T16X8), "8x8:8x4").when(has_bit(s, S.T8X16), "8x8:4x8").otherwise("8x8:4x4")
    )
    shapes = (
        F.when(has_bit(t, S.T16X16), F.array(F.lit("16x16")))
        .when(has_bit(t, S.T16X8), F.array(F.lit("16x8")))
        .when(has_bit(t, S.T8X16), F.array(F.lit("8x16")))
        .when(has_bit(t, S.T8X8), F.transform(F.col("sub"), quad))
        .otherwise(F.array(F.lit("other")))
    )
    return mb.where(~is_intra(t)).select(*by, F.explode(shapes).alias("shape")).groupBy(*by, "shape").agg(F.count("*").alias("n"))


# ------------------------------------------------------------- surveys


def survey(mb: DataFrame, order: Sequence[str], k: int = 15) -> DataFrame:
    """First k moving blocks after frame 0, with their phases."""
    m = mb.where((F.col("frame") >= 1) & ((F.col("mv_x") != 0) | (F.col("mv_y") != 0)))
    fx, fy = F.col("mv_x").bitwiseAND(F.lit(3)), F.col("mv_y").bitwiseAND(F.lit(3))
    return m.select(*order, "mb_x", "mb_y", "mb_type", "mv_x", "mv_y", fx.alias("fx"), fy.alias("fy"), "ref").orderBy(*order).limit(k)


def first_per_class(mb: DataFrame, cls: Column, order: Sequence[str], cols: Sequence[str], classes: DataFrame | None = None) -> DataFrame:
    """First row of every class in decode order; with ``classes`` (column cls), absent ones show found = false."""
    got = mb.withColumn("cls", cls).where(F.col("cls").isNotNull()).groupBy("cls").agg(
        F.min_by(F.struct(*order, *cols), F.struct(*order)).alias("r"), F.count("*").alias("n")
    )
    flat = got.select("cls", "n", "r.*")
    if classes is None:
        return flat
    # classes is a fixed list (16 phases at most)
    return F.broadcast(classes).join(flat, "cls", "left").withColumn("found", F.col("n").isNotNull())


def nnz_sum(nnz: Column) -> Column:
    """Sum of coefficient counts, the not-available marker counting nothing."""
    kept = F.filter(nnz, lambda v: v != S.NNZ_UNAVAILABLE)
    return F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, v: a + v)


def reference_groups(req: DataFrame, batch: Sequence[str], order: str, cap: int = S.REFERENCE_MAX) -> DataFrame:
    """Requests per batch, reference and phase family; references beyond the cap (by first use) are flagged, not dropped."""
    fam = req.groupBy(*batch, "ref", "family").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    # a reference number is one signed byte, so a batch has at most 256 of them after the aggregation
    used = fam.withColumn("ref_first", F.min("first").over(Window.partitionBy(*batch, "ref")))
    no = F.dense_rank().over(Window.partitionBy(*batch).orderBy("ref_first", "ref")) - 1
    return used.withColumn("ref_no", no).drop("ref_first").withColumn("within_cap", F.col("ref_no") < cap)


# ------------------------------------------------------------- packing


def capacity_chunks(items: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, width: str, cap: int = S.PACK_WIDTH) -> DataFrame:
    """Next-fit packing in order: add chunk_no and start_col (first column of the item inside its chunk).

    ``width`` is a positive integer. With items laid end to end, the chunk after one starting at s starts at the item
    covering position s + cap, so every item's successor is one as-of lookup and the real starts are a forward walk.
    """
    laid = cut_lineage(running_sum(items, keys, order, block, F.col(width).cast("bigint"), "__s", inclusive=False))
    none = lambda n: F.lit(None).cast("bigint").alias(n)
    spot = laid.select(*keys, (F.col("__s") * 2).alias("at"), F.col("__s").alias("start"), (F.col("__s") + F.col(width)).alias("end"), none("owner"))
    # a probe sorts behind an item starting at the same place
    ask = laid.where(F.col(width) <= cap).select(*keys, ((F.col("__s") + cap) * 2 + 1).alias("at"), none("start"), none("end"), F.col("__s").alias("owner"))
    hits = {"hit_start": F.col("start"), "hit_end": F.col("end")}
    found = last_at(spot.unionByName(ask), keys, ["at"], by_width("at"), hits).where("owner is not null")
    # no item reaches past s + cap: nothing follows, and no item starts at s + cap either
    full = F.col("owner") + cap
    edges = found.select(*keys, F.col("owner").alias("pos"), F.when(F.col("hit_end") > full, F.col("hit_start")).otherwise(full).alias("nxt"))
    alone = laid.where(F.col(width) > cap).select(*keys, F.col("__s").alias("pos"), (F.col("__s") + F.col(width)).alias("nxt"))
    starts = cut_lineage(reachable(cut_lineage(edges.unionByName(alone)), keys))
    # a start is a row of its own in front of its item, so that numbering the chunks shuffles the items once and joins nothing
    empty = [F.lit(None).cast(laid.schema[c].dataType).alias(c) for c in items.columns if c not in keys]
    mark = starts.select(*keys, F.col("pos").alias("__s"), F.lit(0).alias("__own"), *empty)
    begun = scan(
        laid.withColumn("__own", F.lit(1)).unionByName(mark), keys, ["__s", "__own"], by_width("__s"),
        sums={"chunk_no": ((1 - F.col("__own")).cast("bigint"), True)}, last={"__b": (F.when(F.col("__own") == 0, F.col("__s")), False)},
    )
    return begun.where("__own = 1").select(*items.columns, (F.col("chunk_no") - 1).alias("chunk_no"), (F.col("__s") - F.col("__b")).alias("start_col"))


def fixed_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, size: int = S.DC_BATCH_BLOCKS) -> DataFrame:
    """Chunks of a fixed row count: chunk_no and position inside it."""
    i = row_index(df, keys, order, block, "__i")
    return i.select(*df.columns, int_div(F.col("__i"), size).alias("chunk_no"), (F.col("__i") % size).alias("item_no"))


def column_map(chunked: DataFrame, keys: Sequence[str], width: str) -> DataFrame:
    """One row per packed column: item, local x and packed column. ``chunked`` has chunk_no, item_no and start_col."""
    local = F.explode(F.sequence(F.lit(0), F.col(width) - 1)).alias("local_x")
    e = chunked.select(*keys, "chunk_no", "item_no", "start_col", local)
    return e.withColumn("col", F.col("start_col") + F.col("local_x"))


def display_order(frames: DataFrame, keys: Sequence[str], decode: str, is_idr: Column, poc: str) -> DataFrame:
    """Epoch (restarts at every IDR) and display number inside the epoch, by picture order count."""
    ep = running_sum(frames, keys, [decode], by_width(decode), is_idr.cast("bigint"), "epoch")
    return row_index(ep, [*keys, "epoch"], [poc], by_width(poc), "display_no")


# ------------------------------------------------------------- coefficient gating, tracking


def gate_luma(c: Column, mb_type: Column, cbp: Column, nnz: Column) -> Column:
    """Coefficients that count (else zeros); inter blocks carry the +32 rounding in their first value."""
    keep = (is_intra(mb_type) | has_bit(cbp, 15)) & (nnz != 0)
    bias = F.when(is_intra(mb_type), 0).otherwise(32)
    gated = F.when(keep, c).otherwise(F.array_repeat(F.lit(0), 16))
    return F.transform(gated, lambda v, i: F.when(i == 0, v + bias).otherwise(v))


def gate_chroma(c: Column, cbp: Column, nnz: Column, dc: Column) -> Column:
    """AC coefficients that count; the first value is the transformed DC plus 32."""
    gated = F.when(has_bit(cbp, 0x30) & (nnz != 0), c).otherwise(F.array_repeat(F.lit(0), 16))
    return F.transform(gated, lambda v, i: F.when(i == 0, dc + 32).otherwise(v))


def tracked(out: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, cap: int = S.TRACK_MAX) -> DataFrame:
    """Taken blocks numbered per file (``keys``) and route in decode order; those beyond a tracking list of ``cap`` are flagged."""
    numbered = row_index(out.where("taken"), [*keys, "route"], order, block, "track_no")
    return numbered.withColumn("within_cap", F.col("track_no") < cap)
