"""Word-stream and trace operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediaframe.functions.bits import bits, int_div, lit_long, u32_hex
from mediaframe.functions.ordered import BLK, by_width, first_k, in_blocks, lag_rows, last_at, next_after, running_sum, with_halo
from mediaframe.functions.reach import reachable
from mediaframe.functions.skew import spread_join

STREAM = ["stream_id"]
FILLER = 0x80000000
# Fixed value: words a submission buffer holds.
CAPACITY = (0x20000 - 0x20) // 4

# Byte address -> register name.
NAMED = {
    0x2090: "VAP_OUT_VTX_FMT_0", 0x2094: "VAP_OUT_VTX_FMT_1", 0x20B0: "VAP_VTE_CNTL", 0x20B4: "VAP_VTX_SIZE",
    0x2140: "VAP_CNTL_STATUS", 0x2150: "VAP_PROG_STREAM_CNTL_0", 0x21E0: "VAP_PROG_STREAM_CNTL_EXT_0", 0x221C: "VAP_CLIP_CNTL",
    0x4008: "GB_ENABLE", 0x4010: "GB_MSPOS0", 0x4014: "GB_MSPOS1", 0x4020: "GB_AA_CONFIG", 0x4100: "TX_INVALTAGS", 0x4104: "TX_ENABLE",
    0x4200: "GA_POINT_S0", 0x4204: "GA_POINT_T0", 0x4208: "GA_POINT_S1", 0x420C: "GA_POINT_T1", 0x421C: "GA_POINT_SIZE",
    0x4250: "GA_US_VECTOR_INDEX", 0x4254: "GA_US_VECTOR_DATA", 0x4258: "GA_COLOR_CONTROL_PS3", 0x4278: "GA_COLOR_CONTROL", 0x4288: "GA_POLY_MODE",
    0x42B8: "SU_CULL_MODE", 0x4300: "RS_COUNT", 0x4304: "RS_INST_COUNT",
    0x43A4: "SC_HYPERZ_EN", 0x43A8: "SC_EDGERULE", 0x43D0: "SC_CLIP_RULE", 0x43E0: "SC_SCISSOR0", 0x43E4: "SC_SCISSOR1", 0x43E8: "SC_SCREENDOOR",
    0x4600: "US_CONFIG", 0x4604: "US_PIXSIZE", 0x4624: "US_FC_CTRL", 0x4630: "US_CODE_ADDR", 0x4634: "US_CODE_RANGE", 0x4638: "US_CODE_OFFSET",
    0x46A4: "US_OUT_FMT_0", 0x46A8: "US_OUT_FMT_1", 0x46AC: "US_OUT_FMT_2", 0x46B0: "US_OUT_FMT_3",
    0x4BC0: "FG_FOG_BLEND", 0x4BD4: "FG_ALPHA_FUNC",
    0x4E00: "RB3D_CCTL", 0x4E04: "RB3D_BLENDCNTL", 0x4E0C: "RB3D_COLOR_CHANNEL_MASK", 0x4E18: "RB3D_ROPCNTL", 0x4E28: "RB3D_COLOROFFSET0",
    0x4E38: "RB3D_COLORPITCH0", 0x4E50: "RB3D_DITHER_CTL",
    0x4F00: "ZB_CNTL", 0x4F04: "ZB_ZSTENCILCNTL", 0x4F10: "ZB_FORMAT", 0x4F1C: "ZB_BW_CNTL", 0x4F20: "ZB_DEPTHOFFSET", 0x4F24: "ZB_DEPTHPITCH",
    0x4F28: "ZB_DEPTHCLEARVALUE", 0x4F54: "ZB_HIZ_PITCH",
}
# Fixed values: (first address, entries, name stem) of numbered register families.
FAMILIES = [
    (0x2150, 8, "VAP_PROG_STREAM_CNTL"), (0x21E0, 8, "VAP_PROG_STREAM_CNTL_EXT"), (0x4074, 16, "RS_IP"), (0x4320, 16, "RS_INST"),
    (0x4400, 16, "TX_FILTER0"), (0x4440, 16, "TX_FILTER1"), (0x4480, 16, "TX_FORMAT0"), (0x44C0, 16, "TX_FORMAT1"), (0x4540, 16, "TX_OFFSET"),
]
# Registers that may hang the chip, registers never allowed, allowed blocks (half-open), allowed opcodes.
HANG_RISK = {0x4118: "GB_PS3_ENABLE", 0x411C: "PS3_VTX_FMT", 0x4120: "PS3_TEX_SOURCE"}
FORBIDDEN = {0x429C: "GA_SOFT_RESET"}
BLOCKS = [(0x2000, 0x2300, "VAP"), (0x4000, 0x4800, "GB/GA/SU/SC/RS/TX/US"), (0x4B00, 0x4C00, "FG"), (0x4E00, 0x4F00, "RB3D"), (0x4F00, 0x5000, "ZB")]
OPCODES = {
    0x10: "NOP", 0x26: "WAIT_FOR_IDLE", 0x28: "3D_DRAW_VBUF", 0x29: "3D_DRAW_IMMD", 0x2A: "3D_DRAW_INDX", 0x2F: "LOAD_VBPNTR",
    0x33: "INDX_BUFFER", 0x34: "3D_DRAW_VBUF_2", 0x35: "3D_DRAW_IMMD_2", 0x36: "3D_DRAW_INDX_2",
}
DRAW_OPCODES = (0x28, 0x29, 0x2A, 0x34, 0x35, 0x36)
# Fixed values: (low, high inclusive, category) of record markers.
MARKERS = [
    (0x02, 0x05, "hyperz block management"), (0x06, 0x15, "texture unbind"), (0x16, 0x16, "texture unbind, second family"), (0x17, 0x17, "reserved"),
    (0x18, 0x19, "texture unbind, second family"), (0x1A, 0x1A, "reserved"), (0x1B, 0x1C, "texture unbind, second family"), (0x1D, 0x1D, "reserved"),
    (0x1E, 0x1F, "texture unbind, second family"), (0x20, 0x20, "reserved"), (0x21, 0x22, "texture unbind, second family"), (0x23, 0x23, "reserved"),
    (0x24, 0x25, "texture unbind, second family"), (0x26, 0x26, "transfer buffer bind"), (0x27, 0x27, "transfer buffer unbind"),
    (0x28, 0x28, "render target and scissor commit"), (0x29, 0x29, "vertex format and pipeline commit"), (0x2A, 0x2A, "render target pair and scissor"),
    (0x2B, 0x2B, "client flush"), (0x2C, 0x2C, "mip scissor intersection"), (0x2F, 0x2F, "hyperz configuration"), (0x30, 0x30, "resolve buffer setup"),
    (0x31, 0x31, "state restore blit"), (0x37, 0x37, "deferred surface offset patch"), (0x38, 0x38, "deferred address fixup"),
    (0x39, 0x39, "range alignment"), (0x3A, 0x3A, "texture release"), (0x3B, 0x3B, "texture attach, alternate"), (0x3D, 0x3D, "surface volatile state"),
    (0x3E, 0x3E, "texture attach"), (0x3F, 0x3F, "texture attach, alternate"), (0x40, 0x40, "texture attach"), (0x41, 0x41, "framebuffer commit"),
    (0x43, 0x43, "texture attach"), (0x44, 0x44, "transfer completion"), (0x45, 0x45, "surface from texture"), (0x46, 0x46, "fast clear"),
]


def register_names() -> list[tuple[int, str]]:
    """Single names first, then the families; a name already given stays."""
    family = {base + 4 * i: f"{stem}_{i}" for base, n, stem in FAMILIES for i in range(n)}
    return sorted({**family, **NAMED}.items())


def register_dim(spark: SparkSession) -> DataFrame:
    """addr, name; a fixed list of under 250 rows."""
    return spark.createDataFrame(register_names(), "addr bigint, name string")


# ------------------------------------------------------------- record walk and packets


def record_walk(words: DataFrame, keys: Sequence[str] = STREAM) -> DataFrame:
    """Records framed by op<<24 | length: one row per record up to and including the length-0 terminator."""
    length = F.col("w").bitwiseAND(lit_long(0xFFFFFF))
    # a terminator leads nowhere: its successor lies beyond every stream
    nxt = F.when(length == 0, lit_long(1 << 60)).otherwise(F.col("dw") + length)
    starts = reachable(words.select(*keys, F.col("dw").alias("pos"), nxt.alias("nxt")), keys).withColumnRenamed("pos", "dw")
    return words.join(starts, [*keys, "dw"]).select(*keys, "dw", bits(F.col("w"), 31, 24).alias("op"), length.alias("len"))


def packets(words: DataFrame) -> DataFrame:
    """Packet headers: stream_id, dw, w, kind, cnt (data words), base, one_reg, op, nxt, complete.

    Only the last header of a stream can overrun it, so completeness is one lookup per stream.
    """
    w = F.col("w")
    kind, cnt = F.shiftright(w, 30), bits(w, 29, 16) + 1
    data = F.when((w == 0) | (kind == 2), 0).when(kind == 1, 2).otherwise(cnt)
    step = words.select("stream_id", "dw", "w", kind.alias("kind"), data.alias("cnt"), (F.col("dw") + 1 + data).alias("nxt"))
    starts = reachable(step.select("stream_id", F.col("dw").alias("pos"), "nxt"), STREAM).withColumnRenamed("pos", "dw")
    n = words.groupBy("stream_id").agg((F.max("dw") + 1).alias("n_words"))
    ends = starts.groupBy("stream_id").agg(F.max("dw").alias("dw")).join(n, "stream_id")
    head = step.join(starts, ["stream_id", "dw"]).join(ends, ["stream_id", "dw"], "left")
    none = F.lit(None).cast("bigint")
    return head.select(
        "stream_id", "dw", "w", "kind", "cnt",
        F.when((F.col("kind") == 0) & (w != 0), bits(w, 12, 0) * 4).otherwise(none).alias("base"),
        F.when((F.col("kind") == 0) & (w != 0), bits(w, 15, 15) == 1).alias("one_reg"),
        F.when(F.col("kind") == 3, bits(w, 15, 8)).otherwise(none).alias("op"),
        "nxt", F.coalesce(F.col("nxt") <= F.col("n_words"), F.lit(True)).alias("complete"),
    )


def register_writes(words: DataFrame, heads: DataFrame) -> DataFrame:
    """One row per register written by a complete packet: stream_id, dw (of the header), ord, addr, value.

    Each data word takes the header before it, so repeated and consecutive addresses need no explode.
    """
    h = heads.select("stream_id", "dw", F.col("dw").alias("h_dw"), F.col("w").alias("h_w"), F.col("complete").alias("h_ok"))
    carried = {"at": F.col("h_dw"), "head": F.col("h_w"), "ok": F.col("h_ok")}
    seen = last_at(words.join(h, ["stream_id", "dw"], "left"), STREAM, ["dw"], by_width("dw"), carried)
    head, k = F.col("head"), F.col("dw") - F.col("at") - 1
    kind = F.shiftright(head, 30)
    data = seen.where((k >= 0) & F.col("ok") & kind.isin(0, 1) & (head != 0))
    type0 = bits(head, 12, 0) * 4 + F.when(bits(head, 15, 15) == 1, 0).otherwise(k * 4)
    type1 = F.when(k == 0, bits(head, 10, 0)).otherwise(bits(head, 21, 11)) * 4
    return data.select("stream_id", F.col("at").alias("dw"), k.alias("ord"), F.when(kind == 0, type0).otherwise(type1).alias("addr"), F.col("w").alias("value"))


def named_writes(writes: DataFrame, dim: DataFrame) -> DataFrame:
    """Add the register name (NULL if unknown); ``dim`` is the fixed register list."""
    return writes.join(F.broadcast(dim), "addr", "left")


def block_of(addr: Column) -> Column:
    """Name of the first block containing the address."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(BLOCKS):
        out = F.when((addr >= lo) & (addr < hi), name).otherwise(out)
    return out


def write_rule(addr: Column, name: Column, allow_hang_risk: bool = False) -> Column:
    """First policy rule a write breaks, NULL if none."""
    forbidden, risky = addr.isin(*FORBIDDEN), addr.isin(*HANG_RISK)
    return (
        F.when(forbidden, "forbidden")
        .when(risky & ~F.lit(allow_hang_risk), "hang_risk")
        .when(block_of(addr).isNull(), "outside_blocks")
        .when(name.isNull() & ~risky, "unconfirmed")
    )


def severity(rule: Column) -> Column:
    return F.when(rule.isin("unconfirmed", "type2_low_bits"), "WARN").otherwise("ERROR")


def findings(words: DataFrame, heads: DataFrame, dim: DataFrame, allow_hang_risk: bool = False) -> DataFrame:
    """stream_id, dw, ord, addr, rule, severity for packet structure and register policy."""
    w, kind = F.col("w"), F.col("kind")
    bad = ~F.col("complete")
    rules = F.array_compact(F.array(
        F.when(w == 0, "zero_header"),
        F.when((kind == 2) & (w != lit_long(FILLER)), "type2_low_bits"),
        F.when((kind == 0) & (w != 0) & bad, "type0_overrun"),
        F.when((kind == 1) & bad, "type1_truncated"),
        F.when((kind == 3) & ~F.col("op").isin(*OPCODES), "opcode_not_allowed"),
        F.when((kind == 3) & bad, "type3_overrun"),
    ))
    none = lambda n: F.lit(None).cast("bigint").alias(n)
    structure = heads.select("stream_id", "dw", none("ord"), none("addr"), F.explode(rules).alias("rule"))
    writes = named_writes(register_writes(words, heads), dim)
    policy = writes.withColumn("rule", write_rule(F.col("addr"), F.col("name"), allow_hang_risk)).where("rule is not null")
    both = structure.unionByName(policy.select("stream_id", "dw", "ord", "addr", "rule"))
    return both.withColumn("severity", severity(F.col("rule")))


def empty_streams(streams: DataFrame, words: DataFrame) -> DataFrame:
    """Declared streams without words."""
    none = lambda n: F.lit(None).cast("bigint").alias(n)
    gone = streams.select("stream_id").join(words.select("stream_id").distinct(), "stream_id", "left_anti")
    return gone.select("stream_id", none("dw"), none("ord"), none("addr"), F.lit("empty_stream").alias("rule"), F.lit("ERROR").alias("severity"))


def last_state(writes: DataFrame) -> DataFrame:
    """Last value of every register per stream."""
    return writes.groupBy("stream_id", "addr").agg(F.max_by("value", F.col("dw") * 32768 + F.col("ord")).alias("value"), F.count("*").alias("writes"))


def distinct_registers(writes: DataFrame) -> DataFrame:
    """Registers written per stream: two-step so a hot stream is split by address."""
    return writes.groupBy("stream_id", "addr").agg(F.lit(1).alias("one")).groupBy("stream_id").agg(F.count("*").alias("n_registers"))


def gate(streams: DataFrame, *finding_tables: DataFrame) -> DataFrame:
    """Per stream: warnings, errors and pass; a stream passes when no layer reports an error."""
    counts = None
    for f in finding_tables:
        c = f.groupBy("stream_id").agg(F.count_if(F.col("severity") == "WARN").alias("warnings"), F.count_if(F.col("severity") == "ERROR").alias("errors"))
        counts = c if counts is None else counts.unionByName(c)
    total = counts.groupBy("stream_id").agg(F.sum("warnings").alias("warnings"), F.sum("errors").alias("errors"))
    r = streams.select("stream_id").join(total, "stream_id", "left").na.fill(0, ["warnings", "errors"])
    return r.withColumn("pass", F.col("errors") == 0)


def unknown_opcodes(heads: DataFrame) -> DataFrame:
    return heads.where((F.col("kind") == 3) & ~F.col("op").isin(*OPCODES)).groupBy("op").agg(F.count("*").alias("n"))


def ordering_hazards(writes: DataFrame, heads: DataFrame, risky: Sequence[int] = (0x411C, 0x4120), draws: Sequence[int] = DRAW_OPCODES, need: int = 2) -> DataFrame:
    """Risky writes followed by fewer than ``need`` further writes before the next draw."""
    none = F.lit(None).cast("bigint")
    ev = writes.select("stream_id", "dw", "ord", "addr").unionByName(
        heads.where((F.col("kind") == 3) & F.col("op").isin(*draws)).select("stream_id", "dw", F.lit(-1).cast("bigint").alias("ord"), none.alias("addr"))
    )
    order = ["dw", "ord"]
    counted = running_sum(in_blocks(ev, by_width("dw")), STREAM, order, None, F.col("addr").isNotNull().cast("bigint"), "n")
    ahead = next_after(counted, STREAM, order, None, {"n_at_draw": F.when(F.col("addr").isNull(), F.col("n"))})
    between = F.col("n_at_draw") - F.col("n")
    return ahead.where(F.col("addr").isin(*risky) & (between < need)).select("stream_id", "dw", "ord", "addr", between.alias("writes_before_draw"))


# ------------------------------------------------------------- stream comparison


def lengths(words: DataFrame) -> DataFrame:
    return words.groupBy("stream_id").agg((F.max("dw") + 1).alias("n_words"))


def padded(words: DataFrame) -> DataFrame:
    """Streams with a filler word added where the length is odd."""
    odd = lengths(words).where(F.col("n_words") % 2 == 1)
    return words.select("stream_id", "dw", "w").unionByName(odd.select("stream_id", F.col("n_words").alias("dw"), lit_long(FILLER).alias("w")))


def streams_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whole-stream equality, joined per word so one long stream spreads out."""
    j = a.select("stream_id", "dw", F.col("w").alias("a")).join(b.select("stream_id", "dw", F.col("w").alias("b")), ["stream_id", "dw"], "full_outer")
    return j.groupBy("stream_id").agg(F.bool_and(F.col("a").eqNullSafe(F.col("b"))).alias("equal"))


def over_capacity(words: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Streams that do not fit the buffer with their framing word."""
    return lengths(words).where(F.col("n_words") + 1 > capacity)


def common_prefix(a: DataFrame, b: DataFrame) -> DataFrame:
    """Length of the common prefix per stream."""
    j = a.select("stream_id", "dw", F.col("w").alias("a")).join(b.select("stream_id", "dw", F.col("w").alias("b")), ["stream_id", "dw"], "full_outer")
    differ = F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("dw")))
    return j.groupBy("stream_id").agg(F.coalesce(differ, F.max("dw") + 1).alias("prefix"))


def insert_words(words: DataFrame, payload: DataFrame, at: DataFrame) -> DataFrame:
    """Insert payload (stream_id, k, w) at ``at`` (stream_id, pos, head_dw) and grow the record header at head_dw."""
    n = payload.groupBy("stream_id").agg(F.count("*").alias("n"))
    plan = at.join(n, "stream_id")
    moved = spread_join(words, plan, "stream_id", "dw").select(
        "stream_id",
        F.when(F.col("dw") >= F.col("pos"), F.col("dw") + F.col("n")).otherwise(F.col("dw")).alias("dw"),
        F.when(F.col("dw") == F.col("head_dw"), F.col("w") + F.col("n")).otherwise(F.col("w")).alias("w"),
    )
    put = spread_join(payload, at, "stream_id", "k").select("stream_id", (F.col("pos") + F.col("k")).alias("dw"), "w")
    return moved.unionByName(put)


def insertion_check(control: DataFrame, injected: DataFrame, payload: DataFrame, at: DataFrame) -> DataFrame:
    """Per stream: equal before the insertion point, payload verbatim, words after it shifted, and the size change beyond it.

    Control, payload and injected words meet on the injected position.
    """
    n = payload.groupBy("stream_id").agg(F.count("*").alias("n"))
    plan = at.select("stream_id", "pos").join(n, "stream_id")
    before = F.col("dw") < F.col("pos")
    want = spread_join(control, plan, "stream_id", "dw").select(
        "stream_id", F.when(before, F.col("dw")).otherwise(F.col("dw") + F.col("n")).alias("dw"), F.col("w").alias("want"),
        F.when(before, "before").otherwise("after").alias("part"),
    ).unionByName(spread_join(payload, at, "stream_id", "k").select("stream_id", (F.col("pos") + F.col("k")).alias("dw"), F.col("w").alias("want"), F.lit("payload").alias("part")))
    j = want.join(injected.select("stream_id", "dw", F.col("w").alias("got")), ["stream_id", "dw"], "full_outer")
    same = F.col("want").eqNullSafe(F.col("got"))
    ok = lambda p: F.coalesce(F.bool_and(F.when(F.col("part") == p, same)), F.lit(True))
    extra = F.col("part").isNull()
    r = j.groupBy("stream_id").agg(
        ok("before").alias("before_ok"), ok("payload").alias("payload_ok"), ok("after").alias("after_ok"),
        F.coalesce(F.bool_and(F.when(extra, F.col("got") == lit_long(FILLER))), F.lit(True)).alias("tail_ok"),
        (F.count_if(F.col("got").isNotNull()) - F.count_if(F.col("want").isNotNull())).alias("size_delta"),
    )
    return r.withColumn("ok", F.col("before_ok") & F.col("payload_ok") & F.col("after_ok") & F.col("tail_ok") & F.col("size_delta").isin(-1, 0, 1))


# ------------------------------------------------------------- programs


def programs(words: DataFrame) -> DataFrame:
    """Program uploads found at any word: stream_id, dw, slot, n. Every word is looked at, not only packet headers."""
    h = with_halo(words.select("stream_id", "dw", "w"), "dw", before=2, after=0)
    win = Window.partitionBy("stream_id", BLK).orderBy("dw")
    near = h.select("stream_id", "dw", "w", "halo", F.lag("w", 1).over(win).alias("w1"), F.lag("w", 2).over(win).alias("w2"))
    low = lambda c: F.col(c).bitwiseAND(lit_long(0xFFFF))
    found = near.where(~F.col("halo") & (low("w") == 0x9095) & (F.shiftright("w", 30) == 0))
    return found.select("stream_id", "dw", F.when(low("w2") == 0x1094, F.col("w1")).alias("slot"), (bits(F.col("w"), 29, 16) + 1).alias("n"))


def program_words(words: DataFrame, progs: DataFrame) -> DataFrame:
    """Data words of every program; a program cut off by the end of the stream keeps what there is."""
    at = progs.select("stream_id", F.col("dw").alias("prog_dw"), "slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
    return at.withColumn("dw", F.col("prog_dw") + 1 + F.col("k")).join(words, ["stream_id", "dw"]).select("stream_id", "prog_dw", "slot", "k", "w")


# Instruction kinds and operation names by code.
KINDS = ["ALU", "OUT", "FC", "TEX"]
RGB_OPS = ["MAD", "DP3", "DP4", "D2A", "MIN", "MAX", "?", "CND", "CMP", "FRC", "SOP", "MDH", "MDV"]
ALPHA_OPS = ["MAD", "DP", "MIN", "MAX", "?", "CND", "CMP", "FRC", "EX2", "LN2", "RCP", "RSQ", "SIN", "COS", "MDH", "MDV"]


def disassemble(words: DataFrame, keys: Sequence[str], k: str = "k") -> DataFrame:
    """Full groups of six words as instructions: kind, operations, write masks, last flag and text."""
    six = words.groupBy(*keys, int_div(F.col(k), 6).alias("ins")).agg(
        *[F.max(F.when(F.col(k) % 6 == i, F.col("w"))).alias(f"i{i}") for i in range(6)], F.count("*").alias("__n")
    ).where("__n = 6").drop("__n")
    pick = lambda names, code: F.get(F.array(*[F.lit(v) for v in names]), code.cast("int"))
    c = F.col("i0")
    kind = pick(KINDS, bits(c, 1, 0))
    alu = bits(c, 1, 0) < 2
    f = six.select(
        *keys, "ins", kind.alias("kind"),
        F.when(alu, pick(RGB_OPS, F.least(bits(F.col("i5"), 3, 0), lit_long(12)))).alias("rgb_op"),
        F.when(alu, pick(ALPHA_OPS, bits(F.col("i4"), 3, 0))).alias("alpha_op"),
        bits(c, 13, 11).alias("wmask_rgb"), bits(c, 14, 14).alias("wmask_a"), bits(c, 17, 15).alias("omask_rgb"), bits(c, 18, 18).alias("omask_a"),
        bits(c, 8, 8).alias("last"), F.array_join(F.array(*[u32_hex(F.col(f"i{i}")) for i in range(6)]), " ").alias("words"),
    )
    text = F.format_string(
        "%s rgb:%s alpha:%s wmask=%x/%x omask=%x/%x last=%d", "kind", "rgb_op", "alpha_op", "wmask_rgb", "wmask_a", "omask_rgb", "omask_a", "last"
    )
    return f.withColumn("text", F.when(F.col("rgb_op").isNotNull(), text).otherwise(F.col("kind")))


# ------------------------------------------------------------- traces


def typed_kind(trace: DataFrame, kind: str, keys: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """Rows of one record kind with their fields as typed columns."""
    get = lambda n, t: F.try_element_at("f", F.lit(n)).cast(t).alias(n)
    return trace.where(F.col("kind") == kind).select(*keys, *[get(n, t) for n, t in fields.items()], "tail")


def histogram(trace: DataFrame, keys: Sequence[str]) -> DataFrame:
    return trace.select(*keys, F.inline("hist"))


def marker_category(op: Column) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(MARKERS):
        out = F.when((op >= lo) & (op <= hi), name).otherwise(out)
    return out


def reconcile_totals(trace: DataFrame) -> DataFrame:
    """Per connection: do the histogram sums match the stated records and words."""
    num = lambda n: F.try_element_at("f", F.lit(n)).cast("bigint")
    part = lambda field: F.aggregate("hist", F.lit(0).cast("bigint"), lambda a, h: a + h[field])
    rows = trace.select(F.try_element_at("f", F.lit("conn")).alias("conn"), num("records").alias("records"), num("words").alias("words"),
                        part("cnt").alias("hist_records"), part("words").alias("hist_words"))
    r = rows.groupBy("conn").agg(*[F.sum(c).alias(c) for c in ("records", "words", "hist_records", "hist_words")])
    return r.withColumn("ok", (F.col("records") == F.col("hist_records")) & (F.col("words") == F.col("hist_words")))


def flush_close_balance(trace: DataFrame) -> DataFrame:
    """Per connection: FLUSH sums against the CLOSE totals."""
    num = lambda n: F.try_element_at("f", F.lit(n)).cast("bigint")
    of = lambda k, n: F.coalesce(F.sum(F.when(F.col("kind") == k, num(n))), F.lit(0))
    r = trace.groupBy(F.try_element_at("f", F.lit("conn")).alias("conn")).agg(
        of("FLUSH", "records").alias("flush_records"), of("CLOSE", "records").alias("close_records"),
        of("FLUSH", "words").alias("flush_words"), of("CLOSE", "words").alias("close_words"),
    )
    return r.withColumn("ok", (F.col("flush_records") == F.col("close_records")) & (F.col("flush_words") == F.col("close_words")))


def sessions(trace: DataFrame, line: str = "line_no") -> DataFrame:
    """One row per OPEN of a connection: first and last line, flushes, closed or not."""
    t = trace.withColumn("conn", F.try_element_at("f", F.lit("conn")))
    s = running_sum(t, ["conn"], [line], by_width(line), (F.col("kind") == "OPEN").cast("bigint"), "session")
    return s.where("session > 0").groupBy("conn", "session").agg(
        F.min(line).alias("first_line"), F.max(line).alias("last_line"), F.count_if(F.col("kind") == "FLUSH").alias("flushes"),
        F.bool_or(F.col("kind") == "CLOSE").alias("closed"),
    )


def dictionary_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Addresses whose name differs or is missing on one side."""
    j = a.select("addr", F.col("name").alias("name_a")).join(b.select("addr", F.col("name").alias("name_b")), "addr", "full_outer")
    state = F.when(F.col("name_a").isNull(), "only_b").when(F.col("name_b").isNull(), "only_a").when(F.col("name_a") != F.col("name_b"), "differs")
    return j.withColumn("state", state).where("state is not null")


def plausibility(link: Column, cur: Column, lim: Column, base: Column, header: Column, n: Column) -> Column:
    """First failing sanity rule of an insertion point, NULL if plausible."""
    return F.coalesce(
        F.when((base == 0) | (link < base + 0x20) | (cur <= link) | (cur >= lim) | (lim - base > 0x100000), "fields"),
        F.when((link.bitwiseAND(F.lit(3)) != 0) | (cur.bitwiseAND(F.lit(3)) != 0), "alignment"),
        F.when((cur - link < 8) | (cur - link > 0x400), "body_size"),
        F.when(header != lit_long(0x2F000000), "header"),
        F.when(cur + (n + 16) * 4 > lim, "room"),
    )


# ------------------------------------------------------------- snapshots and counters


def snapshot_changes(snaps: DataFrame, snap: str = "snap", off: str = "off", value: str = "v") -> DataFrame:
    """Words that differ from the previous snapshot."""
    p = lag_rows(snaps, [off], [snap], by_width(snap), {"prev": F.col(value)})
    return p.where(F.col("prev").isNotNull() & (F.col("prev") != F.col(value)))


def first_changes(changes: DataFrame, snap: str = "snap", off: str = "off", k: int = 24) -> DataFrame:
    return first_k(changes, [snap], [off], k)


def steady_counters(changes: DataFrame, n_snaps: DataFrame, off: str = "off", value: str = "v") -> DataFrame:
    """Offsets that changed at every snapshot by one constant step; ``n_snaps`` is (off, n)."""
    step = F.col(value) - F.col("prev")
    g = changes.groupBy(off).agg(F.count("*").alias("changes"), F.min(step).alias("step"), F.max(step).alias("hi"))
    return g.join(n_snaps, off).where((F.col("changes") == F.col("n") - 1) & (F.col("step") == F.col("hi"))).select(off, "changes", "step")


def change_points(polls: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: str) -> DataFrame:
    """Polls whose value differs from the one before."""
    p = lag_rows(polls, keys, order, block, {"prev": F.col(value)})
    return p.where(F.col("prev").isNotNull() & (F.col("prev") != F.col(value)))


def nonzero(words: DataFrame) -> DataFrame:
    return words.where(F.col("w") != 0)
