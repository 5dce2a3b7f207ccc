"""Scan and sink queries over lines, bytes and tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaframe.functions.bits import u32_hex
from mediaframe.functions.lineage import work_dir
from mediaframe.operators import blocks as B
from mediaframe.operators import diff as D
from mediaframe.plans import fixtures as fx
from mediaframe.plans.blocks_q import edge_rows
from mediaframe.plans.diff_q import FRAME_REPORT
from mediaframe.plans.registry import query
from mediaframe.schemas import EDGE, MB_INFO
from mediaframe.sources import sinks as K
from mediaframe.sources import text as X
from mediaframe.sources.files import read_files, write_files
from mediaframe.sources.records import read_records, write_records


@query("source_binary_scan")
def _(spark, sf):
    """Every table file as bytes; only names and lengths are asked for, so no content is read."""
    f = X.scan_bytes(spark, sf, "*.parquet")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


def _captures(spark, sf):
    """One capture per stream (at most 60 words); some with a wrong magic number, some with stray bytes at the end."""
    w = fx.words(spark, sf).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("dw", u32_hex(F.col("w")).alias("h")))).alias("a"))
    s = F.col("stream_id")
    magic = F.when(s % 13 == 0, "50414331").otherwise("50414330")
    stray = F.when(s % 3 == 0, "abcd").otherwise("")
    u = lambda c: F.lpad(F.hex(c), 8, "0")
    body = F.concat(u(s * 4), u(s * 4 + 32), u(s * 4 + 4096), magic, F.lit("00000000"), F.array_join(F.col("a.h"), ""), stray)
    return w.select(F.concat(F.lit("cap"), s.cast("string")).alias("path"), F.unhex(body).alias("content"))


@query("source_capture_words", "SELECT 'cap'||stream_id AS path, dw, w FROM word WHERE stream_id%13<>0", ["word"])
def _(spark, sf):
    return X.capture_words(_captures(spark, sf))


@query(
    "source_capture_headers",
    "SELECT DISTINCT 'cap'||stream_id AS path, stream_id*4 AS link, stream_id*4+32 AS cursor, stream_id*4+4096 AS \"limit\", stream_id%13<>0 AS ok FROM word",
    ["word"],
)
def _(spark, sf):
    return X.capture_headers(_captures(spark, sf)).select("path", "link", "cursor", "limit", "ok")


@query(
    "source_rejected_captures",
    "SELECT 'cap'||stream_id AS path, 20+4*count(*)+CASE WHEN stream_id%3=0 THEN 2 ELSE 0 END AS bytes, 1346454321::BIGINT AS magic FROM word WHERE stream_id%13=0 GROUP BY stream_id",
    ["word"],
)
def _(spark, sf):
    return X.rejected_captures(_captures(spark, sf))


@query("source_word_list", "SELECT stream_id, dw, w FROM word", ["word"])
def _(spark, sf):
    lines = fx.hex_lines(spark, sf).withColumn("line", F.regexp_replace("line", ",", F.lit(", ")))
    return X.parse_word_list(lines, ["stream_id"])


@query(
    "source_trace_fields",
    "SELECT line_no, 'FLUSH' AS kind, conn::VARCHAR AS conn, records::VARCHAR AS records, words::VARCHAR AS words, 2::BIGINT AS n_hist FROM trc",
    ["trc"],
)
def _(spark, sf):
    t = X.parse_trace(fx.trace_lines(spark, sf), ["line_no"])
    get = lambda n: F.try_element_at("f", F.lit(n)).alias(n)
    return t.select("line_no", "kind", get("conn"), get("records"), get("words"), F.size("hist").alias("n_hist"))


@query(
    "source_frame_lines",
    """SELECT event_id AS line_no, event_id AS frame, trunc(value) AS live_ms, (event_id%50)::DOUBLE AS ref_ms, event_id%17 AS luma_bad, event_id%13 AS luma_max, event_id%3 AS chroma_bad, event_id%10=0 AS significant FROM events""",
)
def _(spark, sf):
    f = X.frame_lines(fx.frame_log_lines(spark, sf), ["line_no"])
    return f.select("line_no", "frame", "live_ms", "ref_ms", "luma_bad", "luma_max", "chroma_bad", "significant")


def _report(spark, sf, form, cols):
    """One report line per event, made from the template and columns of the event number."""
    i = F.col("event_id")
    return fx.table(spark, sf, "events").select(i.alias("line_no"), F.format_string(form, *cols(i)).alias("value"))


@query(
    "source_totals_lines",
    "SELECT event_id AS line_no, event_id%90+1 AS frames, event_id%977+0.5::DOUBLE AS live_total, event_id%31+0.25::DOUBLE AS live_avg, event_id%773+0.5::DOUBLE AS ref_total, event_id%29+0.75::DOUBLE AS ref_avg FROM events",
)
def _(spark, sf):
    form = "Totals over %d frames: live=%d.5ms (%d.25ms/frame avg) ref=%d.5ms (%d.75ms/frame avg)"
    return X.totals_lines(_report(spark, sf, form, lambda i: [i % 90 + 1, i % 977, i % 31, i % 773, i % 29]), ["line_no"])


@query(
    "source_steady_lines",
    "SELECT event_id AS line_no, event_id%401+0.5::DOUBLE AS live_steady, event_id%37+0.25::DOUBLE AS ref_steady, event_id%19+0.5::DOUBLE AS ratio, CASE WHEN event_id%2=0 THEN 'slower' ELSE 'faster' END AS label FROM events",
)
def _(spark, sf):
    form = "Steady-state (excludes frame 0): live=%d.5ms/frame ref=%d.25ms/frame -> GPU is %d.5x %s than CPU"
    return X.steady_lines(_report(spark, sf, form, lambda i: [i % 401, i % 37, i % 19, F.when(i % 2 == 0, "slower").otherwise("faster")]), ["line_no"])


@query("source_budget_lines", "SELECT event_id AS line_no, event_id%50+0.5::DOUBLE AS budget_ms, event_id%60 AS met, event_id%60+3 AS n, (event_id%101)::DOUBLE AS pct FROM events")
def _(spark, sf):
    form = "Real-time check (budget=%d.5ms/frame, assumed 30fps): %d/%d frames (excl. frame 0) met budget (%d%%) - NOT real-time yet"
    return X.budget_lines(_report(spark, sf, form, lambda i: [i % 50, i % 60, i % 60 + 3, i % 101]), ["line_no"]).withColumn("pct", F.col("pct").cast("double"))


_LIVE = ["intra", "skip", "skip_declined", "p16x16", "p16x16_declined", "p16x8", "p16x8_declined", "p8x8", "p8x8_declined", "declined"]


@query("source_live_lines", "SELECT event_id AS line_no, " + ", ".join(f"event_id%{101 + 7 * i} AS {n}" for i, n in enumerate(_LIVE)) + " FROM events")
def _(spark, sf):
    form = "  live totals: %d intra, %d skip (%d declined), %d P_16x16 (%d declined), %d P_16x8/P_8x16 (%d declined), %d P_8x8 (%d declined), %d declined to CPU"
    return X.live_lines(_report(spark, sf, form, lambda i: [i % (101 + 7 * k) for k in range(10)]), ["line_no"])


@query(
    "source_site_calls",
    """SELECT event_id AS line_no, unnest(['pack','upload']) AS site, unnest([event_id%53, event_id%59]) AS calls, unnest([event_id%211+0.5::DOUBLE, event_id%223+0.25::DOUBLE]) AS total_ms FROM events""",
)
def _(spark, sf):
    form = "  dispatch profile: %d calls; pack: %d calls, %d.5ms total (0.31ms/call); upload: %d calls, %d.25ms total (0.59ms/call)"
    return X.site_calls(_report(spark, sf, form, lambda i: [i, i % 53, i % 211, i % 59, i % 223]), ["line_no"])


@query("source_site_cpu", "SELECT event_id AS line_no, unnest(['pack','upload']) AS site, unnest([event_id%53+0.5::DOUBLE, event_id%59+0.25::DOUBLE]) AS cpu_ms FROM events")
def _(spark, sf):
    form = "  CPU-time breakdown: pack cpu=%d.5ms (67%% of its wall); upload cpu=%d.25ms (75%% of its wall)"
    return X.site_cpu(_report(spark, sf, form, lambda i: [i % 53, i % 59]), ["line_no"])


@query(
    "source_phase_costs",
    "SELECT event_id AS line_no, unnest(['draw','read+wait']) AS phase, unnest([event_id%53+0.5::DOUBLE, event_id%59+0.25::DOUBLE]) AS wall_ms, unnest([event_id%47+0.5::DOUBLE, event_id%43+0.75::DOUBLE]) AS cpu_ms FROM events",
)
def _(spark, sf):
    form = "  phase breakdown: draw wall=%d.5ms cpu=%d.5ms; read+wait wall=%d.25ms cpu=%d.75ms"
    return X.phase_costs(_report(spark, sf, form, lambda i: [i % 53, i % 47, i % 59, i % 43]), ["line_no"])


@query(
    "source_cache_lines",
    "SELECT event_id AS line_no, event_id%5003 AS hits, event_id%17+0.5::DOUBLE AS hit_ms, event_id%13+0.5::DOUBLE AS hit_cpu_ms, event_id%61 AS misses, event_id%89+0.5::DOUBLE AS miss_ms, event_id%83+0.5::DOUBLE AS miss_cpu_ms FROM events",
)
def _(spark, sf):
    form = "  reference cache: %d hits (wall=%d.5ms cpu=%d.5ms, 0.003ms/hit); %d misses (wall=%d.5ms cpu=%d.5ms, 2.23ms/miss)"
    return X.cache_lines(_report(spark, sf, form, lambda i: [i % 5003, i % 17, i % 13, i % 61, i % 89, i % 83]), ["line_no"])


_CENSUS = ["p16x16", "p16x8", "p8x16", "p8x8", "p8x8_8x4", "p8x8_4x8", "p8x8_4x4", "other"]


@query("source_census_lines", "SELECT event_id AS line_no, " + ", ".join(f"event_id%{11 + 4 * i} AS {n}" for i, n in enumerate(_CENSUS)) + " FROM events")
def _(spark, sf):
    form = "PART CENSUS: 16x16=%d 16x8=%d 8x16=%d 8x8(whole)=%d 8x8(8x4)=%d 8x8(4x8)=%d 8x8(4x4)=%d other=%d"
    return X.census_lines(_report(spark, sf, form, lambda i: [i % (11 + 4 * k) for k in range(8)]), ["line_no"])


@query(
    "source_step_log",
    """SELECT o_orderkey AS k, 'step'||o_orderkey%5 AS tag, printf('0x%x', o_orderkey) AS addr, o_custkey::VARCHAR AS size, printf('0x%x', o_orderkey+16) AS cursor_base, o_orderkey%7 AS last_try,
       2::BIGINT AS n_words, (o_orderkey*3)%4294967296 AS word1 FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    # compound keys, and one key with several values in a line
    line = F.format_string("[step%d] map: addr=0x%x size=%d (link-base=0x%x cursor-base=0x%x) try=%d try=%d words: %08x %08x",
                           k % 5, k, F.col("o_custkey"), k, k + 16, k % 3, k % 7, k, F.pmod(k * 3, F.lit(4294967296)))
    t = X.parse_step_log(fx.table(spark, sf, "orders").select(k.alias("k"), line.alias("value")), ["k"])
    get = lambda n: F.try_element_at("f", F.lit(n)).alias(n)
    more = [F.try_element_at("f", F.lit("cursor-base")).alias("cursor_base"), F.try_element_at("f", F.lit("try")).cast("bigint").alias("last_try")]
    return t.select("k", "tag", get("addr"), get("size"), *more, F.size("words").alias("n_words"), F.get("words", F.lit(1)).alias("word1"))


@query(
    "source_frame_boundaries",
    "SELECT event_id AS line_no, event_id AS decode_no, event_id%16 AS frame_num, event_id*2-5 AS poc, event_id%3+1 AS slice_type FROM events",
)
def _(spark, sf):
    i = F.col("event_id")
    line = F.format_string("FRAME BOUNDARY: dbg_frameno=%d frame_num=%d poc=%d slice_type=%d", i, i % 16, i * 2 - 5, i % 3 + 1)
    return X.frame_boundaries(fx.table(spark, sf, "events").select(i.alias("line_no"), line.alias("value")), ["line_no"])


@query(
    "source_motion_lines",
    "SELECT event_id AS line_no, event_id%80 AS mb_x, event_id%45 AS mb_y, event_id%16 AS n, (event_id%41)-20 AS mv_x, (event_id%33)-16 AS mv_y, ((event_id%41)-20)&3 AS h_phase, ((event_id%33)-16)>>2 AS full_my FROM events",
)
def _(spark, sf):
    i = F.col("event_id")
    x, y = i % 41 - 20, i % 33 - 16
    line = F.format_string(
        "REAL mc_dir_part MB(%d,%d) n=%d list=0: mv_cache=(%d,%d) src_offset=(0,0) mx=%d my=%d h_phase=%d v_phase=%d full_mx=%d full_my=%d",
        i % 80, i % 45, i % 16, x, y, x, y, x.bitwiseAND(F.lit(3)), y.bitwiseAND(F.lit(3)), F.shiftright(x, 2), F.shiftright(y, 2),
    )
    m = X.motion_lines(fx.table(spark, sf, "events").select(i.alias("line_no"), line.alias("value")), ["line_no"])
    return m.select("line_no", "mb_x", "mb_y", "n", "mv_x", "mv_y", "h_phase", "full_my")


@query(
    "source_macroblock_table",
    "SELECT slice AS slice_type, count(*) AS n, sum(cbp)::BIGINT AS cbp, sum(mv_x-2)::BIGINT AS first_mv, count(*) FILTER (ref<3) AS with_ref FROM mb GROUP BY slice",
    ["mb"],
)
def _(spark, sf):
    """Macroblock records written with the declared schema (absent fields NULL) and read back by it."""
    mb = fx.macroblock_info(spark, sf)
    rec = mb.select("file_id", F.col("frame").alias("decode_no"), "mb_x", "mb_y", "mb_type", "mv_l0", "ref_l0", "cbp", "mb_width", "mb_height",
                    F.col("slice").alias("slice_type"), F.col("sub").alias("sub_mb_type"), "has_ref", F.col("c").alias("luma_dc"))
    path = work_dir(spark, "mb_info")
    K.write_table(rec, path, MB_INFO)
    t = K.read_table(spark, path, MB_INFO)
    return t.groupBy("slice_type").agg(
        F.count("*").alias("n"), F.sum("cbp").alias("cbp"), F.sum(F.get("mv_l0", F.lit(0)).cast("bigint")).alias("first_mv"), F.count_if("has_ref").alias("with_ref")
    )


@query("source_edge_table", "SELECT 15+l_partkey%30 AS alpha, count(*) AS n, sum(l_partkey%5-1)::BIGINT AS tc FROM lineitem GROUP BY 1")
def _(spark, sf):
    path = work_dir(spark, "edges")
    K.write_table(edge_rows(spark, sf), path, EDGE)
    return K.read_table(spark, path, EDGE).groupBy("alpha").agg(F.count("*").alias("n"), F.sum(F.get("tc0", F.lit(0))).alias("tc"))


def _c(e: str) -> str:
    return f"least(255,greatest(0,{e}))"


PPM = (
    f"""SELECT frame, 11+192 AS bytes, md5(unhex('50360A3820380A3235350A'||string_agg(printf('%02X%02X%02X', r, g, b), '' ORDER BY p))) AS digest FROM (
        SELECT frame, p, {_c('y+trunc(1.402::DOUBLE*(v-128))::BIGINT')} AS r, {_c('y-trunc(0.344136::DOUBLE*(u-128))::BIGINT-trunc(0.714136::DOUBLE*(v-128))::BIGINT')} AS g,
          {_c('y+trunc(1.772::DOUBLE*(u-128))::BIGINT')} AS b FROM (SELECT frame, p, ref AS y, live AS u, (ref*3+live)%256 AS v FROM pix)) GROUP BY frame"""
)


def _pictures(spark, sf):
    c = F.col
    px = fx.pixels(spark, sf).select("frame", "y", "x", c("ref").alias("l"), c("live").alias("u"), ((c("ref") * 3 + c("live")) % 256).alias("w"))
    return K.ppm_images(px.select("frame", "y", "x", *B.rgb_full(c("l"), c("u"), c("w"))))


@query("sink_ppm_images", PPM, ["pix"])
def _(spark, sf):
    return _pictures(spark, sf).select("frame", F.octet_length("image").alias("bytes"), F.md5("image").alias("digest"))


@query("sink_picture_files", PPM, ["pix"])
def _(spark, sf):
    """The pictures as files, committed together, and read back."""
    root = work_dir(spark, "pictures")
    write_files(K.picture_files(_pictures(spark, sf), "image", ".ppm"), root)
    frame = F.regexp_extract("path", r"frame=(\d+)\.ppm", 1).cast("bigint").alias("frame")
    return read_files(spark, root).select(frame, F.octet_length("content").alias("bytes"), F.md5("content").alias("digest"))


@query(
    "sink_raw_planes",
    "SELECT frame, 64::BIGINT AS bytes, md5(unhex(string_agg(printf('%02X', live), '' ORDER BY plane, y, x))) AS digest FROM pix GROUP BY frame",
    ["pix"],
)
def _(spark, sf):
    raw = K.raw_planes(fx.pixel_version(spark, sf, "live"))
    return raw.select("frame", F.octet_length("data").alias("bytes"), F.md5("data").alias("digest"))


@query(
    "sink_word_lines",
    "SELECT stream_id, dw//16 AS line_no, string_agg(printf('0x%08x', w), ',' ORDER BY dw) AS line FROM word GROUP BY ALL",
    ["word"],
)
def _(spark, sf):
    return K.word_lines(fx.words(spark, sf), per_line=16)


@query(
    "sink_report_text",
    f"""SELECT frame, printf('  frame %2d: luma %d/%d (max %d) chroma %d/%d (max %d)  %.3f%% mismatch%s', frame, luma_bad, luma_total, luma_max, chroma_bad, chroma_total, chroma_max, pct,
        CASE WHEN significant THEN '  <-- SIGNIFICANT' ELSE '' END) AS line FROM ({FRAME_REPORT})""",
    ["pd"],
)
def _(spark, sf):
    d = D.align(fx.pixel_version(spark, sf, "live"), fx.pixel_version(spark, sf, "ref"))
    return K.frame_report_text(D.frame_report(d))


@query("source_records", "SELECT file_id, frame, seq, mb_type, array_to_string(c, ',') AS c FROM mb WHERE seq BETWEEN 20 AND 60", ["mb"])
def _(spark, sf):
    """Macroblocks as fixed-width records; files and groups without the wanted blocks are skipped, and columns not asked for stay undecoded."""
    root = work_dir(spark, "records")
    layout = [("file_id", "<i8", 1), ("frame", "<i8", 1), ("seq", "<i8", 1), ("mb_type", "<i8", 1), ("mv_x", "<i8", 1), ("mv_y", "<i8", 1), ("cbp", "<i8", 1), ("c", "<i8", 16)]
    write_records(fx.macroblocks(spark, sf), root, layout, keys=["seq", "file_id"])
    got = read_records(spark, root, ["file_id", "frame", "seq", "mb_type", "c"], between=[("seq", 20, 60)]).where("seq BETWEEN 20 AND 60")
    return got.withColumn("c", F.array_join("c", ","))
