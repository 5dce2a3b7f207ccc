"""Derived inputs: the given tables reshaped into media tables, once in Spark and once in SQL."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediaframe.functions.batches import small_batches
from mediaframe.functions.bits import clip255, int_div
from mediaframe.functions.lineage import work_dir
from mediaframe.functions.ordered import by_span, by_width, numbered, row_index, running_sum
from mediaframe.sources.files import write_files

MB_WIDTH = 16
MB_HEIGHT = 12
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores when the scan has fewer splits than that; a large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---------------------------------------------------------------- pixels


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame, p, plane, y, x, ref, live (both versions on one row)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("p", "e"))
    ref = clip255(F.floor(F.col("e").cast("double") * 200 + 128))
    bump = (
        F.when((F.col("frame") * 7 + F.col("p") * 13) % 23 == 0, 3 + F.col("frame") % 5)
        .when((F.col("frame") + F.col("p")) % 11 == 0, F.lit(-1))
        .otherwise(F.lit(0))
    )
    return (
        e.withColumn("ref", ref.cast("int"))
        .withColumn("live", clip255(F.col("ref") + bump).cast("int"))
        .select(
            "frame",
            "p",
            F.shiftright("p", 5).alias("plane"),
            F.shiftright("p", 3).alias("y"),
            (F.col("p") % 8).alias("x"),
            "ref",
            "live",
        )
    )


def pixel_version(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """One version of the pixel table: frame, plane, y, x, v."""
    return pixels(spark, sf_dir).select("frame", "plane", "y", "x", F.col(version).alias("v"))


def pixel_rows(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """One version with packed rows: frame, plane, y, vs. Cut out of the embedding, nothing is grouped."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "embedding")
    rows = e.select("frame", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"), "embedding")

    def value(v, x):
        ref = F.floor(v.cast("double") * 200 + 128)
        clipped = F.least(F.lit(255), F.greatest(F.lit(0), ref))
        if version == "ref":
            return clipped.cast("int")
        p = F.col("y") * 8 + x
        bump = (
            F.when((F.col("frame") * 7 + p * 13) % 23 == 0, 3 + F.col("frame") % 5).when((F.col("frame") + p) % 11 == 0, F.lit(-1)).otherwise(F.lit(0))
        )
        return F.least(F.lit(255), F.greatest(F.lit(0), clipped + bump)).cast("int")

    vs = F.transform(F.slice("embedding", F.col("y") * 8 + 1, F.lit(8)), value)
    return rows.select("frame", F.shiftright("y", 2).alias("plane"), "y", vs.alias("vs"))


def block_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per 4x4 block of every frame: class, track number, motion vector, coded flag."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "label")
    g = e.select("frame", "label", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("b"))
    by, bx = F.shiftright("b", 1), F.col("b") % 2
    return g.select(
        "frame",
        by.alias("brow"),
        bx.alias("bcol"),
        (F.col("label") % 4).alias("class"),
        (F.col("frame") * 4 + F.col("b")).alias("track_no"),
        ((F.col("frame") * 7 + by * 3 + bx) % 161 - 80).cast("int").alias("mv_x"),
        ((F.col("frame") * 11 + bx * 5) % 161 - 80).cast("int").alias("mv_y"),
        ((F.col("frame") * 3 + F.col("b")) % 5 == 0).alias("coded"),
    )


# ---------------------------------------------------------------- container tables


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, sample_idx, size."""
    li = table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_quantity")
    idx = row_index(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], by_width("l_orderkey"), "sample_idx")
    return idx.select(
        F.col("l_suppkey").alias("file_id"), "sample_idx", (F.col("l_quantity").cast("bigint") * 64 + 8).alias("size")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, run_no, first_chunk, spc."""
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        s.alias("file_id"),
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("run_no"), F.lit(1).cast("bigint").alias("first_chunk"), (1 + s % 3).alias("spc")),
                F.struct(F.lit(1).alias("run_no"), (5 + s % 7).alias("first_chunk"), (2 + s % 4).alias("spc")),
                F.struct(F.lit(2).alias("run_no"), (20 + s % 11).alias("first_chunk"), (1 + s % 5).alias("spc")),
            )
        ),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, chunk_no, chunk_off: as many chunks as the file has samples, so that every sample finds one."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file_id")).agg(F.count("*").alias("n"))
    return numbered(n, "n", "chunk_no").select("file_id", (F.col("chunk_no") + 1).alias("chunk_no"), ((F.col("chunk_no") + 1) * 100000).alias("chunk_off"))


def movie_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small media file per document: path, length, content.

    Lines are samples, words are length-prefixed units, line counts per chunk follow a two-run table.
    Built row by row, nothing is grouped.
    """
    u32 = lambda c: F.lpad(F.hex(c.cast("bigint")), 8, "0")
    doc = small_batches(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", F.split("text", "\n").alias("lines"))
    unit = lambda w: F.concat(u32(F.octet_length(w)), F.hex(w.cast("binary")))
    body = doc.select(
        "doc_id",
        F.transform("lines", lambda ln: F.array_join(F.transform(F.split(ln, " "), unit), "")).alias("smp"),
    )
    n = F.size("smp")
    sizes = F.transform("smp", lambda s: (F.length(s) / 2).cast("bigint"))
    out = body.select("doc_id", "smp", n.alias("n"), sizes.alias("sizes"))
    # chunks: the first two hold one sample each, later ones three
    n_chunks = F.when(F.col("n") <= 2, F.col("n")).otherwise(2 + F.ceil((F.col("n") - 2) / 3)).cast("int")
    out = out.withColumn("nc", n_chunks)
    first = F.transform(F.sequence(F.lit(0), F.col("nc") - 1), lambda c: F.when(c < 2, c).otherwise(2 + (c - 2) * 3).cast("int"))

    @F.pandas_udf("array<bigint>")
    def running(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda s: np.concatenate(([0], np.cumsum(s, dtype="int64"))))

    out = out.withColumn("prefix", running("sizes")).withColumn("first", first)
    box = lambda name, payload: F.concat(u32(F.length(payload) / 2 + 8), F.hex(F.lit(name).cast("binary")), payload)
    hx = lambda s: F.lit(s)
    wide = F.col("doc_id") % 2 == 0
    ftyp = box("ftyp", hx("69736f6d" + "00000200"))
    sps, pps = "6764001facd9405005bb0110", "68ebe3cb22c0"
    avcc = box(
        "avcC",
        F.concat(hx("0164001f" + "ff" + "e1" + "%04x" % (len(sps) // 2) + sps + "01" + "%04x" % (len(pps) // 2) + pps)),
    )
    dims = F.concat(F.lpad(F.hex(320 + F.col("doc_id") % 64), 4, "0"), F.lpad(F.hex(240 + F.col("doc_id") % 32), 4, "0"))
    avc1 = box("avc1", F.concat(hx("00" * 24), dims, hx("00" * 50), avcc))
    stsd = box("stsd", F.concat(hx("00000000" + "00000001"), avc1))
    stsz = box("stsz", F.concat(hx("00000000"), u32(F.lit(0)), u32(F.col("n")), F.array_join(F.transform("sizes", u32), "")))
    stsc = box(
        "stsc",
        F.when(F.col("nc") > 2, F.concat(hx("00000000" + "00000002" + "00000001" + "00000001" + "00000001"), hx("00000003" + "00000003" + "00000001")))
        .otherwise(hx("00000000" + "00000001" + "00000001" + "00000001" + "00000001")),
    )
    head_len = F.lit(16 + 8)  # ftyp + mdat header
    offs = F.transform("first", lambda i: F.element_at(F.col("prefix"), i + 1) + head_len)
    stco = box("stco", F.concat(hx("00000000"), u32(F.col("nc")), F.array_join(F.transform(offs, u32), "")))
    co64 = box("co64", F.concat(hx("00000000"), u32(F.col("nc")), F.array_join(F.transform(offs, lambda o: F.lpad(F.hex(o), 16, "0")), "")))
    chunk_box = F.when(wide, stco).otherwise(co64)
    stbl = box("stbl", F.concat(stsd, stsz, stsc, chunk_box))
    moov = box("moov", box("trak", box("mdia", box("minf", stbl))))
    mdat = box("mdat", F.array_join("smp", ""))
    content = F.unhex(F.concat(ftyp, mdat, moov))
    return out.select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("path"), content.alias("content")
    ).select("path", F.octet_length("content").cast("bigint").alias("length"), "content")


def movie_folder(spark: SparkSession, sf_dir: str) -> str:
    """The media files of all documents as files below a shared folder."""
    root = work_dir(spark, "movies")
    write_files(movie_files(spark, sf_dir), root)
    return root


# ---------------------------------------------------------------- macroblocks


def macroblocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, frame, seq, mb_x, mb_y, mb_type, mv_x, mv_y, ref, slice, cbp, c (16 values), sub (4 values)."""
    li = table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_returnflag")
    li = li.withColumn("file_id", F.col("l_suppkey") % 10).withColumn("frame", F.col("l_orderkey") % 30)
    idx = row_index(li, ["file_id", "frame"], LINE_ORDER, by_width("l_orderkey"), "seq")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    types = F.array(*[F.lit(v) for v in (131080, 8, 16, 32, 64, 2, 1, 16777224, 16392, 147464)])
    coeff = [((part * (i + 1) + supp) % 41 - 20).cast("int") for i in range(16)]
    return idx.select(
        "file_id",
        "frame",
        "seq",
        (F.col("seq") % MB_WIDTH).cast("int").alias("mb_x"),
        int_div(F.col("seq"), MB_WIDTH).cast("int").alias("mb_y"),
        F.get(types, (part % 10).cast("int")).alias("mb_type"),
        ((part * 7) % 161 - 80).cast("int").alias("mv_x"),
        ((supp * 11) % 161 - 80).cast("int").alias("mv_y"),
        (supp % 4).cast("int").alias("ref"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("slice"),
        (part % 64).cast("int").alias("cbp"),
        (part % 5 == 0).alias("coded"),
        (part % 9).cast("int").alias("n9"),
        F.array(*coeff).alias("c"),
        F.array(*[F.get(F.array(*[F.lit(v) for v in (8, 16, 32, 64)]), ((part + q) % 4).cast("int")) for q in range(4)]).alias("sub"),
    )


def macroblock_info(spark: SparkSession, sf_dir: str, cells_of: Column | None = None) -> DataFrame:
    """Macroblocks with the cached vector (80) and reference (40) arrays of the decoder record; NULL arrays where ``cells_of`` is given and does not hold."""
    mb = macroblocks(spark, sf_dir)
    # vectors repeat every 15 cells. One expression a cell, 120 in all, makes a method too long for the JVM to compile
    cells = F.array(*[v for i in range(15) for v in (F.col("mv_x") + (i % 5 - 2), F.col("mv_y") + (i % 3 - 1))])
    mv = F.slice(F.flatten(F.array_repeat(cells, 3)), 1, 80)
    n9, r = F.col("n9"), F.col("ref")
    one_up = lambda at: r + F.when(at, 1).otherwise(0)
    known = F.concat(F.array(one_up(n9 == 0)), F.array_repeat(r, 28 - n9), F.array(r + 1), F.array_repeat(r, 10 + n9))
    any_n9 = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: one_up((n9 + i) % 29 == 0))
    ref = F.when(n9.between(0, 8), known).otherwise(any_n9)
    if cells_of is not None:
        mv, ref = F.when(cells_of, mv), F.when(cells_of, ref)
    return mb.select(
        "*",
        mv.alias("mv_l0"),
        ref.alias("ref_l0"),
        F.col("ref").alias("base_ref"),
        F.col("mv_x").alias("base_mv_x"),
        F.col("mv_y").alias("base_mv_y"),
        (F.col("ref") < 3).alias("has_ref"),
        F.lit(MB_WIDTH).alias("mb_width"),
        F.lit(MB_HEIGHT).alias("mb_height"),
    )


# ---------------------------------------------------------------- word streams


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, dw, w. At most 60 words per stream (ten order keys of up to six words); every packet fault and policy rule occurs."""
    k = F.col("o_orderkey")
    u = lambda c: F.pmod(c, F.lit(4294967296).cast("bigint"))
    L = lambda v: F.lit(v).cast("bigint")
    w = (
        F.when(k % 40 == 9, F.array(L(5 * 65536 + 4352), u(k)))  # the last key of a stream: packets longer than what is left
        .when(k % 40 == 19, F.array(L(1073741824), u(k)))
        .when(k % 40 == 29, F.array(L(3221225472 + 7 * 65536 + 4096), u(k)))
        .when(k % 30 == 1, F.array(L(4263), u(k)))  # a register never allowed
        .when(k % 30 == 7, F.array(L(4166), u(k)))  # a register that may hang
        .when(k % 18 == 4, F.array(L(3221225472 + 32512), u(k)))  # an unknown opcode
        .when(k % 12 == 5, F.array(2147483649 + k % 100))  # a filler with low bits
        .when(k % 12 == 2, F.array(L(4244), k % 64, L(131072 + 32768 + 4245), u(k), u(k + 1), u(k + 2)))  # a program with its slot
        .when(k % 6 == 0, F.array(L(2147483648)))
        .when(k % 6 == 1, F.array(65536 + 4352 + k % 768, u(k), u(k * 3)))
        .when(k % 6 == 2, F.array(L(131072 + 32768 + 4245), u(k), u(k + 1), u(k + 2)))
        .when(k % 6 == 3, F.array(L(1073741824) + (k % 2048) * 2048 + (k * 7) % 2048, u(k), u(k * 5)))
        .when(k % 6 == 4, F.array(L(3221225472 + 4096), u(k)))
        .otherwise(F.array(L(0)))
    )
    o = table(spark, sf_dir, "orders").select(
        int_div(k, 10).alias("stream_id"), k.alias("k"), F.posexplode(w).alias("i", "w")
    )
    dw = F.row_number().over(Window.partitionBy("stream_id").orderBy("k", "i")) - 1
    return o.select("stream_id", dw.cast("bigint").alias("dw"), "w")


# ---------------------------------------------------------------- timings, profiles, counters, log lines


def ticks(ms: Column) -> Column:
    """Milliseconds as whole ticks of a 1024 per millisecond clock: sums are exact, in whatever order they are taken."""
    return F.floor(ms * 1024) / 1024


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, f, ts, live_ms, ref_ms."""
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("run"), "ts", "event_id", "event_type", ticks(F.col("value")).alias("live_ms"),
        ticks(F.col("value") / (1 + F.col("event_id") % 5)).alias("ref_ms"),
    )
    return row_index(e, ["run"], ["ts", "event_id"], by_span("ts"), "f")


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, phase, wall_ms, cpu_ms."""
    e = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(n) for n in ("pack", "upload", "draw", "read")])
    return e.select(
        F.col("event_type").alias("site"),
        F.get(names, (F.col("event_id") % 4).cast("int")).alias("phase"),
        ticks(F.col("value")).alias("wall_ms"),
        ticks(F.col("value") * (F.col("event_id") % 101) / 100.0).alias("cpu_ms"),
        "event_id",
        "ts",
        "user_id",
    )


def stage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip, stage, threads, ms."""
    names = F.array(*[F.lit(n) for n in ("full", "nodeblock", "entropy")])
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("clip"),
        F.get(names, (F.col("event_id") % 3).cast("int")).alias("stage"),
        F.get(F.array(*[F.lit(v) for v in (1, 2, 4, 8)]), (F.col("event_id") % 4).cast("int")).alias("threads"),
        ticks(F.col("value")).alias("ms"),
        "event_id",
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, f, ts, v: running count of purchases, polled at every event of the run."""
    t = timings(spark, sf_dir)
    hit = (F.col("event_type") == "purchase").cast("bigint")
    return running_sum(t, ["run"], ["f"], by_width("f"), hit, "v").select("run", "f", "ts", "v")


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, line: one FLUSH record per event."""
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    return table(spark, sf_dir, "events").select(
        i.alias("line_no"),
        F.concat(
            F.lit("FLUSH\tconn="), s(F.col("user_id")), F.lit("\tn="), s(i), F.lit("\trecords="), s(i % 40), F.lit("\twords="), s(i % 997),
            F.lit("\tHIST 00:"), s(i % 3), F.lit(":"), s(i % 7), F.lit(" 25:"), s(i % 5), F.lit(":"), s(i % 11),
        ).alias("line"),
    )


def session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, line: OPEN / DUMP / FLUSH / TAIL / CLOSE / TOTAL and comment lines by event type and number."""
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    kind = F.get(F.array(*[F.lit(k) for k in ("OPEN", "DUMP", "FLUSH", "TAIL", "CLOSE", "TOTAL", "# note")]), (i % 7).cast("int"))
    return table(spark, sf_dir, "events").select(
        i.alias("line_no"),
        F.concat(
            kind, F.lit("\tconn="), s(F.col("user_id")), F.lit("\trecords="), s(i % 40), F.lit("\twords="), s(i % 997), F.lit("\tfree text "), s(i)
        ).alias("line"),
    )


def frame_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no, value: per-frame report lines with integer milliseconds."""
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    ms = F.col("value").cast("bigint")
    return table(spark, sf_dir, "events").select(
        i.alias("line_no"),
        F.concat(
            F.lit("  frame "), s(i), F.lit(": live= "), s(ms), F.lit(".0ms ref= "), s(i % 50), F.lit(".0ms  luma "), s(i % 17),
            F.lit("/921600 (max "), s(i % 13), F.lit(") chroma "), s(i % 3), F.lit("/460800 (max "), s(i % 2),
            F.lit(")  0.000% mismatch"), F.when(i % 10 == 0, F.lit("  <-- SIGNIFICANT")).otherwise(F.lit("")),
        ).alias("value"),
    )


def hex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, line: the words of a stream as a comma list (at most 60 words)."""
    w = words(spark, sf_dir)
    tok = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex("w"), 8, "0")))
    packed = w.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("dw", tok.alias("t")))).alias("a"))
    return packed.select("stream_id", F.array_join(F.col("a.t"), ",").alias("line"))


# ---------------------------------------------------------------- the same inputs in SQL

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "pix": (
        (),
        """SELECT frame, p, p//32 AS plane, p//8 AS y, p%8 AS x, ref,
            least(255, greatest(0, ref + CASE WHEN (frame*7+p*13)%23=0 THEN 3+frame%5 WHEN (frame+p)%11=0 THEN -1 ELSE 0 END)) AS live
          FROM (SELECT vec_id AS frame, p, least(255, greatest(0, floor(e::DOUBLE*200+128)::BIGINT)) AS ref
            FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding,1)-1 AS p FROM embeddings))""",
    ),
    "pd": (("pix",), "SELECT *, abs(live-ref) AS d, y//4 AS brow, x//4 AS bcol FROM pix"),
    "grid": (
        (),
        """SELECT vec_id AS frame, b//2 AS brow, b%2 AS bcol, label%4 AS class, vec_id*4+b AS track_no,
            (vec_id*7+(b//2)*3+b%2)%161-80 AS mv_x, (vec_id*11+(b%2)*5)%161-80 AS mv_y, (vec_id*3+b)%5=0 AS coded
          FROM embeddings, range(4) t(b)""",
    ),
    "smp": (
        (),
        """SELECT l_suppkey AS file_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey,l_linenumber,l_partkey)-1 AS sample_idx,
            l_quantity::BIGINT*64+8 AS size FROM lineitem""",
    ),
    "run": (
        (),
        """SELECT s_suppkey AS file_id, unnest([1, 5+s_suppkey%7, 20+s_suppkey%11]) AS first_chunk,
            unnest([1+s_suppkey%3, 2+s_suppkey%4, 1+s_suppkey%5]) AS spc FROM supplier""",
    ),
    "chk": ((), "SELECT file_id, c AS chunk_no, c*100000 AS chunk_off FROM (SELECT l_suppkey AS file_id, unnest(range(1, count(*)+1)) AS c FROM lineitem GROUP BY l_suppkey)"),
    "mb": (
        (),
        """SELECT file_id, frame, seq, seq%16 AS mb_x, seq//16 AS mb_y,
            [131080,8,16,32,64,2,1,16777224,16392,147464][l_partkey%10+1] AS mb_type,
            (l_partkey*7)%161-80 AS mv_x, (l_suppkey*11)%161-80 AS mv_y, l_suppkey%4 AS ref,
            CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS slice, l_partkey%64 AS cbp, l_partkey%5=0 AS coded,
            l_partkey%9 AS n9,
            list_transform(range(16), lambda i: (l_partkey*(i+1)+l_suppkey)%41-20) AS c,
            list_transform(range(4), lambda q: 8 << ((l_partkey+q)%4)) AS sub
          FROM (SELECT *, l_suppkey%10 AS file_id, l_orderkey%30 AS frame,
            row_number() OVER (PARTITION BY l_suppkey%10, l_orderkey%30 ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey)-1 AS seq FROM lineitem)""",
    ),
    "route": (
        ("mb",),
        """SELECT *, CASE WHEN mb_type & 131072 <> 0 THEN 'skip' WHEN mb_type & 8 <> 0 THEN 'p16x16' WHEN mb_type & 48 <> 0 THEN 'p16x8'
            WHEN mb_type & 64 <> 0 THEN 'p8x8' WHEN mb_type & 2 = 0 THEN 'not_intra16x16' WHEN slice=1 THEN 'intra_slice_i'
            WHEN mb_x=0 OR mb_y=0 THEN 'intra_edge' ELSE 'intra' END AS route FROM mb""",
    ),
    "part": (
        ("mb",),
        """SELECT *, (h_phase=2 AND v_phase=2) OR (v_phase=2 AND h_phase%2=1) OR (h_phase=2 AND v_phase%2=1) AS diag,
            pel_x-2>=0 AND pel_y-2>=0 AND pel_x+w+2<256 AND pel_y+h+2<192 AS luma_ok,
            cpel_x>=0 AND cpel_y>=0 AND cpel_x+w//2+1<128 AND cpel_y+h//2+1<96 AS chroma_ok
          FROM (SELECT *, full_x & 3 AS h_phase, full_y & 3 AS v_phase, full_x >> 2 AS pel_x, full_y >> 2 AS pel_y,
              full_x & 7 AS ch_phase, full_y & 7 AS cv_phase, full_x >> 3 AS cpel_x, full_y >> 3 AS cpel_y
            FROM (SELECT *, pmv_x+(mb_x*16+x_off)*4 AS full_x, pmv_y+(mb_y*16+y_off)*4 AS full_y
              FROM (SELECT *, mv_x+g%5-2 AS pmv_x, mv_y+g%3-1 AS pmv_y, ref+CASE WHEN (g+n9)%29=0 THEN 1 ELSE 0 END AS part_ref
                FROM (SELECT *, [12,13,20,21,14,15,22,23,28,29,36,37,30,31,38,39][n+1] AS g FROM (
                  SELECT mb.*, s.n, s.x_off, s.y_off, s.w, s.h FROM mb JOIN (VALUES (8,0,0,0,16,16),(16,0,0,0,16,8),(16,8,0,8,16,8),(32,0,0,0,8,16),(32,4,8,0,8,16)) s(code,n,x_off,y_off,w,h)
                    ON s.code = CASE WHEN mb_type & 8 <> 0 THEN 8 WHEN mb_type & 16 <> 0 THEN 16 WHEN mb_type & 32 <> 0 THEN 32 ELSE 0 END
                  UNION ALL
                  SELECT mb.*, 4*q+k, (q%2)*8+dx, (q//2)*8+dy, s.w, s.h FROM mb CROSS JOIN range(4) t(q)
                    JOIN (VALUES (8,0,0,0,8,8),(16,0,0,0,8,4),(16,2,0,4,8,4),(32,0,0,0,4,8),(32,1,4,0,4,8),
                      (64,0,0,0,4,4),(64,1,4,0,4,4),(64,2,0,4,4,4),(64,3,4,4,4,4)) s(code,k,dx,dy,w,h) ON s.code = sub[q+1]
                    WHERE mb_type & 64 <> 0)))))""",
    ),
    "outc": (
        ("route", "part"),
        """SELECT r.*, CASE WHEN route='skip' THEN coalesce(b, l1, nr, whole) WHEN route='p16x16' THEN coalesce(dct, b, l1, nr, whole)
              WHEN route IN ('p16x8','p8x8') THEN coalesce(b, l1, dct, nr, pr) WHEN route<>'intra' THEN route END AS reason
          FROM (SELECT r.*, CASE WHEN slice=3 THEN 'b_slice' END AS b, CASE WHEN mb_type & 16777216 <> 0 THEN 'dct8x8' END AS dct,
              CASE WHEN ref>=3 THEN 'no_ref' END AS nr, CASE WHEN mb_type & 49152 <> 0 THEN 'list1' END AS l1,
              CASE WHEN NOT (px-2>=0 AND py-2>=0 AND px+18<256 AND py+18<192) THEN 'luma_margin' WHEN NOT (cx>=0 AND cy>=0 AND cx+9<128 AND cy+9<96) THEN 'chroma_margin' END AS whole, p.pr
            FROM (SELECT *, (mv_x+mb_x*64)>>2 AS px, (mv_y+mb_y*64)>>2 AS py, (mv_x+mb_x*64)>>3 AS cx, (mv_y+mb_y*64)>>3 AS cy FROM route) r
            LEFT JOIN (SELECT file_id, frame, seq, arg_min(why, n) AS pr FROM (SELECT file_id, frame, seq, n,
                CASE WHEN part_ref<>ref THEN 'ref_differs' WHEN NOT luma_ok THEN 'luma_margin' WHEN NOT chroma_ok THEN 'chroma_margin' END AS why FROM part) WHERE why IS NOT NULL GROUP BY ALL) p
              USING (file_id, frame, seq)) r""",
    ),
    "word": (
        (),
        """SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY k,i)-1 AS dw, w FROM (
            SELECT o_orderkey//10 AS stream_id, o_orderkey AS k, unnest(a) AS w, generate_subscripts(a,1)-1 AS i FROM (
              SELECT o_orderkey, CASE WHEN o_orderkey%40=9 THEN [332032::BIGINT, o_orderkey%4294967296]
                WHEN o_orderkey%40=19 THEN [1073741824::BIGINT, o_orderkey%4294967296]
                WHEN o_orderkey%40=29 THEN [3221688320::BIGINT, o_orderkey%4294967296]
                WHEN o_orderkey%30=1 THEN [4263::BIGINT, o_orderkey%4294967296]
                WHEN o_orderkey%30=7 THEN [4166::BIGINT, o_orderkey%4294967296]
                WHEN o_orderkey%18=4 THEN [3221257984::BIGINT, o_orderkey%4294967296]
                WHEN o_orderkey%12=5 THEN [2147483649+o_orderkey%100]
                WHEN o_orderkey%12=2 THEN [4244::BIGINT, o_orderkey%64, (131072+32768+4245)::BIGINT, o_orderkey%4294967296, (o_orderkey+1)%4294967296, (o_orderkey+2)%4294967296]
                ELSE CASE o_orderkey%6
                WHEN 0 THEN [2147483648::BIGINT]
                WHEN 1 THEN [65536+4352+o_orderkey%768, o_orderkey%4294967296, (o_orderkey*3)%4294967296]
                WHEN 2 THEN [(131072+32768+4245)::BIGINT, o_orderkey%4294967296, (o_orderkey+1)%4294967296, (o_orderkey+2)%4294967296]
                WHEN 3 THEN [1073741824::BIGINT+(o_orderkey%2048)*2048+(o_orderkey*7)%2048, o_orderkey%4294967296, (o_orderkey*5)%4294967296]
                WHEN 4 THEN [3221229568::BIGINT, o_orderkey%4294967296]
                ELSE [0::BIGINT] END END AS a FROM orders))""",
    ),
    "tim": (
        (),
        """SELECT user_id%10 AS run, row_number() OVER (PARTITION BY user_id%10 ORDER BY ts,event_id)-1 AS f, ts, event_type, event_id,
            floor(value*1024)/1024 AS live_ms, floor(value/(1+event_id%5)*1024)/1024 AS ref_ms FROM events""",
    ),
    "prof": (
        (),
        """SELECT event_type AS site, ['pack','upload','draw','read'][event_id%4+1] AS phase, floor(value*1024)/1024 AS wall_ms,
            floor(value*(event_id%101)/100.0::DOUBLE*1024)/1024 AS cpu_ms, event_id, ts, user_id FROM events""",
    ),
    "stg": (
        (),
        """SELECT user_id%3 AS clip, ['full','nodeblock','entropy'][event_id%3+1] AS stage, 1 << (event_id%4) AS threads, floor(value*1024)/1024 AS ms, event_id FROM events""",
    ),
    "ctr": (
        ("tim",),
        """SELECT run, f, ts, (sum(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY f))::BIGINT AS v FROM tim""",
    ),
    "trc": (
        (),
        """SELECT event_id AS line_no, user_id AS conn, event_id%40 AS records, event_id%997 AS words,
            event_id%3 AS c0, event_id%7 AS w0, event_id%5 AS c25, event_id%11 AS w25 FROM events""",
    ),
    "ses": (
        (),
        """SELECT event_id AS line_no, user_id AS conn, ['OPEN','DUMP','FLUSH','TAIL','CLOSE','TOTAL','#'][event_id%7+1] AS kind,
            event_id%40 AS records, event_id%997 AS words FROM events""",
    ),
}


def with_clause(uses: Sequence[str], sql: str) -> str:
    """Put the needed derived inputs in front of a SELECT."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for name in uses:
        add(name)
    if not order:
        return sql.strip()
    body = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    text = sql.strip()
    for lead in ("WITH RECURSIVE ", "WITH "):
        if text.startswith(lead):
            return f"{lead}{body}, {text[len(lead):]}"
    return f"WITH {body}\n{text}"
