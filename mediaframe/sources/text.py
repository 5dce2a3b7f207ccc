"""Text scans: word lists, traces, reports and step logs.

Each ``parse_*`` takes a DataFrame of lines, each ``scan_*`` reads files and numbers nothing: row order
inside a file comes from the line text itself or from the caller's line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.functions.bits import be_uint, hex_to_long, parse_int_any_radix

# Fixed value: magic number of a capture header.
CAPTURE_MAGIC = 0x50414330
CAPTURE_HEADER = 20


def scan_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, content; reading only path and length leaves the bytes on disk."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, value per text line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


# ------------------------------------------------------------- word streams


def parse_word_list(lines: DataFrame, keys: list[str], text: str = "line") -> DataFrame:
    """Comma, space or newline separated numbers in any radix to (keys, dw, w); empty tokens are skipped."""
    tokens = F.filter(F.split(F.col(text), r"[,\s]+"), lambda t: t != "")
    return lines.select(*keys, F.posexplode(tokens).alias("dw", "t")).select(
        *keys, F.col("dw").cast("bigint").alias("dw"), parse_int_any_radix(F.col("t")).alias("w")
    )


def scan_word_files(spark: SparkSession, path: str) -> DataFrame:
    """One stream per file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("stream_id"), F.col("value").alias("line"))
    return parse_word_list(whole, ["stream_id"])


def capture_headers(files: DataFrame) -> DataFrame:
    """Header fields of capture files (path, content), with ok = false for a short file or wrong magic."""
    c = F.col("content")
    names = ("link", "cursor", "limit", "magic")
    f = files.select("path", "content", *[F.when(F.octet_length(c) >= CAPTURE_HEADER, be_uint(c, 4 * i, 4)).alias(n) for i, n in enumerate(names)])
    return f.withColumn("ok", F.coalesce(F.col("magic") == CAPTURE_MAGIC, F.lit(False)))


CAPTURE_PART = 4096


def capture_words(files: DataFrame, part: int = CAPTURE_PART) -> DataFrame:
    """Words of the good captures; a trailing piece of under four bytes is dropped.

    A capture is cut into parts of ``part`` words, and words are cut out of their part, so no row holds all words of a capture.
    """
    n = F.floor((F.octet_length("content") - CAPTURE_HEADER) / 4).cast("int")
    good = capture_headers(files).where("ok").select("path", "content", n.alias("n")).where("n > 0")
    starts = F.sequence(F.lit(0), F.col("n") - 1, F.lit(part))
    piece = lambda s: F.substring(F.col("content"), s * 4 + CAPTURE_HEADER + 1, F.least(F.lit(part), F.col("n") - s) * 4)
    # pieces are cut before the explode, so the content is not copied to each of them
    parts = good.select("path", F.posexplode(F.transform(starts, piece)).alias("i", "piece"))
    words = F.transform(F.sequence(F.lit(0), (F.octet_length("piece") / 4 - 1).cast("int")), lambda k: be_uint(F.col("piece"), k * 4, 4))
    cut = parts.select("path", "i", F.posexplode(words).alias("k", "w"))
    return cut.select("path", (F.col("i").cast("bigint") * part + F.col("k")).alias("dw"), "w")


def rejected_captures(files: DataFrame) -> DataFrame:
    return capture_headers(files).where(~F.col("ok")).select("path", F.octet_length("content").alias("bytes"), "magic")


# ------------------------------------------------------------- traces


def fields(pairs: Column) -> Column:
    """Map of 'k=v' strings; where a key is repeated, its last value holds."""
    split = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("v")))
    last = F.aggregate(split, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return last


def parse_trace(lines: DataFrame, keys: list[str], text: str = "line") -> DataFrame:
    """kind, f (map of k=v fields), hist (op, cnt, words) and the free tail; comment lines are left out."""
    parts = F.split(F.col(text), "\t")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    pairs = F.filter(rest, lambda p: p.rlike("^[A-Za-z_]+=[^ ]*$"))
    tail = F.filter(rest, lambda p: ~p.rlike("^[A-Za-z_]+=[^ ]*$"))
    hist_text = F.get(F.filter(tail, lambda p: p.startswith("HIST")), F.lit(0))
    entry = lambda t: F.split(t, ":")
    hist = F.transform(
        F.filter(F.split(hist_text, " "), lambda t: t.rlike("^[0-9a-fA-F]+:[0-9]+:[0-9]+$")),
        lambda t: F.struct(
            F.conv(F.get(entry(t), F.lit(0)), 16, 10).cast("int").alias("op"),
            F.get(entry(t), F.lit(1)).cast("bigint").alias("cnt"),
            F.get(entry(t), F.lit(2)).cast("bigint").alias("words"),
        ),
    )
    as_map = fields(pairs)
    free = F.array_join(F.filter(tail, lambda p: ~p.startswith("HIST")), "\t")
    return lines.where(~F.col(text).startswith("#")).select(
        *keys, F.get(parts, F.lit(0)).alias("kind"), as_map.alias("f"), hist.alias("hist"), free.alias("tail")
    )


# ------------------------------------------------------------- reports and step logs

NUM = r"([0-9]+(?:\.[0-9]+)?)"
# Line templates of the per-frame report.
FRAME_LINE = (
    rf"^\s*frame\s+(\d+): live=\s*{NUM}ms ref=\s*{NUM}ms\s+luma (\d+)/(\d+) \(max (\d+)\) chroma (\d+)/(\d+) \(max (\d+)\)\s+{NUM}% mismatch(\s+<-- SIGNIFICANT)?"
)
TOTALS_LINE = rf"^Totals over (\d+) frames: live={NUM}ms \({NUM}ms/frame avg\) ref={NUM}ms \({NUM}ms/frame avg\)"
STEADY_LINE = rf"^Steady-state .*: live={NUM}ms/frame ref={NUM}ms/frame -> GPU is {NUM}x (slower|faster) than CPU"
BUDGET_LINE = rf"^Real-time check \(budget={NUM}ms/frame.*\): (\d+)/(\d+) frames .*met budget \((\d+)%\)"
LIVE_LINE = (
    r"^\s*live totals: (\d+) intra, (\d+) skip \((\d+) declined\), (\d+) P_16x16 \((\d+) declined\), "
    r"(\d+) P_16x8/P_8x16 \((\d+) declined\), (\d+) P_8x8 \((\d+) declined\), (\d+) declined to CPU"
)
SITE_CALLS = rf"([a-z_]+): (\d+) calls, {NUM}ms total"
CPU_SHARE = rf"([a-z_]+) cpu={NUM}ms"
PHASE_COST = rf"([a-z+]+) wall={NUM}ms cpu={NUM}ms"
CACHE_LINE = rf"(\d+) hits \(wall={NUM}ms cpu={NUM}ms.*?; (\d+) misses \(wall={NUM}ms cpu={NUM}ms"


def typed(lines: DataFrame, keys: list[str], pattern: str, fields: list[tuple[str, str]], text: str = "value") -> DataFrame:
    """Typed columns from the lines that match one template, group i giving field i."""
    hit = lines.where(F.col(text).rlike(pattern))
    return hit.select(*keys, *[F.regexp_extract(text, pattern, i + 1).cast(t).alias(n) for i, (n, t) in enumerate(fields)])


def frame_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    f = [("frame", "bigint"), ("live_ms", "double"), ("ref_ms", "double"), ("luma_bad", "bigint"), ("luma_total", "bigint"), ("luma_max", "bigint"),
         ("chroma_bad", "bigint"), ("chroma_total", "bigint"), ("chroma_max", "bigint"), ("pct", "double"), ("flag", "string")]
    return typed(lines, keys, FRAME_LINE, f).withColumn("significant", F.col("flag") != "").drop("flag")


def totals_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    return typed(lines, keys, TOTALS_LINE, [("frames", "bigint"), ("live_total", "double"), ("live_avg", "double"), ("ref_total", "double"), ("ref_avg", "double")])


def steady_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    return typed(lines, keys, STEADY_LINE, [("live_steady", "double"), ("ref_steady", "double"), ("ratio", "double"), ("label", "string")])


def budget_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    return typed(lines, keys, BUDGET_LINE, [("budget_ms", "double"), ("met", "bigint"), ("n", "bigint"), ("pct", "double")])


def live_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    names = ["intra", "skip", "skip_declined", "p16x16", "p16x16_declined", "p16x8", "p16x8_declined", "p8x8", "p8x8_declined", "declined"]
    return typed(lines, keys, LIVE_LINE, [(n, "bigint") for n in names])


def repeated(lines: DataFrame, keys: list[str], only: str, pattern: str, fields: list[tuple[str, str]], text: str = "value") -> DataFrame:
    """Typed rows for every occurrence of a template inside the lines containing ``only``."""
    occ = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hit = lines.where(F.col(text).contains(only)).select(*keys, F.explode(occ).alias("__o"))
    return hit.select(*keys, *[F.regexp_extract("__o", pattern, i + 1).cast(t).alias(n) for i, (n, t) in enumerate(fields)])


def site_calls(lines: DataFrame, keys: list[str]) -> DataFrame:
    return repeated(lines, keys, "dispatch profile", SITE_CALLS, [("site", "string"), ("calls", "bigint"), ("total_ms", "double")])


def site_cpu(lines: DataFrame, keys: list[str]) -> DataFrame:
    return repeated(lines, keys, "CPU-time breakdown", CPU_SHARE, [("site", "string"), ("cpu_ms", "double")])


def phase_costs(lines: DataFrame, keys: list[str]) -> DataFrame:
    return repeated(lines, keys, "phase breakdown", PHASE_COST, [("phase", "string"), ("wall_ms", "double"), ("cpu_ms", "double")])


def cache_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    f = [("hits", "bigint"), ("hit_ms", "double"), ("hit_cpu_ms", "double"), ("misses", "bigint"), ("miss_ms", "double"), ("miss_cpu_ms", "double")]
    return typed(lines, keys, CACHE_LINE, f)


def parse_step_log(lines: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """[tag] lines: tag, k=v fields and the hex words of the line."""
    tag = F.regexp_extract(text, r"^\[([^\]]+)\]", 1)
    pairs = F.regexp_extract_all(text, F.lit(r"([A-Za-z_0-9@+-]+)=([^\s,)]+)"), F.lit(0))
    body = F.regexp_replace(F.col(text), r"^\[[^\]]+\]", "")
    words = F.transform(F.regexp_extract_all(body, F.lit(r"(?:^|\s)([0-9a-f]{8})(?=\s|$)"), F.lit(1)), hex_to_long)
    return lines.where(F.col(text).rlike(r"^\[[^\]]+\]")).select(
        *keys, tag.alias("tag"), fields(pairs).alias("f"), words.alias("words"), F.trim(body).alias("text")
    )


def timeline_changes(lines: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """Counter changes 't ms(0xv)' of timeline lines."""
    pat = r"([0-9.]+)ms\(0x([0-9a-f]+)\)"
    occ = lines.where(F.col(text).contains("TIMELINE run")).select(
        *keys, F.regexp_extract(text, r"TIMELINE run (\d+)", 1).cast("int").alias("run"), F.posexplode(F.regexp_extract_all(text, F.lit(pat), F.lit(0))).alias("i", "o")
    )
    return occ.select(*keys, "run", "i", F.regexp_extract("o", pat, 1).cast("double").alias("t_ms"), hex_to_long(F.regexp_extract("o", pat, 2)).alias("v"))


# ------------------------------------------------------------- decoder trace lines

# Line templates of the decoder trace.
FRAME_BOUNDARY = r"FRAME BOUNDARY: \w*frameno=(\d+) frame_num=(-?\d+) poc=(-?\d+) slice_type=(-?\d+)"
PART_CENSUS = r"PART CENSUS: 16x16=(\d+) 16x8=(\d+) 8x16=(\d+) 8x8\(whole\)=(\d+) 8x8\(8x4\)=(\d+) 8x8\(4x8\)=(\d+) 8x8\(4x4\)=(\d+) other=(\d+)"
MC_PART = (
    r"mc_dir_part MB\((\d+),(\d+)\) n=(\d+) list=(\d+): mv_cache=\((-?\d+),(-?\d+)\) src_offset=\((-?\d+),(-?\d+)\) "
    r"mx=(-?\d+) my=(-?\d+) h_phase=(\d+) v_phase=(\d+) full_mx=(-?\d+) full_my=(-?\d+)"
)


def frame_boundaries(lines: DataFrame, keys: list[str]) -> DataFrame:
    return typed(lines, keys, FRAME_BOUNDARY, [("decode_no", "bigint"), ("frame_num", "bigint"), ("poc", "bigint"), ("slice_type", "int")])


def census_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    names = ["p16x16", "p16x8", "p8x16", "p8x8", "p8x8_8x4", "p8x8_4x8", "p8x8_4x4", "other"]
    return typed(lines, keys, PART_CENSUS, [(n, "bigint") for n in names])


def motion_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    names = ["mb_x", "mb_y", "n", "list", "mv_x", "mv_y", "src_x", "src_y", "mx", "my", "h_phase", "v_phase", "full_mx", "full_my"]
    return typed(lines, keys, MC_PART, [(n, "int") for n in names])


def no_match(text: Column, patterns: list[str]) -> Column:
    """True for a line no template recognises."""
    out = F.lit(True)
    for p in patterns:
        out = out & ~text.rlike(p)
    return out
