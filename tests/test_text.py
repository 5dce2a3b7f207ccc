"""Log, trace and capture scans on literal lines with known results."""

import struct

import pytest
from pyspark.sql import functions as F

from mediaframe.operators import profile as P
from mediaframe.operators import trace as X
from mediaframe.sources import text as S

# The wording is fixed by the report format; all numbers are this test's own.
REPORT = """\
  live totals: 400 intra, 300 skip (60 declined), 200 P_16x16 (50 declined), 100 P_16x8/P_8x16 (40 declined), 80 P_8x8 (20 declined), 46 declined to CPU
  dispatch profile: 90 calls; alpha: 30 calls, 120.5ms total (4.02ms/call); beta_two: 60 calls, 30.0ms total (0.50ms/call)
  CPU-time breakdown: alpha cpu=60.5ms (50% of its wall); beta_two cpu=15.5ms (52% of its wall); TOTAL cpu=76.0ms
  reference cache: 500 hits (wall=5.0ms cpu=4.5ms, 0.010ms/hit); 20 misses (wall=40.0ms cpu=39.0ms, 2.00ms/miss)
  frame  0: live=  100.0ms ref=  40.0ms  luma 0/4000 (max 0) chroma 0/2000 (max 0)  0.000% mismatch
  frame  4: live=   30.0ms ref=  15.0ms  luma 90/4000 (max 7) chroma 0/2000 (max 0)  1.500% mismatch  <-- SIGNIFICANT
  frame  9: live=   50.0ms ref=  15.0ms  luma 75/4000 (max 5) chroma 0/2000 (max 0)  1.250% mismatch  <-- SIGNIFICANT
Totals over 10 frames: live=460.0ms (46.0ms/frame avg) ref=175.0ms (17.5ms/frame avg)
Steady-state (excludes frame 0): live=40.0ms/frame ref=15.0ms/frame -> GPU is 2.67x slower than CPU
Real-time check (budget=33.3ms/frame, assumed 30fps): 4/9 frames (excl. frame 0) met budget (44%) - NOT real-time yet"""
HIST = "00:2:20 07:1:3 2a:4:40 2f:1:11"


@pytest.fixture(scope="module")
def report(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(REPORT.split("\n"))], "line_no bigint, value string")


def test_frame_report_lines(report):
    f = S.frame_lines(report, ["line_no"]).orderBy("frame").collect()
    assert [r.frame for r in f] == [0, 4, 9] and [r.significant for r in f] == [False, True, True]
    assert round(100 * f[2].luma_bad / (f[2].luma_total + f[2].chroma_total), 3) == f[2].pct == 1.25


def test_summary_lines_agree_with_their_own_numbers(report):
    t = S.totals_lines(report, []).first()
    assert round(t.live_total / t.frames, 1) == t.live_avg and round(t.ref_total / t.frames, 1) == t.ref_avg
    s = S.steady_lines(report, []).first()
    assert round((t.live_total - 100.0) / 9, 1) == s.live_steady and s.label == "slower" and s.ratio == 2.67
    b = S.budget_lines(report, []).first()
    assert (b.met, b.n) == (4, 9) and round(100 * b.met / b.n) == b.pct


def test_site_lines(report):
    calls = {r.site: (r.calls, r.total_ms) for r in S.site_calls(report, []).collect()}
    assert calls == {"alpha": (30, 120.5), "beta_two": (60, 30.0)}
    cpu = {r.site: r.cpu_ms for r in S.site_cpu(report, []).collect()}
    assert cpu.pop("TOTAL", 76.0) == 76.0 and sum(cpu.values()) == 76.0
    c = S.cache_lines(report, []).first()
    assert (c.hits, c.misses) == (500, 20) and c.miss_ms / c.misses == 2.0
    assert report.where(S.no_match(F.col("value"), [S.FRAME_LINE, S.LIVE_LINE])).count() == 6


def test_class_counts_make_whole_pictures(report):
    c = S.live_lines(report, []).withColumn("blocks", F.lit(108)).withColumn("frames", F.lit(10))
    names = [n for n in c.columns if n not in ("blocks", "frames")]
    r = P.reconcile(c, names, F.col("blocks"), F.col("frames")).first()
    assert (r.classified, r.frames_decoded, r.whole_frames, r.extra_frames) == (1296, 12, True, 2)


def test_trace(spark):
    lines = ["# start", "OPEN\ttype=1\tconn=0x51", "TAIL\tconn=0x51\ttype=gl\tfinal record op=0x07 at +0x90",
             "FLUSH\tconn=0x51\tn=2\trecords=6\twords=60", "FLUSH\tconn=0x51\tn=3\trecords=2\twords=14",
             f"CLOSE\tconn=0x51\trecords=8\twords=74\tHIST {HIST}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "line_no bigint, line string")
    t = S.parse_trace(df, ["line_no"])
    assert t.count() == 5
    close = t.where("kind = 'CLOSE'")
    assert X.reconcile_totals(close).first().ok
    assert X.flush_close_balance(t).first().ok
    s = X.sessions(t).first()
    assert (s.flushes, s.closed) == (2, True)
    assert t.where("kind = 'TAIL'").first().tail == "final record op=0x07 at +0x90"
    h = X.histogram(close, ["line_no"])
    assert h.agg(F.sum("cnt"), F.sum("words")).first()[:] == (8, 74)
    assert h.where("op = 43").count() == 0 and h.where("op = 47").first().words == 11
    assert h.where(X.marker_category(F.col("op")) == "hyperz configuration").count() == 1


def test_step_log_and_timeline(spark):
    lines = ["[one tag] words@+0x8: 00000005 02000000 c0003000", "[two] map: addr=0x40 size=0x8 (link-base=0x1 cursor-base=0x2 limit-base=0x3) try=1 try=2",
             "[3n] TIMELINE run 0: returned; changes at: 0.5ms(0x10) 7.25ms(0x11); done"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "line_no bigint, value string")
    p = {r.line_no: r for r in S.parse_step_log(df, ["line_no"]).collect()}
    assert p[0].tag == "one tag" and p[0].words == [5, 0x02000000, 0xC0003000]
    assert p[1].f == {"addr": "0x40", "size": "0x8", "link-base": "0x1", "cursor-base": "0x2", "limit-base": "0x3", "try": "2"}
    assert [(r.t_ms, r.v) for r in S.timeline_changes(df, []).orderBy("i").collect()] == [(0.5, 0x10), (7.25, 0x11)]


def test_word_lists_and_captures(spark, tmp_path):
    df = spark.createDataFrame([("a", "0x10, 0b101 0o17\n99,,0xffffffff")], "stream_id string, line string")
    assert [r.w for r in S.parse_word_list(df, ["stream_id"]).orderBy("dw").collect()] == [16, 5, 15, 99, 4294967295]
    good = struct.pack(">5I", 4, 8, 12, 0x50414330, 0) + struct.pack(">3I", 1, 2, 0xFFFFFFFF) + b"\1\2"
    caps = spark.createDataFrame([("g", good), ("short", b"123"), ("bad", b"\0" * 32)], "path string, content binary")
    assert [(r.dw, r.w) for r in S.capture_words(caps).orderBy("dw").collect()] == [(0, 1), (1, 2), (2, 0xFFFFFFFF)]
    assert {r.path for r in S.rejected_captures(caps).collect()} == {"short", "bad"}
    (tmp_path / "w.hex").write_text("0x1,0x2\n0x3")
    assert S.scan_word_files(spark, str(tmp_path)).count() == 3


def test_decoder_lines(spark):
    lines = ["FRAME BOUNDARY: dbg_frameno=3 frame_num=2 poc=-4 slice_type=1", "PART CENSUS: 16x16=1 16x8=2 8x16=3 8x8(whole)=4 8x8(8x4)=5 8x8(4x8)=6 8x8(4x4)=7 other=8"]
    df = spark.createDataFrame([(t,) for t in lines], "value string")
    assert S.frame_boundaries(df, []).first()[:] == (3, 2, -4, 1)
    assert S.census_lines(df, []).first()[:] == (1, 2, 3, 4, 5, 6, 7, 8)


def test_stage_table(spark):
    rows = [("small", 5.0, 4.0, 1.5), ("large", 40.0, 30.0, 12.0)]
    df = spark.createDataFrame([(c, s, ms) for c, *v in rows for s, ms in zip(("full", "nodeblock", "entropy"), v)], "clip string, stage string, ms double")
    got = {r.clip: r for r in P.stage_decomposition(df, ["clip"]).collect()}
    assert {c: round(100 * r.offloadable) for c, r in got.items()} == {"small": 70, "large": 70}
    assert round(got["small"].fps) == 200 and round(got["large"].deblock, 1) == 10.0


def test_sweep_elbow(spark):
    df = spark.createDataFrame([("a", 4, 8000.0), ("a", 8, 4100.0), ("a", 16, 2500.0), ("a", 32, 2450.0)], "k string, slots int, ms double")
    assert [r.slots for r in P.sweep_elbow(df, ["k"], "slots", "ms").where("elbow").collect()] == [32]


def test_captures_are_cut_in_parts(spark):
    head = struct.pack(">5I", 1, 2, 3, 0x50414330, 0)
    rows = [(str(n), bytearray(head + struct.pack(f">{n}I", *range(n)) + tail)) for n in (0, 1, 4, 5, 9) for tail in (b"", b"xyz")][::2] + [("odd", bytearray(head + struct.pack(">9I", *range(9)) + b"xyz"))]
    files = spark.createDataFrame(rows, "path string, content binary")
    for part in (1, 4, 4096):
        got = sorted((r.path, r.dw, r.w) for r in S.capture_words(files, part).collect())
        assert got == sorted((p, k, k) for p in ("1", "4", "5", "9", "odd") for k in range(9 if p == "odd" else int(p)))
