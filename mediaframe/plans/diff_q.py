"""Version diff queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaframe.functions.bits import int_div
from mediaframe.operators import diff as D
from mediaframe.operators.motion import phase_class9
from mediaframe.plans import fixtures as fx
from mediaframe.plans.registry import query


def _diff(spark, sf):
    return D.align_packed(fx.pixel_rows(spark, sf, "live"), fx.pixel_rows(spark, sf, "ref"))


FRAME_REPORT = """SELECT frame, luma_bad, luma_total, luma_max, chroma_bad, chroma_total, chroma_max,
  100.0::DOUBLE*(luma_bad+chroma_bad)/(luma_total+chroma_total) AS pct,
  100.0::DOUBLE*(luma_bad+chroma_bad)/(luma_total+chroma_total) >= 1.0 AS significant
FROM (SELECT frame, count(*) FILTER (plane=0 AND d>2) AS luma_bad, count(*) FILTER (plane=0) AS luma_total,
  coalesce(max(d) FILTER (plane=0),0) AS luma_max, count(*) FILTER (plane>0 AND d>2) AS chroma_bad,
  count(*) FILTER (plane>0) AS chroma_total, coalesce(max(d) FILTER (plane>0),0) AS chroma_max FROM pd GROUP BY frame)"""


ALIGNED = "SELECT frame, plane, y, x, live AS v_live, ref AS v_ref, d FROM pd"


@query("diff_align", ALIGNED, ["pd"])
def _(spark, sf):
    return D.align(fx.pixel_version(spark, sf, "live"), fx.pixel_version(spark, sf, "ref"))


@query("diff_align_packed", ALIGNED, ["pd"])
def _(spark, sf):
    return _diff(spark, sf)


@query("diff_pack_rows", "SELECT frame, plane, y, string_agg(live::VARCHAR, ',' ORDER BY x) AS vs FROM pix GROUP BY frame, plane, y", ["pix"])
def _(spark, sf):
    p = D.pack_rows(fx.pixel_version(spark, sf, "live"))
    return p.withColumn("vs", F.array_join(F.transform("vs", lambda v: v.cast("string")), ","))


@query(
    "diff_missing_keys",
    """SELECT frame+3 AS frame, plane, y, x, 'ref' AS missing_in FROM pix WHERE frame+3 NOT IN (SELECT frame FROM pix)
       UNION ALL SELECT frame, plane, y, x, 'live' FROM pix WHERE frame NOT IN (SELECT frame+3 FROM pix)""",
    ["pix"],
)
def _(spark, sf):
    live, ref = fx.pixel_version(spark, sf, "live"), fx.pixel_version(spark, sf, "ref")
    return D.missing_keys(live.withColumn("frame", F.col("frame") + 3), ref)  # live starts three frames late and ends three late


@query(
    "diff_frame_counts",
    """SELECT n_live, n_ref, least(n_live,n_ref) AS compared, n_live<>n_ref AS warn FROM (
       SELECT count(DISTINCT frame//2) AS n_live, count(DISTINCT frame) AS n_ref FROM pix)""",
    ["pix"],
)
def _(spark, sf):
    live, ref = fx.pixel_version(spark, sf, "live"), fx.pixel_version(spark, sf, "ref")
    return D.frame_counts(live.withColumn("frame", int_div(F.col("frame"), 2)), ref)


@query(
    "diff_tolerance_counts",
    """SELECT plane, count(*) AS total, count(*) FILTER (d>0) AS over_0, count(*) FILTER (d>1) AS over_1,
       count(*) FILTER (d>2) AS over_2, max(d) AS max_d FROM pd GROUP BY plane""",
    ["pd"],
)
def _(spark, sf):
    return D.tolerance_counts(_diff(spark, sf), ["plane"])


@query("diff_frame_report", FRAME_REPORT, ["pd"])
def frame_report(spark, sf):
    return D.frame_report(_diff(spark, sf))


@query(
    "diff_verdict",
    f"SELECT coalesce(bool_or(significant),false) AS failed, count(*) AS frames, CASE WHEN bool_or(significant) THEN 1 ELSE 0 END AS exit_status FROM ({FRAME_REPORT})",
    ["pd"],
)
def _(spark, sf):
    return D.verdict(D.frame_report(_diff(spark, sf)))


@query(
    "diff_worst_pixel",
    """SELECT frame, d AS max_d, plane, y, x FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY d DESC, plane, y, x) AS r FROM pd) WHERE r=1""",
    ["pd"],
)
def _(spark, sf):
    return D.worst_pixel(_diff(spark, sf))


@query(
    "diff_drill_down",
    """SELECT frame, brow, bcol, sum(n)::BIGINT AS n_bad, max(m) AS max_d, grouping(frame,brow,bcol)::BIGINT AS level FROM
       (SELECT frame, brow, bcol, count(*) FILTER (d>2) AS n, max(d) AS m FROM pd GROUP BY ALL) WHERE n>0 GROUP BY ROLLUP(frame,brow,bcol)""",
    ["pd"],
)
def _(spark, sf):
    return D.drill_down(_diff(spark, sf), size=4)


@query(
    "diff_worst_block_per_class",
    """SELECT class, frame, brow, bcol, track_no, err FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY err DESC, track_no) AS r FROM (
       SELECT g.class, frame, brow, bcol, track_no, sum(d)::BIGINT AS err FROM pd JOIN grid g USING (frame,brow,bcol) WHERE d>0 GROUP BY ALL)) WHERE r=1""",
    ["pd", "grid"],
)
def _(spark, sf):
    return D.worst_block_per_class(_diff(spark, sf), fx.block_grid(spark, sf), size=4)


@query(
    "diff_first_bad_block",
    """SELECT frame, brow, bcol, track_no, err FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY track_no) AS r FROM (
       SELECT frame, brow, bcol, track_no, sum(d)::BIGINT AS err FROM pd JOIN grid USING (frame,brow,bcol) WHERE plane=1 GROUP BY ALL) WHERE err>5) WHERE r=1""",
    ["pd", "grid"],
)
def _(spark, sf):
    return D.first_bad_block(_diff(spark, sf), fx.block_grid(spark, sf), plane=1, min_err=5, size=4)


@query(
    "diff_origin_block",
    """WITH bad AS (SELECT frame, brow, bcol, sum(d)::BIGINT AS err FROM pd WHERE plane=1 GROUP BY ALL HAVING sum(d)>2),
       touched AS (SELECT b.frame, b.brow, b.bcol FROM bad b JOIN pd n ON n.frame=b.frame AND n.plane=1 AND n.d>0 AND
         ((n.x=b.bcol*4-1 AND n.y BETWEEN b.brow*4-1 AND b.brow*4+3) OR (n.y=b.brow*4-1 AND n.x BETWEEN b.bcol*4 AND b.bcol*4+3)))
       SELECT frame, brow, bcol, track_no, err FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY track_no) AS r
         FROM bad JOIN grid USING (frame,brow,bcol) WHERE NOT EXISTS (SELECT 1 FROM touched t WHERE t.frame=bad.frame AND t.brow=bad.brow AND t.bcol=bad.bcol)) WHERE r=1""",
    ["pd", "grid"],
)
def _(spark, sf):
    return D.origin_block(_diff(spark, sf), fx.block_grid(spark, sf), plane=1, min_err=2, size=4)


@query(
    "diff_tracked_errors",
    """SELECT frame, brow, bcol, track_no, class, err, d AS max_d, plane, y, x FROM (
       SELECT *, sum(d) OVER (PARTITION BY frame,brow,bcol)::BIGINT AS err, row_number() OVER (PARTITION BY frame,brow,bcol ORDER BY d DESC, plane, y, x) AS r
       FROM pd JOIN grid USING (frame,brow,bcol) WHERE d>0) WHERE r=1""",
    ["pd", "grid"],
)
def _(spark, sf):
    t = D.tracked_errors(_diff(spark, sf), fx.block_grid(spark, sf), size=4)
    return t.select("frame", "brow", "bcol", "track_no", "class", "err", "max_d", "plane", "y", "x")


@query(
    "diff_block_dump",
    """SELECT frame, plane, brow, bcol, y, string_agg(live::VARCHAR, ' ' ORDER BY x) AS live, string_agg(ref::VARCHAR, ' ' ORDER BY x) AS ref
       FROM pd SEMI JOIN (SELECT frame, brow, bcol FROM pd GROUP BY ALL HAVING max(d)>=5) b USING (frame,brow,bcol) GROUP BY frame, plane, brow, bcol, y""",
    ["pd"],
)
def _(spark, sf):
    d = _diff(spark, sf)
    wanted = D.block_errors(d, 4).where("max_d >= 5")
    return D.block_dump(d, wanted, size=4)


@query(
    "diff_mismatch_by_class",
    """SELECT CASE WHEN fx=0 AND fy=0 THEN 0 WHEN fx=2 AND fy=0 THEN 1 WHEN fx=0 AND fy=2 THEN 2 WHEN fy=0 THEN 3 WHEN fx=0 THEN 4
         WHEN fx%2=1 AND fy%2=1 THEN 5 WHEN fx=2 AND fy=2 THEN 6 WHEN fx=2 THEN 7 ELSE 8 END AS phase_class, count(*) AS n_bad
       FROM (SELECT (mv_x & 3) AS fx, (mv_y & 3) AS fy FROM pd JOIN grid USING (frame,brow,bcol) WHERE d>0) GROUP BY 1""",
    ["pd", "grid"],
)
def _(spark, sf):
    return D.mismatch_by_class(_diff(spark, sf), fx.block_grid(spark, sf), phase_class9(F.col("mv_x"), F.col("mv_y")), cell=4)


@query(
    "diff_coded_split",
    """SELECT coded, y7, x7, grouping(coded,y7,x7)::BIGINT AS level, count(*) FILTER (d>0) AS n_bad, count(*) AS n_total,
         count(*) FILTER (d>0 AND NOT coded) AS n_bad_uncoded
       FROM (SELECT d, y%8 AS y7, x%8 AS x7, g.coded FROM pd JOIN grid g USING (frame,brow,bcol)) GROUP BY GROUPING SETS ((coded),(y7),(x7))""",
    ["pd", "grid"],
)
def _(spark, sf):
    return D.coded_split(_diff(spark, sf), fx.block_grid(spark, sf).where("coded"), size=4)


@query(
    "diff_block_level",
    """SELECT count(*) AS blocks, count(*) FILTER (nb>0) AS any_bad, count(*) FILTER (nb=16) AS all_bad FROM (
       SELECT frame, brow, bcol, count(*) FILTER (d>0) AS nb FROM pd JOIN grid USING (frame,brow,bcol) WHERE coded GROUP BY ALL)""",
    ["pd", "grid"],
)
def _(spark, sf):
    return D.block_level(_diff(spark, sf), fx.block_grid(spark, sf).where("coded"), size=4)


@query(
    "diff_position_histogram",
    "SELECT (y%4)*4+x%4 AS pos, count(*) AS n_bad FROM pd JOIN grid USING (frame,brow,bcol) WHERE coded AND d>0 GROUP BY 1",
    ["pd", "grid"],
)
def _(spark, sf):
    return D.position_histogram(_diff(spark, sf), fx.block_grid(spark, sf).where("coded"), size=4)


@query(
    "diff_wrong_block_buckets",
    """WITH w AS (SELECT frame, brow, bcol, frame*4+brow*2+bcol AS block_id FROM pd GROUP BY ALL HAVING count(*) FILTER (d>0)>=3)
       SELECT 'row' AS kind, brow//2 AS bucket, count(*) AS n FROM w GROUP BY ALL UNION ALL
       SELECT 'col', bcol//2, count(*) FROM w GROUP BY ALL UNION ALL
       SELECT 'id', (block_id//100)%8, count(*) FROM w GROUP BY ALL""",
    ["pd"],
)
def _(spark, sf):
    b = D.with_blocks(_diff(spark, sf), 4).groupBy("frame", "brow", "bcol").agg(F.count_if(F.col("d") > 0).alias("nb"))
    wrong = b.where("nb >= 3").withColumn("block_id", F.col("frame") * 4 + F.col("brow") * 2 + F.col("bcol"))
    return D.wrong_block_buckets(wrong, row_bucket=2, col_bucket=2, id_bucket=100)


@query(
    "diff_first_mismatches",
    """SELECT frame, plane, y, x, live AS v_live, ref AS v_ref, d, r-1 AS rank FROM (
       SELECT *, row_number() OVER (PARTITION BY frame ORDER BY plane,y,x) AS r FROM pd WHERE d>0) WHERE r<=6""",
    ["pd"],
)
def _(spark, sf):
    return D.first_mismatches(_diff(spark, sf))


@query(
    "diff_block_totals",
    """SELECT frame, brow, bcol, count(*) FILTER (d>0) AS n_bad, max(d) AS max_d FROM pd GROUP BY GROUPING SETS ((frame,brow,bcol),())""",
    ["pd"],
)
def _(spark, sf):
    return D.block_totals(_diff(spark, sf), size=4)


@query(
    "diff_channel_check",
    """SELECT ['r','g','b','a'][p%4+1] AS channel, count(*) AS total, count(*) FILTER (abs(ref-128)>20) AS n_bad, max(abs(ref-128)) AS max_off
       FROM pix GROUP BY 1""",
    ["pix"],
)
def _(spark, sf):
    px = fx.table(spark, sf, "embeddings")
    ref = lambda i: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.get("embedding", i).cast("double") * 200 + 128)))
    pixel = F.sequence(F.lit(0), int_div(F.size("embedding"), 4) - 1)
    rgba = px.select("embedding", F.explode(pixel).alias("q")).select(*[ref((F.col("q") * 4 + i).cast("int")).alias(c) for i, c in enumerate("rgba")])
    return D.channel_check(rgba, dict.fromkeys("rgba", 128), tol=20)


@query(
    "diff_round_trip",
    """WITH v AS (SELECT event_id, event_id%65536-32768 AS v FROM events)
       SELECT event_id, v, 'split16' AS code, ((v+32768)>>8)*256+((v+32768)&255)-32768 AS decoded FROM v WHERE ((v+32768)>>8)*256+((v+32768)&255)-32768 <> v
       UNION ALL SELECT event_id, v, 'clip8', least(255,greatest(0,v+128))-128 FROM v WHERE least(255,greatest(0,v+128))-128 <> v""",
)
def _(spark, sf):
    v = fx.table(spark, sf, "events").select("event_id", (F.col("event_id") % 65536 - 32768).alias("v"))
    hi, lo = D.split16(F.col("v"))
    exact = D.round_trip(v, "v", D.join16(hi, lo), ["event_id"]).withColumn("code", F.lit("split16"))
    lossy = D.round_trip(v, "v", F.least(F.lit(255), F.greatest(F.lit(0), F.col("v") + 128)) - 128, ["event_id"])
    return exact.unionByName(lossy.withColumn("code", F.lit("clip8")))


@query("diff_content_equal", "SELECT frame, plane, bool_and(live=ref) AS equal FROM pix GROUP BY frame, plane", ["pix"])
def _(spark, sf):
    return D.content_equal(
        fx.pixel_version(spark, sf, "live"), fx.pixel_version(spark, sf, "ref"), ["frame", "plane"], ["plane", "y", "x", "v"]
    )


@query(
    "diff_invariant_breaks",
    """WITH a AS (SELECT frame, plane, sum(ref)::BIGINT AS total FROM pix GROUP BY ALL), b AS (SELECT frame, plane, sum(live)::BIGINT AS total FROM pix GROUP BY ALL)
       SELECT *, 'before' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'after' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    ["pix"],
)
def _(spark, sf):
    total = lambda v: fx.pixel_version(spark, sf, v).groupBy("frame", "plane").agg(F.sum("v").alias("total"))
    return D.invariant_breaks(total("ref"), total("live"))


@query(
    "diff_reversed_rgb",
    """SELECT frame, bool_and(CASE WHEN p%4=3 THEN true ELSE frame%7<>0 OR r0=r2 END) AS reversed FROM (
       SELECT frame, p, first_value(ref) OVER q AS r0, nth_value(ref,3) OVER q AS r2 FROM pix
       WINDOW q AS (PARTITION BY frame, p//4 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY frame""",
    ["pix"],
)
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    val = lambda i: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("embedding")[i].cast("double") * 200 + 128))).cast("string")
    quad = lambda b, order: F.concat_ws(",", *[val(4 * b + i) for i in order])
    before = F.concat_ws(" ", *[quad(b, (0, 1, 2, 3)) for b in range(16)])
    swapped = F.concat_ws(" ", *[quad(b, (2, 1, 0, 3)) for b in range(16)])
    log = e.select(F.col("vec_id").alias("frame"), before.alias("before"), F.when(F.col("vec_id") % 7 == 0, before).otherwise(swapped).alias("after"))
    parsed = log.select("frame", D.parse_tuples(F.col("before")).alias("b"), D.parse_tuples(F.col("after")).alias("a"))
    return parsed.select("frame", D.reversed_rgb(F.col("b"), F.col("a")).alias("reversed"))


@query(
    "diff_with_evidence",
    f"""SELECT failed, frames, exit_status, n_taken, NOT failed AND n_taken>0 AS ok FROM (
        SELECT coalesce(bool_or(significant),false) AS failed, count(*) AS frames, CASE WHEN bool_or(significant) THEN 1 ELSE 0 END AS exit_status FROM ({FRAME_REPORT})),
        (SELECT count(*) FILTER (coded) AS n_taken FROM grid)""",
    ["pd", "grid"],
)
def _(spark, sf):
    return D.with_evidence(D.frame_report(_diff(spark, sf)), fx.block_grid(spark, sf).select(F.col("coded").alias("taken")))


