"""Macroblock and motion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaframe.functions.bits import int_div
from mediaframe.functions.ordered import by_width, first_k, running_sum
from mediaframe.operators import motion as M
from mediaframe.plans import fixtures as fx
from mediaframe.plans.registry import query

KEY = ["file_id", "frame", "seq"]
ROUTE = "SELECT file_id, frame, seq, route FROM route"


@query(
    "motion_type_flags",
    """SELECT file_id, frame, seq, mb_type & 1 <> 0 AS intra4x4, mb_type & 2 <> 0 AS intra16x16, mb_type & 4 <> 0 AS pcm, mb_type & 8 <> 0 AS p16x16,
       mb_type & 16 <> 0 AS p16x8, mb_type & 32 <> 0 AS p8x16, mb_type & 64 <> 0 AS p8x8, mb_type & 49152 <> 0 AS list1,
       mb_type & 131072 <> 0 AS skip, mb_type & 16777216 <> 0 AS dct8x8 FROM mb""",
    ["mb"],
)
def _(spark, sf):
    return fx.macroblocks(spark, sf).select(*KEY, *M.type_flags(F.col("mb_type")))


@query("motion_routing", ROUTE, ["route"])
def _(spark, sf):
    r = M.route(F.col("mb_type"), F.col("slice"), F.col("mb_x"), F.col("mb_y"))
    return fx.macroblocks(spark, sf).select(*KEY, r.alias("route"))


@query("motion_outcomes", "SELECT file_id, frame, seq, route, reason, reason IS NULL AS taken FROM outc", ["outc"])
def _(spark, sf):
    return M.outcomes(fx.macroblock_info(spark, sf)).select(*KEY, "route", "reason", "taken")


@query(
    "motion_outcome_counts",
    "SELECT route, count(*) FILTER (reason IS NULL) AS taken, count(*) FILTER (reason IS NOT NULL) AS declined FROM outc GROUP BY route",
    ["outc"],
)
def _(spark, sf):
    return M.outcome_counts(M.outcomes(fx.macroblock_info(spark, sf)))


@query(
    "motion_decline_reasons",
    "SELECT route, reason, count(*) AS n FROM outc WHERE reason IS NOT NULL GROUP BY ALL",
    ["outc"],
)
def _(spark, sf):
    out = M.outcomes(fx.macroblock_info(spark, sf))
    return out.where("reason is not null").groupBy("route", "reason").agg(F.count("*").alias("n"))


@query("motion_partitions", "SELECT file_id, frame, seq, n, x_off, y_off, w, h FROM part", ["part"])
def _(spark, sf):
    return fx.macroblocks(spark, sf).select(*KEY, F.inline(M.partitions(F.col("mb_type"), F.col("sub"))))


@query(
    "motion_shape_census",
    """SELECT shape, count(*) AS n FROM (SELECT unnest(CASE WHEN mb_type & 8 <> 0 THEN ['16x16'] WHEN mb_type & 16 <> 0 THEN ['16x8'] WHEN mb_type & 32 <> 0 THEN ['8x16']
       WHEN mb_type & 64 <> 0 THEN list_transform(sub, lambda s: CASE s WHEN 8 THEN '8x8' WHEN 16 THEN '8x8:8x4' WHEN 32 THEN '8x8:4x8' ELSE '8x8:4x4' END) ELSE ['other'] END) AS shape
       FROM mb WHERE mb_type & 7 = 0) GROUP BY shape""",
    ["mb"],
)
def _(spark, sf):
    return M.shape_census(fx.macroblocks(spark, sf))


@query(
    "motion_part_vectors",
    """SELECT file_id, frame, seq, n, x_off, y_off, w, h, pmv_x AS mv_x, pmv_y AS mv_y, part_ref, h_phase, v_phase, pel_x, pel_y, ch_phase, cv_phase, cpel_x, cpel_y,
       part_ref=ref AS ref_agrees, luma_ok, chroma_ok, CASE WHEN diag THEN 'diag' ELSE 'single' END AS family FROM part""",
    ["part"],
)
def _(spark, sf):
    return M.explode_partitions(fx.macroblock_info(spark, sf), KEY)


@query(
    "motion_margins",
    "SELECT luma_ok, chroma_ok, count(*) AS n FROM part GROUP BY ALL",
    ["part"],
)
def _(spark, sf):
    return M.explode_partitions(fx.macroblock_info(spark, sf), KEY).groupBy("luma_ok", "chroma_ok").agg(F.count("*").alias("n"))


@query(
    "motion_refs_agree",
    "SELECT file_id, frame, seq, bool_and(part_ref=ref) AS agree FROM part GROUP BY ALL",
    ["part"],
)
def _(spark, sf):
    mb = fx.macroblock_info(spark, sf)
    a = M.refs_agree(F.col("mb_type"), F.col("sub"), F.col("ref_l0"), F.col("base_ref"))
    return mb.select(*KEY, a.alias("agree")).where("agree is not null")


@query(
    "motion_phase_classes",
    """SELECT class9, pattern4, count(*) AS n FROM (SELECT
         CASE WHEN fx=0 AND fy=0 THEN 0 WHEN fx=2 AND fy=0 THEN 1 WHEN fx=0 AND fy=2 THEN 2 WHEN fy=0 THEN 3 WHEN fx=0 THEN 4
           WHEN fx%2=1 AND fy%2=1 THEN 5 WHEN fx=2 AND fy=2 THEN 6 WHEN fx=2 THEN 7 ELSE 8 END AS class9,
         CASE WHEN fy=0 AND fx%2=1 THEN 'full_h' WHEN fx=0 AND fy%2=1 THEN 'full_v' WHEN fx%2=1 AND fy%2=1 THEN 'h_v'
           WHEN (fx=2 AND fy%2=1) OR (fy=2 AND fx%2=1) THEN 'half_diag' END AS pattern4
       FROM (SELECT mv_x & 3 AS fx, mv_y & 3 AS fy FROM mb)) GROUP BY ALL""",
    ["mb"],
)
def _(spark, sf):
    mb = fx.macroblocks(spark, sf)
    x, y = F.col("mv_x"), F.col("mv_y")
    return mb.groupBy(M.phase_class9(x, y).alias("class9"), M.phase_pattern4(x, y).alias("pattern4")).agg(F.count("*").alias("n"))


@query(
    "motion_phase_families",
    "SELECT CASE WHEN diag THEN 'diag' ELSE 'single' END AS family, count(*) AS n FROM part GROUP BY ALL",
    ["part"],
)
def _(spark, sf):
    return M.explode_partitions(fx.macroblock_info(spark, sf), KEY).groupBy("family").agg(F.count("*").alias("n"))


@query(
    "motion_survey",
    """SELECT frame, mb_y, mb_x, file_id, seq, mb_type, mv_x, mv_y, mv_x & 3 AS fx, mv_y & 3 AS fy, ref FROM mb
       WHERE frame>=1 AND (mv_x<>0 OR mv_y<>0) ORDER BY file_id, frame, seq LIMIT 15""",
    ["mb"],
)
def _(spark, sf):
    return M.survey(fx.macroblocks(spark, sf), KEY)


@query(
    "motion_first_per_phase",
    """WITH c AS (SELECT *, (mv_y & 3)*4+(mv_x & 3) AS cls FROM mb WHERE frame>=1 AND ref=0)
       SELECT k.cls, f.n, f.file_id, f.frame, f.seq, f.mb_x, f.mb_y, f.mv_x, f.mv_y, f.n IS NOT NULL AS found FROM range(16) k(cls) LEFT JOIN
       (SELECT *, count(*) OVER (PARTITION BY cls) AS n, row_number() OVER (PARTITION BY cls ORDER BY file_id, frame, seq) AS r FROM c) f ON f.cls=k.cls AND f.r=1""",
    ["mb"],
)
def _(spark, sf):
    mb = fx.macroblocks(spark, sf)
    picked = mb.where((F.col("frame") >= 1) & (F.col("ref") == 0))
    cls = (F.col("mv_y").bitwiseAND(F.lit(3)) * 4 + F.col("mv_x").bitwiseAND(F.lit(3))).cast("bigint")
    return M.first_per_class(picked, cls, KEY, ["mb_x", "mb_y", "mv_x", "mv_y"], spark.range(16).toDF("cls"))


@query(
    "motion_first_blocks",
    """SELECT file_id, rank, mb_x, mb_y, mb_type, mv_x, mv_y, ref, nnz_sum FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY seq)-1 AS rank,
       list_sum(list_transform(c, lambda v: CASE WHEN abs(v)%7=0 THEN 0 ELSE abs(v)%5 END))::BIGINT AS nnz_sum FROM mb WHERE frame=0) WHERE rank<8""",
    ["mb"],
)
def _(spark, sf):
    mb = fx.macroblocks(spark, sf).where("frame = 0")
    nnz = F.transform("c", lambda v: F.when(F.abs(v) % 7 == 0, 64).otherwise(F.abs(v) % 5))
    m = mb.select("file_id", "seq", "mb_x", "mb_y", "mb_type", "mv_x", "mv_y", "ref", M.nnz_sum(nnz).alias("nnz_sum"))
    return first_k(m, ["file_id"], ["seq"], 8).drop("seq")


@query(
    "motion_reference_groups",
    """WITH g AS (SELECT file_id, frame, ref, CASE WHEN diag THEN 'diag' ELSE 'single' END AS family, count(*) AS n, min(seq*16+n) AS first FROM (SELECT * REPLACE (part_ref AS ref) FROM part) GROUP BY ALL),
       f AS (SELECT file_id, frame, ref, row_number() OVER (PARTITION BY file_id, frame ORDER BY min(first), ref)-1 AS ref_no FROM g GROUP BY file_id, frame, ref)
       SELECT file_id, frame, ref, family, n, first, ref_no, ref_no<3 AS within_cap FROM g JOIN f USING (file_id, frame, ref)""",
    ["part"],
)
def _(spark, sf):
    p = M.explode_partitions(fx.macroblock_info(spark, sf), KEY).withColumn("ord", F.col("seq") * 16 + F.col("n"))
    return M.reference_groups(p.withColumnRenamed("part_ref", "ref"), ["file_id", "frame"], "ord", cap=3)


PACK = """WITH RECURSIVE it AS MATERIALIZED (SELECT file_id, frame, seq, n, w, (sum(w) OVER (PARTITION BY file_id, frame ORDER BY seq, n))::BIGINT - w AS s FROM part),
  st AS (SELECT DISTINCT file_id, frame, 0::BIGINT AS s, 0 AS k FROM it UNION ALL
    SELECT st.file_id, st.frame, it.s, st.k+1 FROM st JOIN it ON it.file_id=st.file_id AND it.frame=st.frame AND it.s <= st.s+512 AND it.s+it.w > st.s+512)"""


@query(
    "motion_capacity_chunks",
    PACK + """ SELECT it.file_id, it.frame, seq, n, w, k AS chunk_no, it.s-st.s AS start_col FROM it ASOF JOIN st
       ON it.file_id=st.file_id AND it.frame=st.frame AND it.s>=st.s""",
    ["part"],
)
def _(spark, sf):
    p = fx.macroblocks(spark, sf).select(*KEY, F.inline(M.partitions(F.col("mb_type"), F.col("sub")))).select(*KEY, "n", "w")
    return M.capacity_chunks(p, ["file_id", "frame"], ["seq", "n"], by_width("seq"), "w", cap=512)


@query(
    "motion_fixed_chunks",
    """SELECT file_id, seq, frame, (row_number() OVER q -1)//256 AS chunk_no, (row_number() OVER q -1)%256 AS item_no FROM mb WINDOW q AS (PARTITION BY file_id ORDER BY frame, seq)""",
    ["mb"],
)
def _(spark, sf):
    mb = fx.macroblocks(spark, sf).select(*KEY)
    return M.fixed_chunks(mb, ["file_id"], ["frame", "seq"], F.struct("frame", int_div(F.col("seq"), 1 << 16)), 256)


@query(
    "motion_column_map",
    """WITH i AS (SELECT file_id, frame, seq, n, w, row_number() OVER (PARTITION BY file_id, frame ORDER BY seq, n)-1 AS r FROM part),
       s AS (SELECT *, r//256 AS chunk_no, r%256 AS item_no, (sum(w) OVER (PARTITION BY file_id, frame, r//256 ORDER BY r))::BIGINT-w AS start_col FROM i)
       SELECT file_id, frame, chunk_no, item_no, start_col, t.x AS local_x, start_col+t.x AS col FROM s, range(16) t(x) WHERE t.x<w""",
    ["part"],
)
def _(spark, sf):
    p = fx.macroblocks(spark, sf).select(*KEY, F.inline(M.partitions(F.col("mb_type"), F.col("sub")))).select(*KEY, "n", "w")
    c = M.fixed_chunks(p, ["file_id", "frame"], ["seq", "n"], by_width("seq"), 256)
    keys = ["file_id", "frame", "chunk_no"]
    laid = running_sum(c, keys, ["item_no"], by_width("item_no"), F.col("w").cast("bigint"), "start_col", inclusive=False)
    return M.column_map(laid, ["file_id", "frame"], "w")


@query(
    "motion_display_order",
    """SELECT run, f, poc, (f//12)+1 AS epoch, row_number() OVER (PARTITION BY run, f//12 ORDER BY poc)-1 AS display_no
       FROM (SELECT run, f, ((f%12)//3)*6+[0,4,2][f%3+1] AS poc FROM tim)""",
    ["tim"],
)
def _(spark, sf):
    t = fx.timings(spark, sf).select("run", "f")
    poc = int_div(F.col("f") % 12, 3) * 6 + F.get(F.array(F.lit(0), F.lit(4), F.lit(2)), (F.col("f") % 3).cast("int"))
    return M.display_order(t.withColumn("poc", poc), ["run"], "f", F.col("f") % 12 == 0, "poc")


@query(
    "motion_gated_coeffs",
    """SELECT file_id, frame, seq, array_to_string(list_transform(range(16), lambda i: (CASE WHEN (mb_type & 7 <> 0 OR cbp & 15 <> 0) AND n9<>0 THEN c[i+1] ELSE 0 END) +
         CASE WHEN i=0 AND mb_type & 7 = 0 THEN 32 ELSE 0 END), ',') AS luma,
       array_to_string(list_transform(range(16), lambda i: CASE WHEN i=0 THEN c[16]+32 WHEN cbp & 48 <> 0 AND n9<>0 THEN c[i+1] ELSE 0 END), ',') AS chroma FROM mb""",
    ["mb"],
)
def _(spark, sf):
    mb = fx.macroblocks(spark, sf)
    luma = M.gate_luma(F.col("c"), F.col("mb_type"), F.col("cbp"), F.col("n9"))
    chroma = M.gate_chroma(F.col("c"), F.col("cbp"), F.col("n9"), F.get("c", F.lit(15)))
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    return mb.select(*KEY, text(luma).alias("luma"), text(chroma).alias("chroma"))


@query(
    "motion_tracked",
    """SELECT *, track_no<500 AS within_cap FROM (SELECT route, file_id, frame, seq, row_number() OVER (PARTITION BY file_id, route ORDER BY frame, seq)-1 AS track_no FROM outc WHERE reason IS NULL)""",
    ["outc"],
)
def _(spark, sf):
    out = M.outcomes(fx.macroblock_info(spark, sf))
    block = F.struct("frame", int_div(F.col("seq"), 1 << 16))
    return M.tracked(out.select("route", *KEY, "taken"), ["file_id"], ["frame", "seq"], block, cap=500).drop("taken")
