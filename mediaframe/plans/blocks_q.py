"""Block and pixel kernel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaframe import schemas as S
from mediaframe.functions.bits import clip, int_div
from mediaframe.functions.ordered import by_width
from mediaframe.operators import blocks as B
from mediaframe.plans import fixtures as fx
from mediaframe.plans.registry import query

KEY = ["file_id", "frame", "seq"]


def text(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


# column pass, then row pass, of the 4x4 inverse transform
IDCT = """WITH a AS (SELECT file_id, frame, seq, list_transform(range(16), lambda i: CASE i//4
    WHEN 0 THEN c[i%4+1]+c[i%4+9] + c[i%4+5]+(c[i%4+13]>>1) WHEN 1 THEN c[i%4+1]-c[i%4+9] + (c[i%4+5]>>1)-c[i%4+13]
    WHEN 2 THEN c[i%4+1]-c[i%4+9] - (c[i%4+5]>>1)+c[i%4+13] ELSE c[i%4+1]+c[i%4+9] - c[i%4+5]-(c[i%4+13]>>1) END) AS m FROM mb),
  o AS (SELECT file_id, frame, seq, list_transform(range(16), lambda i: ((CASE i%4
    WHEN 0 THEN m[i//4*4+1]+m[i//4*4+3] + m[i//4*4+2]+(m[i//4*4+4]>>1) WHEN 1 THEN m[i//4*4+1]-m[i//4*4+3] + (m[i//4*4+2]>>1)-m[i//4*4+4]
    WHEN 2 THEN m[i//4*4+1]-m[i//4*4+3] - (m[i//4*4+2]>>1)+m[i//4*4+4] ELSE m[i//4*4+1]+m[i//4*4+3] - m[i//4*4+2]-(m[i//4*4+4]>>1) END)+32)>>6) AS r FROM a)"""


@query(
    "blocks_inverse_transform",
    IDCT + " SELECT file_id, frame, seq, array_to_string(r, ',') AS natural, array_to_string(list_transform(range(16), lambda i: r[(i%4)*4+i//4+1]), ',') AS transposed FROM o",
    ["mb"],
)
def _(spark, sf):
    mb = fx.macroblocks(spark, sf).select(*KEY, "c")
    t = B.inverse_transform(mb, "c", "n")
    return t.select(*KEY, text("n").alias("natural"), text(B.transpose4(F.col("n"))).alias("transposed"))


@query(
    "blocks_luma_dc",
    """WITH a AS (SELECT file_id, frame, seq, 100+cbp AS q, list_transform(range(16), lambda i: c[i//4*4+1]
        + CASE WHEN i%4 IN (0,1) THEN 1 ELSE -1 END*c[i//4*4+2] + CASE WHEN i%4 IN (0,3) THEN 1 ELSE -1 END*c[i//4*4+3] + CASE WHEN i%4 IN (0,2) THEN 1 ELSE -1 END*c[i//4*4+4]) AS m FROM mb)
       SELECT file_id, frame, seq, array_to_string(list_transform(range(16), lambda i: ((m[i%4+1]
        + CASE WHEN i//4 IN (0,1) THEN 1 ELSE -1 END*m[i%4+5] + CASE WHEN i//4 IN (0,3) THEN 1 ELSE -1 END*m[i%4+9] + CASE WHEN i//4 IN (0,2) THEN 1 ELSE -1 END*m[i%4+13])*q+128)>>8), ',') AS dc FROM a""",
    ["mb"],
)
def _(spark, sf):
    mb = fx.macroblocks(spark, sf).select(*KEY, "c", "cbp")
    return B.luma_dc(mb, "c", 100 + F.col("cbp")).select(*KEY, text("dc_out").alias("dc"))


@query(
    "blocks_chroma_dc",
    """SELECT file_id, frame, seq, array_to_string(list_transform([c[1]+c[2]+c[3]+c[4], c[1]-c[2]+c[3]-c[4], c[1]+c[2]-c[3]-c[4], c[1]-c[2]-c[3]+c[4]], lambda v: (v*(50+cbp))>>7), ',') AS dc FROM mb""",
    ["mb"],
)
def _(spark, sf):
    mb = fx.macroblocks(spark, sf)
    c = [F.get("c", F.lit(i)) for i in range(4)]
    return mb.select(*KEY, text(B.chroma_dc(*c, 50 + F.col("cbp"))).alias("dc"))


@query(
    "blocks_scatter",
    IDCT + """ SELECT file_id, frame, seq, CASE WHEN b<16 THEN 0 ELSE (b-16)//4+1 END AS plane,
       CASE WHEN b<16 THEN [0,0,1,1,0,0,1,1,2,2,3,3,2,2,3,3][b+1] ELSE ((b-16)%4)//2 END*4+i//4 AS y,
       CASE WHEN b<16 THEN [0,1,0,1,2,3,2,3,0,1,0,1,2,3,2,3][b+1] ELSE (b-16)%2 END*4+i%4 AS x, r[i+1] AS v FROM (SELECT *, seq%24 AS b FROM o), range(16) t(i)""",
    ["mb"],
)
def _(spark, sf):
    t = B.inverse_transform(fx.macroblocks(spark, sf).select(*KEY, "c"), "c").withColumn("b", F.col("seq") % 24)
    return B.scatter(t, KEY, "b", "residual")


@query(
    "blocks_dc_order",
    f"SELECT file_id, frame, seq, array_to_string(list_transform({list(S.LUMA_DC_FROM)}, lambda i: c[i+1]), ',') AS dc FROM mb",
    ["mb"],
)
def _(spark, sf):
    ordered = F.transform(B.dc_order(F.col("c")), lambda v: v.cast("string"))
    return fx.macroblocks(spark, sf).select(*KEY, F.array_join(ordered, ",").alias("dc"))


# filter sums and half samples with clamped edges
TAPS = """WITH cl AS (SELECT frame, x, y, ref AS v FROM pix),
  g AS (SELECT frame, list(v ORDER BY y, x) AS a FROM cl GROUP BY frame),
  xy AS (SELECT frame, a, x, y FROM g, range({lo},{hi}) tx(x), range({lo},{hi}) ty(y)),
  hr AS (SELECT frame, x, y, a[least(7,greatest(0,y))*8+least(7,greatest(0,x))+1] AS v,
     (SELECT sum([1,-5,20,20,-5,1][k+1]*a[least(7,greatest(0,y))*8+least(7,greatest(0,x+k-2))+1]) FROM range(6) t(k))::BIGINT AS h_raw,
     (SELECT sum([1,-5,20,20,-5,1][k+1]*a[least(7,greatest(0,y+k-2))*8+least(7,greatest(0,x))+1]) FROM range(6) t(k))::BIGINT AS v_raw FROM xy),
  hc AS (SELECT *, least(255,greatest(0,(h_raw+16)>>5)) AS half_h, least(255,greatest(0,(v_raw+16)>>5)) AS half_v FROM hr)"""


@query("blocks_half_pel", TAPS.format(lo=0, hi=8) + " SELECT frame, y, x, h_raw, v_raw, half_h, half_v FROM hc", ["pix"])
def _(spark, sf):
    px = fx.pixel_version(spark, sf, "ref").drop("plane")
    return B.half_pel(px, ["frame"]).drop("v")


@query(
    "blocks_half_pel_inside",
    TAPS.format(lo=0, hi=8) + """ SELECT frame, y, x, CASE WHEN x BETWEEN 2 AND 4 THEN h_raw END AS h_raw, CASE WHEN y BETWEEN 2 AND 4 THEN v_raw END AS v_raw,
      CASE WHEN x BETWEEN 2 AND 4 THEN half_h END AS half_h, CASE WHEN y BETWEEN 2 AND 4 THEN half_v END AS half_v FROM hc""",
    ["pix"],
)
def _(spark, sf):
    px = fx.pixel_version(spark, sf, "ref").drop("plane")
    return B.half_pel(px, ["frame"], clamp=False).drop("v")


CENTRE = (
    TAPS
    + """, cc AS (SELECT *, least(255,greatest(0,((h2+h3)*20-(h1+h4)*5+h0+h5+512)>>10)) AS half_c,
     least(255,greatest(0,((((h2+16)>>5)+((h3+16)>>5))*20-(((h1+16)>>5)+((h4+16)>>5))*5+((h0+16)>>5)+((h5+16)>>5)+16)>>5)) AS rounded FROM (
     SELECT *, lag(h_raw,2) OVER q AS h0, lag(h_raw) OVER q AS h1, h_raw AS h2, lead(h_raw) OVER q AS h3, lead(h_raw,2) OVER q AS h4, lead(h_raw,3) OVER q AS h5 FROM hc
     WINDOW q AS (PARTITION BY frame, x ORDER BY y)))"""
)


@query("blocks_centre", CENTRE.format(lo=-3, hi=12) + " SELECT frame, y, x, half_c, rounded FROM cc WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7", ["pix"])
def _(spark, sf):
    px = fx.pixel_version(spark, sf, "ref").drop("plane")
    h = B.half_pel(px, ["frame"])
    both = B.centre(B.centre(h, ["frame"], rounded_middle=True).withColumnRenamed("half_c", "rounded"), ["frame"])
    return both.select("frame", "y", "x", "half_c", "rounded")


PHASES = (
    CENTRE
    + """, ph AS (SELECT *, lead(v) OVER r AS vr, lead(half_v) OVER r AS hvr, lead(v) OVER d AS vb, lead(half_h) OVER d AS hhb FROM cc
      WINDOW r AS (PARTITION BY frame, y ORDER BY x), d AS (PARTITION BY frame, x ORDER BY y))"""
)
PICK = """CASE fy*4+fx WHEN 0 THEN v WHEN 1 THEN (v+half_h+1)>>1 WHEN 2 THEN half_h WHEN 3 THEN (vr+half_h+1)>>1 WHEN 4 THEN (v+half_v+1)>>1 WHEN 5 THEN (half_h+half_v+1)>>1
  WHEN 6 THEN (half_h+half_c+1)>>1 WHEN 7 THEN (half_h+hvr+1)>>1 WHEN 8 THEN half_v WHEN 9 THEN (half_v+half_c+1)>>1 WHEN 10 THEN half_c WHEN 11 THEN (half_c+hvr+1)>>1
  WHEN 12 THEN (vb+half_v+1)>>1 WHEN 13 THEN (hhb+half_v+1)>>1 WHEN 14 THEN (half_c+hhb+1)>>1 ELSE (hhb+hvr+1)>>1 END"""


@query(
    "blocks_quarter_pel",
    PHASES.format(lo=-3, hi=12) + f" SELECT frame, y, x, p AS phase, {PICK} AS sample FROM (SELECT *, p%4 AS fx, p//4 AS fy FROM ph, range(16) t(p) WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7)",
    ["pix"],
)
def _(spark, sf):
    px = fx.pixel_version(spark, sf, "ref").drop("plane")
    p = B.phase_inputs(px, ["frame"]).withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return p.select("frame", "y", "x", "phase", B.quarter_pel(F.col("phase") % 4, F.shiftright("phase", 2)).alias("sample"))


@query(
    "blocks_motion_compensate",
    PHASES.format(lo=-8, hi=16) + f""" SELECT frame, oy AS y, ox AS x, {PICK} AS pred FROM (SELECT p.frame AS mframe, p.y AS oy, p.x AS ox, g.mv_x&3 AS fx, g.mv_y&3 AS fy,
        least(9,greatest(-4,p.x+(g.mv_x>>2))) AS sx, least(9,greatest(-4,p.y+(g.mv_y>>2))) AS sy FROM pix p JOIN grid g ON g.frame=p.frame AND g.brow=p.y//4 AND g.bcol=p.x//4) m
      JOIN ph ON ph.frame=m.mframe AND ph.x=m.sx AND ph.y=m.sy""",
    ["pix", "grid"],
)
def _(spark, sf):
    px = fx.pixel_version(spark, sf, "ref").drop("plane")
    return B.motion_compensate(px.drop("v"), fx.block_grid(spark, sf), px, 8, 8, cell=4)


@query(
    "blocks_bilinear",
    """SELECT frame, y, x, (CASE WHEN (8-a)*(8-b)=0 THEN 0 ELSE (8-a)*(8-b)*v END+CASE WHEN a*(8-b)=0 THEN 0 ELSE a*(8-b)*r END+CASE WHEN (8-a)*b=0 THEN 0 ELSE (8-a)*b*d END+CASE WHEN a*b=0 THEN 0 ELSE a*b*rd END+32)>>6 AS sample
       FROM (SELECT frame, y, x, v, r, a, b, lead(v) OVER q AS d, lead(r) OVER q AS rd FROM (SELECT frame, y, x, ref AS v, frame%8 AS a, (frame//8)%8 AS b, lead(ref) OVER (PARTITION BY frame, y ORDER BY x) AS r FROM pix)
         WINDOW q AS (PARTITION BY frame, x ORDER BY y))""",
    ["pix"],
)
def _(spark, sf):
    px = fx.pixel_version(spark, sf, "ref").drop("plane")
    return B.bilinear(px, ["frame"], F.col("frame") % 8, int_div(F.col("frame"), 8) % 8).drop("v")


@query(
    "blocks_add_residual",
    "SELECT frame, y, x, least(255,greatest(0,ref+CASE WHEN g.coded THEN (p.frame*5+p.y*3+p.x)%401-200 ELSE 0 END)) AS v FROM pix p JOIN grid g USING (frame) WHERE g.brow=p.y//4 AND g.bcol=p.x//4",
    ["pix", "grid"],
)
def _(spark, sf):
    pred = fx.pixel_version(spark, sf, "ref").select("frame", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").alias("pred"))
    cells = fx.block_grid(spark, sf).where("coded").select("frame", "brow", "bcol", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    y, x = (F.col("brow") * 4 + F.shiftright("i", 2)).cast("int"), (F.col("bcol") * 4 + F.col("i") % 4).cast("int")
    res = cells.select("frame", y.alias("y"), x.alias("x")).withColumn("r", (F.col("frame") * 5 + F.col("y") * 3 + F.col("x")) % 401 - 200)
    return B.add_residual(pred, res, ["frame", "y", "x"])


@query(
    "blocks_coded_ids",
    "SELECT file_id, frame, seq, row_number() OVER (PARTITION BY file_id, frame ORDER BY seq)-1 AS coded_id FROM mb WHERE coded AND len(list_filter(c, lambda v: v<>0))>0",
    ["mb"],
)
def _(spark, sf):
    mb = fx.macroblocks(spark, sf)
    sparse = mb.select(*KEY, F.when(F.col("coded"), F.col("c")).otherwise(F.array_repeat(F.lit(0), 16)).alias("c"))
    return B.coded_ids(sparse, ["file_id", "frame"], ["seq"], by_width("seq"), "c")


@query(
    "blocks_edge_strength",
    """WITH s AS MATERIALIZED (SELECT file_id, frame, mb_y, mb_x, coded, mv_x, mv_y FROM mb),
       o AS (SELECT file_id, frame, mb_y, mb_x+1 AS mb_x, 'V' AS edge, coded, mv_x, mv_y FROM s UNION ALL SELECT file_id, frame, mb_y+1, mb_x, 'H', coded, mv_x, mv_y FROM s)
       SELECT a.file_id, a.frame, a.mb_y AS brow, a.mb_x AS bcol, edge, CASE WHEN a.coded OR o.coded THEN 2 ELSE 1 END AS strength
       FROM s a JOIN o ON a.file_id=o.file_id AND a.frame=o.frame AND a.mb_y=o.mb_y AND a.mb_x=o.mb_x WHERE a.coded OR o.coded OR a.mv_x<>o.mv_x OR a.mv_y<>o.mv_y""",
    ["mb"],
)
def _(spark, sf):
    g = fx.macroblocks(spark, sf).select("file_id", "frame", F.col("mb_y").alias("brow"), F.col("mb_x").alias("bcol"), "coded", "mv_x", "mv_y")
    return B.edge_strength(g, ["file_id", "frame"])


EDGES = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 15+l_partkey%30 AS alpha, 6+l_partkey%10 AS beta, l_partkey%5-1 AS tc,
  list_transform(range(4), lambda r: list_transform(range(6), lambda k: (l_partkey*(k+1)+l_suppkey*r)%24+100)) AS win FROM lineitem)"""


def edge_rows(spark, sf):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = F.array(*[F.array(*[((p * (k + 1) + s * r) % 24 + 100).cast("int") for k in range(6)]) for r in range(4)])
    tc = (p % 5 - 1).cast("int")
    return fx.spread(fx.table(spark, sf, "lineitem").select(*fx.LINE_ORDER)).select(
        *fx.LINE_ORDER, (15 + p % 30).cast("int").alias("alpha"), (6 + p % 10).cast("int").alias("beta"), F.array_repeat(tc, 4).alias("tc0"), rows.alias("window")
    )


SMOOTH = """list_transform(win, lambda w: CASE WHEN tc>=0 AND abs(w[3]-w[4])<alpha AND abs(w[2]-w[3])<beta AND abs(w[5]-w[4])<beta THEN [
   w[2]+CASE WHEN abs(w[1]-w[3])<beta THEN least(tc,greatest(-tc,((w[1]+((w[3]+w[4]+1)>>1))>>1)-w[2])) ELSE 0 END,
   least(255,greatest(0,w[3]+least(tc+CASE WHEN abs(w[1]-w[3])<beta THEN 1 ELSE 0 END+CASE WHEN abs(w[6]-w[4])<beta THEN 1 ELSE 0 END,greatest(-(tc+CASE WHEN abs(w[1]-w[3])<beta THEN 1 ELSE 0 END+CASE WHEN abs(w[6]-w[4])<beta THEN 1 ELSE 0 END),((w[4]-w[3])*4+(w[2]-w[5])+4)>>3)))),
   least(255,greatest(0,w[4]-least(tc+CASE WHEN abs(w[1]-w[3])<beta THEN 1 ELSE 0 END+CASE WHEN abs(w[6]-w[4])<beta THEN 1 ELSE 0 END,greatest(-(tc+CASE WHEN abs(w[1]-w[3])<beta THEN 1 ELSE 0 END+CASE WHEN abs(w[6]-w[4])<beta THEN 1 ELSE 0 END),((w[4]-w[3])*4+(w[2]-w[5])+4)>>3)))),
   w[5]+CASE WHEN abs(w[6]-w[4])<beta THEN least(tc,greatest(-tc,((w[6]+((w[3]+w[4]+1)>>1))>>1)-w[5])) ELSE 0 END] ELSE w[2:5] END)"""


@query(
    "blocks_smooth_edge",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(flatten({SMOOTH}), ',') AS pixels FROM {EDGES}",
)
def _(spark, sf):
    e = edge_rows(spark, sf)
    out = F.transform("window", lambda w: B.smooth_edge(w, F.col("alpha"), F.col("beta"), F.get("tc0", F.lit(0))))
    return e.select(*fx.LINE_ORDER, text(F.flatten(out)).alias("pixels"))


@query(
    "blocks_edge_candidates",
    f"""SELECT l_suppkey, min(l_orderkey) AS first, count(*) AS candidates FROM {EDGES} WHERE tc>0 AND len(list_filter(win, lambda w: abs(w[3]-w[4])<alpha AND abs(w[2]-w[3])<beta AND abs(w[5]-w[4])<beta
        AND least(tc+2,greatest(-tc-2,((w[4]-w[3])*4+(w[2]-w[5])+4)>>3))<>0))>0 GROUP BY l_suppkey""",
)
def _(spark, sf):
    return B.first_candidates(edge_rows(spark, sf), ["l_suppkey"], "l_orderkey")


YUV = "(SELECT frame, p, ref AS y, live AS u, (ref*3+live)%256 AS v FROM pix)"


def _yuv(spark, sf):
    return fx.pixels(spark, sf).select("frame", "p", F.col("ref").alias("y"), F.col("live").alias("u"), ((F.col("ref") * 3 + F.col("live")) % 256).alias("v"))


def _clip_sql(e: str) -> str:
    return f"least(255,greatest(0,{e}))"


@query(
    "blocks_rgb_limited",
    "SELECT frame, p, " + ", ".join(
        f"{_clip_sql(f'trunc({e}+0.5::DOUBLE)::BIGINT')} AS {n}"
        for n, e in (("r", "1.164::DOUBLE*(y-16)+1.596::DOUBLE*(v-128)"), ("g", "1.164::DOUBLE*(y-16)-0.392::DOUBLE*(u-128)-0.813::DOUBLE*(v-128)"), ("b", "1.164::DOUBLE*(y-16)+2.017::DOUBLE*(u-128)"))
    ) + f" FROM {YUV}",
    ["pix"],
)
def _(spark, sf):
    c = F.col
    return _yuv(spark, sf).select("frame", "p", *B.rgb_limited(c("y"), c("u"), c("v")))


@query(
    "blocks_rgb_full",
    f"""SELECT frame, p, {_clip_sql('y+trunc(1.402::DOUBLE*(v-128))::BIGINT')} AS r, {_clip_sql('y-trunc(0.344136::DOUBLE*(u-128))::BIGINT-trunc(0.714136::DOUBLE*(v-128))::BIGINT')} AS g,
        {_clip_sql('y+trunc(1.772::DOUBLE*(u-128))::BIGINT')} AS b FROM {YUV}""",
    ["pix"],
)
def _(spark, sf):
    c = F.col
    return _yuv(spark, sf).select("frame", "p", *B.rgb_full(c("y"), c("u"), c("v")))


@query(
    "blocks_upsample_join",
    "SELECT l.frame, l.y, l.x, l.ref AS luma, c.live AS u, 255-c.live AS v FROM pix l JOIN pix c ON c.frame=l.frame AND c.p<16 AND c.p//4=l.y//2 AND c.p%4=l.x//2",
    ["pix"],
)
def _(spark, sf):
    luma = fx.pixel_version(spark, sf, "ref").drop("plane")
    small = fx.pixels(spark, sf).where("p < 16")
    chroma = small.select("frame", F.shiftright("p", 2).alias("y"), (F.col("p") % 4).alias("x"), F.col("live").alias("u"), (255 - F.col("live")).alias("v"))
    return B.upsample_join(luma, chroma)


@query("blocks_clip", "SELECT event_id, least(200,greatest(50,event_id%400-70)) AS v FROM events")
def _(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", clip(F.col("event_id") % 400 - 70, 50, 200).alias("v"))
