"""Container queries: movie bytes built from documents, sample tables built from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaframe.functions.lineage import cut_lineage
from mediaframe.operators import container as C
from mediaframe.plans import fixtures as fx
from mediaframe.plans.registry import query
from mediaframe.sources import movie as mv
from mediaframe.sources.ranged import movie_rows

# sizes of every box of the assembled files
DOCS = """WITH d AS (SELECT doc_id, 'doc'||doc_id||'.mp4' AS path, len(string_split(text, chr(10))) AS n, len(string_split(text, ' '))-1 AS sp, strlen(text) AS b FROM documents),
 z AS (SELECT *, b-sp-(n-1)+4*(sp+n) AS body, CASE WHEN n<=2 THEN n ELSE 2+(n-2+2)//3 END AS nc FROM d),
 t AS (SELECT *, 20+4*n AS stsz, CASE WHEN nc>2 THEN 40 ELSE 28 END AS stsc, CASE WHEN doc_id%2=0 THEN 16+4*nc ELSE 16+8*nc END AS co, 24+body AS m FROM z),
 bx AS (SELECT path, unnest([
   {'type':'ftyp','parent_type':NULL,'depth':0,'off':0,'size':16},
   {'type':'mdat','parent_type':NULL,'depth':0,'off':16,'size':8+body},
   {'type':'moov','parent_type':NULL,'depth':0,'off':m,'size':40+139+stsz+stsc+co},
   {'type':'trak','parent_type':'moov','depth':1,'off':m+8,'size':32+139+stsz+stsc+co},
   {'type':'mdia','parent_type':'trak','depth':2,'off':m+16,'size':24+139+stsz+stsc+co},
   {'type':'minf','parent_type':'mdia','depth':3,'off':m+24,'size':16+139+stsz+stsc+co},
   {'type':'stbl','parent_type':'minf','depth':4,'off':m+32,'size':8+139+stsz+stsc+co},
   {'type':'stsd','parent_type':'stbl','depth':5,'off':m+40,'size':139},
   {'type':'stsz','parent_type':'stbl','depth':5,'off':m+40+139,'size':stsz},
   {'type':'stsc','parent_type':'stbl','depth':5,'off':m+40+139+stsz,'size':stsc},
   {'type':CASE WHEN doc_id%2=0 THEN 'stco' ELSE 'co64' END,'parent_type':'stbl','depth':5,'off':m+40+139+stsz+stsc,'size':co}], recursive := true) FROM t)"""

UNITS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),1)-1 AS s FROM documents),
 w AS (SELECT doc_id, s, unnest(string_split(line,' ')) AS word, generate_subscripts(string_split(line,' '),1)-1 AS i FROM l),
 p AS (SELECT *, 24+(sum(4+strlen(word)) OVER (PARTITION BY doc_id ORDER BY s,i))::BIGINT-strlen(word) AS off, strlen(word) AS len,
   coalesce(min(CASE WHEN word='' THEN i END) OVER (PARTITION BY doc_id, s), 1000000000) AS e FROM w),
 u AS (SELECT 'doc'||doc_id||'.mp4' AS path, s AS sample_idx, i AS nal_idx, off, len, ('0x'||left(hex(encode(word)),2))::BIGINT & 31 AS nal_type, false AS bad_tail FROM p WHERE i<e
   UNION ALL SELECT 'doc'||doc_id||'.mp4', s, e, min(off)-4, sum(len+4)::BIGINT, NULL, true FROM p WHERE i>=e GROUP BY doc_id, s, e)"""


@query("container_boxes", DOCS + " SELECT path, type, parent_type, depth, off, 8::BIGINT AS hdr, size FROM bx")
def _(spark, sf):
    return movie_rows(spark, fx.movie_folder(spark, sf), "boxes").select("path", "type", "parent_type", "depth", "off", "hdr", "size")


@query(
    "container_box_rollup",
    DOCS + """ SELECT path, parent_type, type, count(*) AS n, sum(size)::BIGINT AS bytes, grouping(path,parent_type,type)::BIGINT AS level
      FROM (SELECT path, coalesce(parent_type,'') AS parent_type, type, size FROM bx) GROUP BY ROLLUP(path,parent_type,type)""",
)
def _(spark, sf):
    return C.box_rollup(mv.boxes(fx.movie_files(spark, sf)))


@query(
    "container_tracks",
    DOCS + """ SELECT path, 1::BIGINT AS track_id, 320+doc_id%64 AS width, 240+doc_id%32 AS height, 4::BIGINT AS nal_length_size, '6764001FACD9405005BB0110' AS sps, '68EBE3CB22C0' AS pps,
       100::BIGINT AS profile_idc, 31::BIGINT AS level_idc, n AS n_samples, nc AS n_chunks, CASE WHEN nc>2 THEN 2 ELSE 1 END AS n_runs FROM t""",
)
def _(spark, sf):
    t = movie_rows(spark, fx.movie_folder(spark, sf), "tracks")
    return t.select(
        "path", "track_id", "width", "height", "nal_length_size", F.hex("sps").alias("sps"), F.hex("pps").alias("pps"),
        *C.sps_summary(F.col("sps")), F.col("sample_count").alias("n_samples"), F.size("chunk_offsets").alias("n_chunks"), F.size("first_chunk").alias("n_runs"),
    )


@query(
    "container_file_report",
    DOCS + """ SELECT path, 1::BIGINT AS track_id, 320+doc_id%64 AS width, 240+doc_id%32 AS height, 4::BIGINT AS nal_length_size, 100::BIGINT AS profile_idc, 31::BIGINT AS level_idc,
       n AS sample_count, nc AS n_chunk_offsets, CASE WHEN nc>2 THEN 2 ELSE 1 END AS n_first_chunk, body AS bytes FROM t""",
)
def _(spark, sf):
    return C.file_report(mv.tracks(fx.movie_files(spark, sf)))


@query(
    "container_decoder_config",
    DOCS + " SELECT path, '0164001FFFE1000C6764001FACD9405005BB011001000668EBE3CB22C0' AS config FROM t",
)
def _(spark, sf):
    t = mv.tracks(fx.movie_files(spark, sf))
    return t.select("path", F.hex(C.decoder_config(F.col("sps"), F.col("pps"), F.col("nal_length_size"))).alias("config"))


def _units(spark, sf):
    return movie_rows(spark, fx.movie_folder(spark, sf), "units")


@query("container_units", UNITS + " SELECT * FROM u")
def _(spark, sf):
    return _units(spark, sf).drop("track_id")


@query("container_unit_histogram", UNITS + " SELECT nal_type, count(*) AS n, sum(len)::BIGINT AS bytes FROM u WHERE NOT bad_tail GROUP BY nal_type")
def _(spark, sf):
    return C.unit_histogram(_units(spark, sf))


@query(
    "container_unit_pivot",
    UNITS + " SELECT path, " + ", ".join(f"count(*) FILTER (NOT bad_tail AND nal_type={t}) AS t{t}" for t in (1, 5, 6, 7, 8)) + " FROM u GROUP BY path",
)
def _(spark, sf):
    return C.unit_pivot(_units(spark, sf), (1, 5, 6, 7, 8))


@query(
    "container_payloads",
    """SELECT 'doc'||doc_id||'.mp4' AS path, s AS sample_idx, strlen(h)//2 AS bytes, md5(unhex(h)) AS digest FROM (
      SELECT doc_id, s, array_to_string(list_transform(string_split(line,' '), lambda w: printf('%08X', strlen(w))||hex(encode(w))), '') AS h FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),1)-1 AS s FROM documents))""",
)
def _(spark, sf):
    return movie_rows(spark, fx.movie_folder(spark, sf), "payloads").select("path", "sample_idx", F.octet_length("payload").alias("bytes"), F.md5("payload").alias("digest"))


@query(
    "container_track_samples",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),1)-1 AS s FROM documents),
       z AS (SELECT doc_id, s, strlen(line)-(len(string_split(line,' '))-1)+4*len(string_split(line,' ')) AS size FROM l)
       SELECT 'doc'||doc_id||'.mp4' AS path, 1::BIGINT AS track_id, s AS sample_idx, CASE WHEN s<2 THEN s+1 ELSE 3+(s-2)//3 END AS chunk_no,
         24+(sum(size) OVER (PARTITION BY doc_id ORDER BY s))::BIGINT-size AS off, size FROM z""",
)
def _(spark, sf):
    t = cut_lineage(mv.tracks(fx.movie_files(spark, sf)))  # parsed once, read by three branches
    return C.track_samples(t)


@query(
    "container_sample_sizes",
    """SELECT file_id, sample_idx, CASE WHEN file_id%4=0 THEN file_id+8 ELSE size END AS size FROM smp""",
    ["smp"],
)
def _(spark, sf):
    s = fx.samples(spark, sf)
    fixed = s.where("file_id % 4 = 0").groupBy("file_id").agg(F.count("*").alias("sample_count"))
    tracks = fixed.select("file_id", "sample_count", (F.col("file_id") + 8).alias("const_size"), F.lit(None).cast("array<bigint>").alias("sizes"))
    listed = s.where("file_id % 4 <> 0").select("file_id", "sample_idx", "size")
    return C.sample_sizes(tracks, ["file_id"]).unionByName(listed)


CHUNKS2 = """(SELECT file_id, chunk_no, CASE WHEN file_id%3=0 THEN chunk_off+5000000000 ELSE chunk_off END AS chunk_off FROM chk)"""


@query("container_chunk_table", "SELECT * FROM " + CHUNKS2, ["chk"])
def _(spark, sf):
    c = fx.chunks(spark, sf)
    # some files have the narrow table, some the wide one, some both
    narrow = c.where("file_id % 6 <> 3").withColumn("box_off", F.lit(100).cast("bigint"))
    wide = c.where("file_id % 3 = 0").withColumn("box_off", F.lit(900).cast("bigint")).withColumn("chunk_off", F.col("chunk_off") + F.lit(5000000000))
    return C.chunk_table(narrow, wide)


@query("container_run_rows", "SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY first_chunk)-1 AS run_no, first_chunk, spc FROM run", ["run"])
def _(spark, sf):
    r = fx.runs(spark, sf).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("first_chunk", "spc"))).alias("r"))
    t = r.select("file_id", F.col("r.first_chunk").alias("first_chunk"), F.col("r.spc").alias("samples_per_chunk"))
    return C.run_rows(t, ["file_id"])


SPC = """(SELECT file_id, chunk_no, chunk_off, coalesce((SELECT arg_max(r.spc, r.first_chunk) FROM run2 r WHERE r.file_id=c.file_id AND r.first_chunk<=c.chunk_no),
   (SELECT arg_max(r.spc, r.first_chunk) FROM run2 r WHERE r.file_id=c.file_id)) AS spc FROM chk c)"""


@query(
    "container_samples_per_chunk",
    "WITH run2 AS (SELECT file_id, CASE WHEN file_id%5=0 THEN first_chunk+2 ELSE first_chunk END AS first_chunk, spc FROM run) SELECT * FROM " + SPC,
    ["run", "chk"],
)
def _(spark, sf):
    r = fx.runs(spark, sf).withColumn("first_chunk", F.col("first_chunk") + F.when(F.col("file_id") % 5 == 0, 2).otherwise(0))
    return C.samples_per_chunk(fx.chunks(spark, sf), r)


SAMPLES = """run2 AS (SELECT * FROM run), spc AS """ + SPC + """,
  pl AS (SELECT *, (sum(spc) OVER (PARTITION BY file_id ORDER BY chunk_no))::BIGINT-spc AS f0 FROM spc),
  sa AS (SELECT s.file_id, s.sample_idx, p.chunk_no, p.chunk_off, s.size FROM smp s JOIN pl p ON p.file_id=s.file_id AND s.sample_idx>=p.f0 AND s.sample_idx<p.f0+p.spc),
  smpl AS (SELECT file_id, sample_idx, chunk_no, chunk_off+(sum(size) OVER (PARTITION BY file_id, chunk_no ORDER BY sample_idx))::BIGINT-size AS off, size FROM sa)"""


def _samples(spark, sf):
    spc = C.samples_per_chunk(fx.chunks(spark, sf), fx.runs(spark, sf))
    return C.expand_samples(fx.samples(spark, sf), spc)


@query("container_samples", "WITH " + SAMPLES + " SELECT * FROM smpl", ["smp", "run", "chk"])
def _(spark, sf):
    return _samples(spark, sf)


@query(
    "container_in_bounds",
    "WITH " + SAMPLES + " SELECT smpl.* FROM smpl WHERE off+size <= 20000000+file_id*100000",
    ["smp", "run", "chk"],
)
def _(spark, sf):
    files = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file_id"), (20000000 + F.col("s_suppkey") * 100000).alias("length"))
    return C.in_bounds(_samples(spark, sf), files)


@query("container_head_tail", "SELECT file_id, sample_idx, size FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM smp) WHERE sample_idx<5 OR sample_idx>=n-2", ["smp"])
def _(spark, sf):
    return C.head_tail(fx.samples(spark, sf))


@query("container_first_rows", "SELECT file_id, chunk_no, chunk_off, chunk_no-1 AS rank FROM chk WHERE chunk_no<=3", ["chk"])
def _(spark, sf):
    return C.first_rows(fx.chunks(spark, sf), ["file_id"], ["chunk_no"])


@query(
    "container_file_summary",
    """SELECT * FROM (SELECT file_id, count(*) AS n_samples, sum(size)::BIGINT AS bytes, max(size) AS max_size FROM smp GROUP BY file_id)
       FULL JOIN (SELECT file_id, count(*) AS n_chunks FROM chk GROUP BY file_id) USING (file_id) FULL JOIN (SELECT file_id, count(*) AS n_runs FROM run GROUP BY file_id) USING (file_id)""",
    ["smp", "run", "chk"],
)
def _(spark, sf):
    return C.file_summary(fx.samples(spark, sf), fx.chunks(spark, sf), fx.runs(spark, sf))


@query(
    "container_reject_reasons",
    """SELECT s_suppkey AS file_id, CASE WHEN s_suppkey%7=0 THEN 'no_video' WHEN n IS NULL THEN 'no_samples' WHEN s_suppkey%11=0 THEN 'no_chunks' WHEN s_suppkey%13=0 THEN 'no_runs' END AS reason
       FROM supplier LEFT JOIN (SELECT file_id, count(*) AS n FROM smp GROUP BY file_id) q ON q.file_id=s_suppkey""",
    ["smp"],
)
def _(spark, sf):
    k = F.col("file_id")
    n = fx.samples(spark, sf).groupBy("file_id").agg(F.count("*").alias("n_samples"))
    t = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("file_id")).join(n, "file_id", "left")
    t = t.select("file_id", "n_samples", (k % 7 != 0).alias("has_video"), F.when(k % 11 != 0, 400).alias("n_chunks"), F.when(k % 13 != 0, 3).alias("n_runs"))
    return C.reject_reason(t).select("file_id", "reason")
