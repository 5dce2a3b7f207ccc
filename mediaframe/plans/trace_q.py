"""Word-stream and trace queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediaframe.functions.bits import bits, byte_swap, int_div, lit_long, wrap_diff32
from mediaframe.functions.lineage import cut_lineage
from mediaframe.functions.ordered import by_span, by_width, first_k
from mediaframe.functions.spans import span_join
from mediaframe.operators import trace as X
from mediaframe.plans import fixtures as fx
from mediaframe.plans.registry import query
from mediaframe.sources.text import parse_trace

# packet headers of every stream, found by walking from word 0
HEADS = """WITH RECURSIVE st AS MATERIALIZED (SELECT stream_id, dw, w, w>>30 AS kind, CASE WHEN w=0 OR w>>30=2 THEN 0 WHEN w>>30=1 THEN 2 ELSE ((w>>16)&16383)+1 END AS cnt,
    dw+1+CASE WHEN w=0 OR w>>30=2 THEN 0 WHEN w>>30=1 THEN 2 ELSE ((w>>16)&16383)+1 END AS nxt, count(*) OVER (PARTITION BY stream_id) AS nw FROM word),
  hd AS (SELECT * FROM st WHERE dw=0 UNION ALL SELECT st.* FROM hd JOIN st ON st.stream_id=hd.stream_id AND st.dw=hd.nxt),
  h AS (SELECT *, CASE WHEN kind=0 AND w<>0 THEN (w&8191)*4 END AS base, CASE WHEN kind=0 AND w<>0 THEN w&32768<>0 END AS one_reg,
    CASE WHEN kind=3 THEN (w>>8)&255 END AS op, nxt<=nw AS complete FROM hd),
  wr AS (SELECT h.stream_id, h.dw, d.dw-h.dw-1 AS ord, CASE WHEN h.kind=0 THEN h.base+CASE WHEN h.one_reg THEN 0 ELSE 4*(d.dw-h.dw-1) END
      WHEN d.dw-h.dw=1 THEN (h.w&2047)*4 ELSE ((h.w>>11)&2047)*4 END AS addr, d.w AS value
    FROM h JOIN word d ON d.stream_id=h.stream_id AND d.dw>h.dw AND d.dw<h.nxt WHERE h.kind IN (0,1) AND h.w<>0 AND h.complete)"""
DIM = "(VALUES " + ",".join(f"({a},'{n}')" for a, n in X.register_names()) + ") dim(addr,name)"
BLOCK = "CASE " + " ".join(f"WHEN addr>={lo} AND addr<{hi} THEN '{n}'" for lo, hi, n in X.BLOCKS) + " END"
RULE = f"""CASE WHEN addr IN ({','.join(map(str, X.FORBIDDEN))}) THEN 'forbidden' WHEN addr IN ({','.join(map(str, X.HANG_RISK))}) THEN 'hang_risk'
  WHEN {BLOCK} IS NULL THEN 'outside_blocks' WHEN name IS NULL THEN 'unconfirmed' END"""
OPS = ",".join(map(str, X.OPCODES))
FIND = (
    HEADS
    + f""", fi AS (SELECT stream_id, dw, NULL::BIGINT AS ord, NULL::BIGINT AS addr, unnest(list_filter([
    CASE WHEN w=0 THEN 'zero_header' END, CASE WHEN kind=2 AND w<>2147483648 THEN 'type2_low_bits' END, CASE WHEN kind=0 AND w<>0 AND NOT complete THEN 'type0_overrun' END,
    CASE WHEN kind=1 AND NOT complete THEN 'type1_truncated' END, CASE WHEN kind=3 AND op NOT IN ({OPS}) THEN 'opcode_not_allowed' END,
    CASE WHEN kind=3 AND NOT complete THEN 'type3_overrun' END], lambda r: r IS NOT NULL)) AS rule FROM h
  UNION ALL SELECT stream_id, dw, ord, addr, {RULE} FROM (SELECT * FROM wr LEFT JOIN {DIM} USING (addr)) WHERE {RULE} IS NOT NULL),
  f AS (SELECT *, CASE WHEN rule IN ('unconfirmed','type2_low_bits') THEN 'WARN' ELSE 'ERROR' END AS severity FROM fi)"""
)


def _heads(spark, sf):
    w = cut_lineage(fx.words(spark, sf))  # the stream table, read by several branches
    return w, cut_lineage(X.packets(w))


def _writes(spark, sf):
    return X.register_writes(*_heads(spark, sf))


@query(
    "trace_bit_fields",
    """SELECT stream_id, dw, (w>>24)&255 AS top, (w>>8)&65535 AS mid, w&7 AS low,
       ((w&255)<<24)+(((w>>8)&255)<<16)+(((w>>16)&255)<<8)+((w>>24)&255) AS swapped FROM word""",
    ["word"],
)
def _(spark, sf):
    w = F.col("w")
    return fx.words(spark, sf).select("stream_id", "dw", bits(w, 31, 24).alias("top"), bits(w, 23, 8).alias("mid"), bits(w, 2, 0).alias("low"), byte_swap(w).alias("swapped"))


@query(
    "trace_record_walk",
    """SELECT o_orderkey//10 AS stream_id, (sum(2+o_orderkey%3) OVER (PARTITION BY o_orderkey//10 ORDER BY o_orderkey))::BIGINT-(2+o_orderkey%3) AS dw, o_orderkey%64 AS op,
       CASE WHEN o_orderkey%10=9 THEN 0 ELSE 2+o_orderkey%3 END AS len FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    n = (2 + k % 3).cast("int")
    o = fx.table(spark, sf, "orders").select(k)
    head = (k % 64) * 16777216 + F.when(k % 10 == 9, 0).otherwise(n)
    words = o.select(int_div(k, 10).alias("stream_id"), k.alias("k"), F.posexplode(F.concat(F.array(head), F.array_repeat(k, n - 1))).alias("i", "w"))
    words = words.select("stream_id", F.struct("k", "i").alias("at"), "w")
    # ten order keys per stream bound the window
    dw = F.row_number().over(Window.partitionBy("stream_id").orderBy("at")) - 1
    return X.record_walk(words.select("stream_id", dw.cast("bigint").alias("dw"), "w"))


@query("trace_packets", HEADS + " SELECT stream_id, dw, w, kind, cnt, base, one_reg, op, nxt, complete FROM h", ["word"])
def _(spark, sf):
    return _heads(spark, sf)[1]


@query("trace_register_writes", HEADS + " SELECT * FROM wr", ["word"])
def _(spark, sf):
    return _writes(spark, sf)


@query("trace_named_writes", HEADS + f" SELECT stream_id, dw, ord, addr, value, name FROM wr LEFT JOIN {DIM} USING (addr)", ["word"])
def _(spark, sf):
    return X.named_writes(_writes(spark, sf), X.register_dim(spark))


@query("trace_block_spans", HEADS + f" SELECT block, count(*) AS n FROM (SELECT {BLOCK} AS block FROM wr) GROUP BY block", ["word"])
def _(spark, sf):
    return _writes(spark, sf).groupBy(X.block_of(F.col("addr")).alias("block")).agg(F.count("*").alias("n"))


@query("trace_findings", FIND + " SELECT stream_id, dw, ord, addr, rule, severity FROM f", ["word"])
def _(spark, sf):
    w, h = _heads(spark, sf)
    return X.findings(w, h, X.register_dim(spark))


@query(
    "trace_policy_counts",
    HEADS + f" SELECT rule, count(*) AS n FROM (SELECT {RULE} AS rule FROM wr LEFT JOIN {DIM} USING (addr)) GROUP BY rule",
    ["word"],
)
def _(spark, sf):
    nw = X.named_writes(_writes(spark, sf), X.register_dim(spark))
    return nw.groupBy(X.write_rule(F.col("addr"), F.col("name")).alias("rule")).agg(F.count("*").alias("n"))


@query(
    "trace_unknown_opcodes",
    """SELECT op, count(*) AS n FROM (SELECT (w>>8)&255 AS op FROM (SELECT (o_orderkey*37)%4294967296 AS w FROM orders)) WHERE op NOT IN (""" + OPS + ") GROUP BY op",
)
def _(spark, sf):
    w = F.pmod(F.col("o_orderkey") * 37, lit_long(4294967296))
    heads = fx.table(spark, sf, "orders").select(F.lit(3).alias("kind"), bits(w, 15, 8).alias("op"))
    return X.unknown_opcodes(heads)


@query("trace_last_state", HEADS + " SELECT stream_id, addr, arg_max(value, (dw, ord)) AS value, count(*) AS writes FROM wr GROUP BY ALL", ["word"])
def _(spark, sf):
    return X.last_state(_writes(spark, sf))


@query("trace_distinct_registers", HEADS + " SELECT stream_id, count(DISTINCT addr) AS n_registers FROM wr GROUP BY stream_id", ["word"])
def _(spark, sf):
    return X.distinct_registers(_writes(spark, sf))


@query(
    "trace_findings_allowed",
    FIND.replace(" WHEN addr IN (" + ",".join(map(str, X.HANG_RISK)) + ") THEN 'hang_risk'", " WHEN addr IN (" + ",".join(map(str, X.HANG_RISK)) + ") THEN NULL")
    + " SELECT rule, severity, count(*) AS n FROM f GROUP BY ALL",
    ["word"],
)
def _(spark, sf):
    """Findings by rule with the switch that allows the registers that may hang."""
    w, h = _heads(spark, sf)
    return X.findings(w, h, X.register_dim(spark), allow_hang_risk=True).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query(
    "trace_findings_by_rule",
    FIND + " SELECT rule, severity, count(*) AS n FROM f GROUP BY ALL",
    ["word"],
)
def _(spark, sf):
    w, h = _heads(spark, sf)
    return X.findings(w, h, X.register_dim(spark)).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query(
    "trace_gate",
    FIND
    + """, s AS (SELECT p_partkey AS stream_id FROM part), al AS (SELECT stream_id, severity FROM f UNION ALL SELECT stream_id, 'ERROR' FROM s WHERE stream_id NOT IN (SELECT stream_id FROM word)
         UNION ALL SELECT stream_id, 'ERROR' FROM word GROUP BY stream_id HAVING count(*)+1>25)
       SELECT s.stream_id, count(*) FILTER (severity='WARN') AS warnings, count(*) FILTER (severity='ERROR') AS errors, count(*) FILTER (severity='ERROR')=0 AS pass
       FROM s LEFT JOIN al ON al.stream_id=s.stream_id GROUP BY s.stream_id""",
    ["word"],
)
def _(spark, sf):
    w, h = _heads(spark, sf)
    streams = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("stream_id"))
    too_long = X.over_capacity(w, 25).withColumn("severity", F.lit("ERROR"))
    return X.gate(streams, X.findings(w, h, X.register_dim(spark)), X.empty_streams(streams, w), too_long)


@query("trace_empty_streams", "SELECT p_partkey AS stream_id, 'empty_stream' AS rule, 'ERROR' AS severity FROM part WHERE p_partkey NOT IN (SELECT o_orderkey//10 FROM orders)")
def _(spark, sf):
    streams = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("stream_id"))
    return X.empty_streams(streams, fx.words(spark, sf)).select("stream_id", "rule", "severity")


@query(
    "trace_padded",
    "SELECT stream_id, dw, w FROM word UNION ALL SELECT stream_id, count(*), 2147483648 FROM word GROUP BY stream_id HAVING count(*)%2=1",
    ["word"],
)
def _(spark, sf):
    return X.padded(fx.words(spark, sf))


SECOND = "(SELECT stream_id, dw, CASE WHEN (stream_id*7+dw*3)%41=0 THEN w+1 ELSE w END AS w FROM word)"


def _second(words):
    changed = (F.col("stream_id") * 7 + F.col("dw") * 3) % 41 == 0
    return words.select("stream_id", "dw", F.when(changed, F.col("w") + 1).otherwise(F.col("w")).alias("w"))


@query("trace_streams_equal", f"SELECT stream_id, bool_and(a.w=b.w) AS equal FROM word a JOIN {SECOND} b USING (stream_id, dw) GROUP BY stream_id", ["word"])
def _(spark, sf):
    w = fx.words(spark, sf)
    return X.streams_equal(w, _second(w))


@query("trace_over_capacity", "SELECT stream_id, count(*) AS n_words FROM word GROUP BY stream_id HAVING count(*)+1>25", ["word"])
def _(spark, sf):
    return X.over_capacity(fx.words(spark, sf), 25)


@query(
    "trace_common_prefix",
    f"SELECT stream_id, coalesce(min(dw) FILTER (a.w<>b.w), max(dw)+1) AS prefix FROM word a JOIN {SECOND} b USING (stream_id, dw) GROUP BY stream_id",
    ["word"],
)
def _(spark, sf):
    w = fx.words(spark, sf)
    return X.common_prefix(w, _second(w))


def _payload(words):
    s = words.select("stream_id").distinct()
    at = s.select("stream_id", (1 + F.col("stream_id") % 5).alias("pos"), F.lit(0).cast("bigint").alias("head_dw"))
    n = (1 + F.col("stream_id") % 3).cast("int")
    pay = s.select("stream_id", F.posexplode(F.array_repeat(F.col("stream_id") % 256, n)).alias("k", "w")).select("stream_id", F.col("k").cast("bigint").alias("k"), "w")
    return pay, at


@query(
    "trace_insert_words",
    """SELECT stream_id, CASE WHEN dw>=1+stream_id%5 THEN dw+1+stream_id%3 ELSE dw END AS dw, CASE WHEN dw=0 THEN w+1+stream_id%3 ELSE w END AS w FROM word
       UNION ALL SELECT stream_id, 1+stream_id%5+k, stream_id%256 FROM (SELECT DISTINCT stream_id FROM word), range(3) t(k) WHERE k<1+stream_id%3""",
    ["word"],
)
def _(spark, sf):
    w = fx.words(spark, sf)
    return X.insert_words(w, *_payload(w))


@query(
    "trace_insertion_check",
    """WITH n AS (SELECT stream_id, count(*) AS n, min(CASE WHEN (stream_id*7+dw*3)%41=0 THEN dw END) AS c, max(CASE WHEN (stream_id*7+dw*3)%41=0 THEN dw END) AS c2 FROM word GROUP BY stream_id)
       SELECT stream_id, NOT coalesce(c<1+stream_id%5, false) AS before_ok, true AS payload_ok, NOT coalesce(c2>=1+stream_id%5, false) AS after_ok, true AS tail_ok,
         (n+1+stream_id%3)%2 AS size_delta, c IS NULL AS ok FROM n""",
    ["word"],
)
def _(spark, sf):
    w = fx.words(spark, sf)
    pay, at = _payload(w)
    injected = X.padded(X.insert_words(_second(w), pay, at.withColumn("head_dw", F.lit(-1).cast("bigint"))))
    return X.insertion_check(w, injected, pay, at)


@query(
    "trace_programs",
    """SELECT stream_id, dw, CASE WHEN l2 & 65535 = 4244 THEN l1 END AS slot, ((w>>16)&16383)+1 AS n FROM (SELECT *, lag(w,1) OVER q AS l1, lag(w,2) OVER q AS l2 FROM word WINDOW q AS (PARTITION BY stream_id ORDER BY dw))
       WHERE w & 65535 = 37013 AND w>>30=0""",
    ["word"],
)
def _(spark, sf):
    return X.programs(fx.words(spark, sf))


@query(
    "trace_program_words",
    """SELECT p.stream_id, p.dw AS prog_dw, CASE WHEN l2 & 65535 = 4244 THEN l1 END AS slot, d.dw-p.dw-1 AS k, d.w FROM (SELECT *, lag(w,1) OVER q AS l1, lag(w,2) OVER q AS l2 FROM word WINDOW q AS (PARTITION BY stream_id ORDER BY dw)) p JOIN word d ON d.stream_id=p.stream_id AND d.dw>p.dw AND d.dw<=p.dw+((p.w>>16)&16383)+1 WHERE p.w & 65535 = 37013 AND p.w>>30=0""",
    ["word"],
)
def _(spark, sf):
    w = fx.words(spark, sf)
    return X.program_words(w, X.programs(w))


@query(
    "trace_disassemble",
    """WITH g AS (SELECT stream_id, dw//6 AS ins, list(w ORDER BY dw) AS i FROM word GROUP BY stream_id, dw//6 HAVING count(*)=6),
       t AS (SELECT stream_id, ins, ['ALU','OUT','FC','TEX'][(i[1]&3)+1] AS kind,
         CASE WHEN i[1]&3<2 THEN ['MAD','DP3','DP4','D2A','MIN','MAX','?','CND','CMP','FRC','SOP','MDH','MDV'][least(i[6]&15,12)+1] END AS rgb_op,
         CASE WHEN i[1]&3<2 THEN ['MAD','DP','MIN','MAX','?','CND','CMP','FRC','EX2','LN2','RCP','RSQ','SIN','COS','MDH','MDV'][(i[5]&15)+1] END AS alpha_op,
         (i[1]>>11)&7 AS wmask_rgb, (i[1]>>14)&1 AS wmask_a, (i[1]>>15)&7 AS omask_rgb, (i[1]>>18)&1 AS omask_a, (i[1]>>8)&1 AS last,
         array_to_string(list_transform(i, lambda v: printf('%08x', v)), ' ') AS words FROM g)
       SELECT *, CASE WHEN rgb_op IS NULL THEN kind ELSE kind||' rgb:'||rgb_op||' alpha:'||alpha_op||' wmask='||wmask_rgb||'/'||wmask_a||' omask='||omask_rgb||'/'||omask_a||' last='||last END AS text FROM t""",
    ["word"],
)
def _(spark, sf):
    return X.disassemble(fx.words(spark, sf), ["stream_id"], "dw")


@query(
    "trace_split_by_kind",
    "SELECT kind, line_no, conn, records, words, 'free text '||line_no AS tail FROM ses WHERE kind IN ('FLUSH','CLOSE')",
    ["ses"],
)
def _(spark, sf):
    t = parse_trace(fx.session_lines(spark, sf), ["line_no"])
    f = {"conn": "bigint", "records": "bigint", "words": "bigint"}
    one = lambda k: X.typed_kind(t, k, ["kind", "line_no"], f)
    return one("FLUSH").unionByName(one("CLOSE"))


@query(
    "trace_histogram",
    """SELECT line_no, 0::BIGINT AS op, c0 AS cnt, w0 AS words FROM trc UNION ALL SELECT line_no, 37, c25, w25 FROM trc""",
    ["trc"],
)
def _(spark, sf):
    return X.histogram(parse_trace(fx.trace_lines(spark, sf), ["line_no"]), ["line_no"])


@query(
    "trace_marker_categories",
    """SELECT CASE op WHEN 0 THEN NULL ELSE 'texture unbind, second family' END AS category, sum(cnt)::BIGINT AS cnt, sum(words)::BIGINT AS words
       FROM (SELECT 0 AS op, c0 AS cnt, w0 AS words FROM trc UNION ALL SELECT 37, c25, w25 FROM trc) GROUP BY 1""",
    ["trc"],
)
def _(spark, sf):
    h = X.histogram(parse_trace(fx.trace_lines(spark, sf), ["line_no"]), ["line_no"])
    return h.groupBy(X.marker_category(F.col("op")).alias("category")).agg(F.sum("cnt").alias("cnt"), F.sum("words").alias("words"))


@query(
    "trace_reconcile_totals",
    """SELECT conn::VARCHAR AS conn, r AS records, w AS words, hr AS hist_records, hw AS hist_words, r=hr AND w=hw AS ok FROM (
       SELECT conn, sum(records)::BIGINT AS r, sum(words)::BIGINT AS w, sum(c0+c25)::BIGINT AS hr, sum(w0+w25)::BIGINT AS hw FROM trc GROUP BY conn)""",
    ["trc"],
)
def _(spark, sf):
    return X.reconcile_totals(parse_trace(fx.trace_lines(spark, sf), ["line_no"]))


@query(
    "trace_flush_close_balance",
    """SELECT conn::VARCHAR AS conn, a AS flush_records, b AS close_records, c AS flush_words, d AS close_words, a=b AND c=d AS ok FROM (SELECT conn,
       coalesce(sum(records) FILTER (kind='FLUSH'),0)::BIGINT AS a, coalesce(sum(records) FILTER (kind='CLOSE'),0)::BIGINT AS b,
       coalesce(sum(words) FILTER (kind='FLUSH'),0)::BIGINT AS c, coalesce(sum(words) FILTER (kind='CLOSE'),0)::BIGINT AS d FROM ses WHERE kind<>'#' GROUP BY conn)""",
    ["ses"],
)
def _(spark, sf):
    return X.flush_close_balance(parse_trace(fx.session_lines(spark, sf), ["line_no"]))


@query(
    "trace_sessions",
    """SELECT conn::VARCHAR AS conn, session, min(line_no) AS first_line, max(line_no) AS last_line, count(*) FILTER (kind='FLUSH') AS flushes, bool_or(kind='CLOSE') AS closed
       FROM (SELECT *, (sum(CASE WHEN kind='OPEN' THEN 1 ELSE 0 END) OVER (PARTITION BY conn ORDER BY line_no))::BIGINT AS session FROM ses WHERE kind<>'#') WHERE session>0 GROUP BY ALL""",
    ["ses"],
)
def _(spark, sf):
    return X.sessions(parse_trace(fx.session_lines(spark, sf), ["line_no"]))


@query(
    "trace_dictionary_diff",
    """SELECT addr, a.name AS name_a, b.name AS name_b, CASE WHEN a.name IS NULL THEN 'only_b' WHEN b.name IS NULL THEN 'only_a' ELSE 'differs' END AS state FROM
       (SELECT p_partkey*4 AS addr, p_brand AS name FROM part) a FULL JOIN
       (SELECT p_partkey*4+CASE WHEN p_size>45 THEN 2 ELSE 0 END AS addr, CASE WHEN p_size%10=0 THEN p_brand||'*' ELSE p_brand END AS name FROM part) b USING (addr) WHERE a.name IS DISTINCT FROM b.name""",
)
def _(spark, sf):
    p = fx.table(spark, sf, "part")
    addr = F.col("p_partkey") * 4
    moved = addr + F.when(F.col("p_size") > 45, 2).otherwise(0)
    a = p.select(addr.alias("addr"), F.col("p_brand").alias("name"))
    b = p.select(moved.alias("addr"), F.when(F.col("p_size") % 10 == 0, F.concat("p_brand", F.lit("*"))).otherwise(F.col("p_brand")).alias("name"))
    return X.dictionary_diff(a, b)


@query(
    "trace_plausibility",
    """SELECT k, CASE WHEN base=0 OR link<base+32 OR cur<=link OR cur>=lim OR lim-base>1048576 THEN 'fields' WHEN link&3<>0 OR cur&3<>0 THEN 'alignment'
       WHEN cur-link<8 OR cur-link>1024 THEN 'body_size' WHEN header<>788529152 THEN 'header' WHEN cur+(n+16)*4>lim THEN 'room' END AS reason FROM (
       SELECT o_orderkey AS k, CASE WHEN o_orderkey%23=0 THEN 0 ELSE 65536 END AS base, 65536+o_orderkey%200+CASE WHEN o_orderkey%3=0 THEN 1 ELSE 0 END*2 AS link,
         65536+(o_orderkey*4)%2000 AS cur, 65536+2000 AS lim, CASE WHEN o_orderkey%5=0 THEN 1 ELSE 788529152 END AS header, o_orderkey%100 AS n FROM orders)""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    o = fx.table(spark, sf, "orders").select(
        k.alias("k"), F.when(k % 23 == 0, 0).otherwise(65536).cast("bigint").alias("base"),
        (65536 + k % 200 + F.when(k % 3 == 0, 2).otherwise(0)).alias("link"), (65536 + (k * 4) % 2000).alias("cur"), F.lit(67536).cast("bigint").alias("lim"),
        F.when(k % 5 == 0, 1).otherwise(788529152).cast("bigint").alias("header"), (k % 100).alias("n"),
    )
    c = F.col
    return o.select("k", X.plausibility(c("link"), c("cur"), c("lim"), c("base"), c("header"), c("n")).alias("reason"))


SNAPS = "(SELECT run AS off, f AS snap, CASE WHEN run%3=0 THEN f*4 WHEN run%3=1 THEN f//3 ELSE floor(live_ms)::BIGINT%5 END AS v FROM tim)"


def _snaps(spark, sf):
    r, f = F.col("run"), F.col("f")
    v = F.when(r % 3 == 0, f * 4).when(r % 3 == 1, int_div(f, 3)).otherwise(F.floor("live_ms") % 5)
    return fx.timings(spark, sf).select(r.alias("off"), f.alias("snap"), v.cast("bigint").alias("v"))


CHANGES = f"(SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY off ORDER BY snap) AS prev FROM {SNAPS}) WHERE v<>prev)"


@query("trace_snapshot_changes", f"SELECT off, snap, v, prev, r-1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY snap ORDER BY off) AS r FROM {CHANGES}) WHERE r<=24", ["tim"])
def _(spark, sf):
    return X.first_changes(X.snapshot_changes(_snaps(spark, sf)))


@query("trace_snapshot_all_changes", f"SELECT off, snap, v, prev FROM {CHANGES}", ["tim"])
def _(spark, sf):
    return X.snapshot_changes(_snaps(spark, sf))


@query(
    "trace_steady_counters",
    f"SELECT off, count(*) AS changes, min(v-prev) AS step FROM {CHANGES} GROUP BY off HAVING min(v-prev)=max(v-prev) AND count(*)=(SELECT count(*) FROM tim WHERE tim.run=off)-1",
    ["tim"],
)
def _(spark, sf):
    s = _snaps(spark, sf)
    return X.steady_counters(X.snapshot_changes(s), s.groupBy("off").agg(F.count("*").alias("n")))


@query(
    "trace_change_points",
    """SELECT run, f, v, prev, r-1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY f) AS r FROM (SELECT *, lag(v) OVER (PARTITION BY run ORDER BY f) AS prev FROM ctr) WHERE v<>prev) WHERE r<=16""",
    ["ctr"],
)
def _(spark, sf):
    c = fx.counters(spark, sf)
    points = X.change_points(c, ["run"], ["ts", "f"], by_span("ts"), "v").drop("ts")
    return first_k(points, ["run"], ["f"], 16)


@query("trace_all_change_points", "SELECT run, f, v, prev FROM (SELECT *, lag(v) OVER (PARTITION BY run ORDER BY f) AS prev FROM ctr) WHERE v<>prev", ["ctr"])
def _(spark, sf):
    return X.change_points(fx.counters(spark, sf), ["run"], ["f"], by_width("f"), "v").drop("ts")


@query("trace_nonzero_words", "SELECT stream_id, dw, w FROM word WHERE w<>0", ["word"])
def _(spark, sf):
    return X.nonzero(fx.words(spark, sf))


@query(
    "trace_ordering_hazards",
    HEADS + """, ev AS (SELECT stream_id, dw, ord, addr FROM wr UNION ALL SELECT stream_id, dw, -1, NULL FROM h WHERE kind=3 AND op=16),
       c AS (SELECT *, (sum(CASE WHEN addr IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY dw, ord))::BIGINT AS n FROM ev)
       SELECT stream_id, dw, ord, addr, d-n AS writes_before_draw FROM (SELECT *, min(CASE WHEN addr IS NULL THEN n END) OVER (PARTITION BY stream_id ORDER BY dw, ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS d FROM c)
       WHERE d-n<3 AND addr=16980""",
    ["word"],
)
def _(spark, sf):
    w, h = _heads(spark, sf)
    return X.ordering_hazards(X.register_writes(w, h), h, risky=(0x4254,), draws=(0x10,), need=3)


@query(
    "trace_wrap_diff",
    """SELECT o_orderkey AS k, CASE WHEN d>=2147483648 THEN d-4294967296 ELSE d END AS diff, CASE WHEN d>=2147483648 THEN d-4294967296 ELSE d END>=2 AS reached FROM (
       SELECT o_orderkey, ((o_orderkey*2654435761)%4294967296-(o_orderkey*40503)%4294967296+4294967296)%4294967296 AS d FROM orders)""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    two32 = lit_long(4294967296)
    a, b = F.pmod(k * lit_long(2654435761), two32), F.pmod(k * 40503, two32)
    d = wrap_diff32(a, b)
    return fx.table(spark, sf, "orders").select(k.alias("k"), d.alias("diff"), (d >= 2).alias("reached"))




@query(
    "trace_span_join",
    """WITH v AS (SELECT *, w&32767 AS addr FROM word),
      sp AS (SELECT p_partkey*37%32768 AS low, p_partkey*37%32768+CASE p_partkey%4 WHEN 0 THEN p_size*p_size ELSE p_size%5-1 END AS high, p_partkey%97 AS rank, p_brand AS name FROM part),
      b AS (SELECT addr, min({'r': rank, 'l': low, 'h': high, 'n': name}).n AS name FROM (SELECT DISTINCT addr FROM v) JOIN sp ON addr BETWEEN low AND high GROUP BY addr)
      SELECT stream_id, dw, addr, name FROM v LEFT JOIN b USING (addr)""",
    ["word"],
)
def _(spark, sf):
    """Register fields looked up in spans made from the parts: overlaps, gaps, single registers and empty spans."""
    k, n = F.col("p_partkey"), F.col("p_size")
    low = k * 37 % 32768
    spans = fx.table(spark, sf, "part").select(low.alias("low"), (low + F.when(k % 4 == 0, n * n).otherwise(n % 5 - 1)).alias("high"), (k % 97).alias("rank"), F.col("p_brand").alias("name"))
    rows = fx.words(spark, sf).select("stream_id", "dw", F.col("w").bitwiseAND(F.lit(32767).cast("bigint")).alias("addr"))
    return span_join(rows, spans, "addr", "dw")
