"""Streaming queries and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe import schemas
from mediaframe.functions.bits import has_bit, int_div
from mediaframe.functions.lineage import cut_lineage, work_dir
from mediaframe.operators import batching as Q
from mediaframe.operators import motion as M
from mediaframe.operators.blocks import luma_dc
from mediaframe.plans import fixtures as fx
from mediaframe.plans.registry import query
from mediaframe.sources.files import opened
from mediaframe.sources.logs import growing_log, read_epochs, write_epochs
from mediaframe.streaming import run as R
from mediaframe.streaming import stateful as S
from mediaframe.streaming import timers as Z

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
PICTURE = ["file_id", "frame"]

# the flush marks of every block, then the walk over batch starts
MARKS = """WITH RECURSIVE q0 AS (SELECT file_id, {frame} AS frame, seq, mb_x, {row} AS mb_y, mb_type&7<>0 AS intra, reason IS NULL AS taken, mb_x=15 AND {row}=11 AS last FROM outc),
  q1 AS (SELECT *, (sum(CASE WHEN taken THEN 1 ELSE 0 END) OVER w)::BIGINT-CASE WHEN taken THEN 1 ELSE 0 END AS t, lag(taken) OVER w AS pt, lag(mb_x) OVER w AS px, lag(mb_y) OVER w AS py FROM q0
    WINDOW w AS (PARTITION BY file_id, frame ORDER BY seq)),
  q2 AS (SELECT *, CASE WHEN intra AND pt AND px=mb_x-1 AND py=mb_y THEN t END AS cl, CASE WHEN last THEN t+CASE WHEN taken THEN 1 ELSE 0 END END AS ce FROM q1),
  q3 AS MATERIALIZED (SELECT *, least(t+64, coalesce(min(cl) OVER nx, 1000000000), coalesce(ce, min(ce) OVER nx, 1000000000), coalesce((SELECT min(i.t) FROM q1 i WHERE i.file_id=q2.file_id AND i.frame=q2.frame AND i.intra AND i.mb_y>q2.mb_y), 1000000000)) AS nxt
    FROM q2 WINDOW nx AS (PARTITION BY file_id, frame ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  q4 AS MATERIALIZED (SELECT * FROM q3 WHERE taken),
  st AS (SELECT file_id, frame, t, nxt, 0::BIGINT AS batch_id FROM q4 WHERE t=0 UNION ALL SELECT q4.file_id, q4.frame, q4.t, q4.nxt, st.batch_id+1 FROM st JOIN q4 ON q4.file_id=st.file_id AND q4.frame=st.frame AND q4.t=st.nxt),
  fb AS (SELECT q4.file_id, q4.frame, seq, batch_id FROM q4 ASOF JOIN st ON q4.file_id=st.file_id AND q4.frame=st.frame AND q4.t>=st.t)"""
BATCHES = MARKS.format(frame="frame", row="mb_y")
# the same blocks cut into whole pictures of 12 rows, which bounds the streaming state
PICTURES = MARKS.format(frame="frame+30*(seq//192)", row="mb_y%12")


def _blocks(spark, sf):
    # only the parts of cut blocks that nothing else declines are judged by the cell arrays: the others need none built
    cut = has_bit(F.col("mb_type"), schemas.T16X8 | schemas.T8X16 | schemas.T8X8)
    out = M.outcomes(fx.macroblock_info(spark, sf, cut & (F.col("slice") != schemas.SLICE_B) & (F.col("ref") < 3)))
    return out.select(*PICTURE, "seq", "mb_x", "mb_y", M.is_intra(F.col("mb_type")).alias("intra"), "taken")


def _is_last():
    return (F.col("mb_x") == fx.MB_WIDTH - 1) & (F.col("mb_y") == fx.MB_HEIGHT - 1)


@query("batch_flush_batches", BATCHES + " SELECT file_id, frame, seq, batch_id FROM fb", ["outc"])
def _(spark, sf):
    return Q.flush_batches(_blocks(spark, sf), PICTURE, _is_last(), queue_max=64).drop("mb_x", "mb_y")


@query(
    "batch_flush_stats",
    BATCHES + " SELECT file_id, frame, count(*) AS flushes, sum(n)::BIGINT AS blocks, round(avg(n),6) AS mean_size, max(n) AS max_size FROM (SELECT file_id, frame, batch_id, count(*) AS n FROM fb GROUP BY ALL) GROUP BY ALL",
    ["outc"],
)
def _(spark, sf):
    b = Q.flush_batches(_blocks(spark, sf), PICTURE, _is_last(), queue_max=64)
    return Q.batch_stats(b, PICTURE).withColumn("mean_size", F.round("mean_size", 6))


@query(
    "batch_patch_late",
    """SELECT file_id, frame, seq, CASE WHEN mb_type&2<>0 THEN (c[1]+c[2]+c[3]+c[4]+c[5]+c[6]+c[7]+c[8]+c[9]+c[10]+c[11]+c[12]+c[13]+c[14]+c[15]+c[16])*(100+cbp)+128>>8 ELSE 0 END AS dc FROM mb""",
    ["mb"],
)
def _(spark, sf):
    mb = fx.macroblocks(spark, sf)
    key = [*PICTURE, "seq"]
    rows = mb.select(*key, F.lit(0).cast("bigint").alias("dc"))
    late = luma_dc(mb.where(F.col("mb_type").bitwiseAND(F.lit(2)) != 0).select(*key, "c", "cbp"), "c", 100 + F.col("cbp"))
    return Q.patch_late(rows, late.select(*key, F.get("dc_out", F.lit(0)).alias("dc")), key, "dc")


@query(
    "batch_complete_items",
    "SELECT file_id, frame, seq, n, w, h FROM part SEMI JOIN (SELECT file_id, frame, seq FROM part GROUP BY ALL HAVING bool_and(luma_ok AND chroma_ok AND part_ref=ref)) k USING (file_id, frame, seq)",
    ["part"],
)
def _(spark, sf):
    parts = M.partitions(F.col("mb_type"), F.col("sub"))
    whole = Q.complete_items(fx.macroblock_info(spark, sf), [*PICTURE, "seq"], parts, M.first_part_reason())
    return whole.select(*PICTURE, "seq", "n", "w", "h")


@query(
    "batch_budget_by_hour",
    "SELECT date_trunc('hour', ts) AS hour, user_id%10 AS run, count(*) AS n, count(*) FILTER (value<=33.333) AS met FROM events GROUP BY ALL",
)
def _(spark, sf):
    e = fx.table(spark, sf, "events")
    g = e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), (F.col("user_id") % 10).alias("run"))
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("value") <= 33.333).alias("met"))


# ------------------------------------------------------------- streams


def _events(spark, sf):
    return R.file_stream(spark, sf, EVENTS, "events.parquet")


def _staged(spark, df):
    """Derived rows as a file stream; one micro-batch, so arrival order is the order inside it."""
    path = work_dir(spark, "staged")
    df.write.parquet(path)
    return R.file_stream(spark, path, df.schema)


@query("stream_drain", "SELECT event_id, user_id, value*2 AS twice FROM events WHERE event_type<>'error'")
def _(spark, sf):
    return R.drain(_events(spark, sf).where("event_type <> 'error'").select("event_id", "user_id", (F.col("value") * 2).alias("twice")))


@query(
    "stream_reorder",
    """SELECT run AS stream, f//12 AS epoch, row_number() OVER (PARTITION BY run, f//12 ORDER BY poc)-1 AS display_no, poc, f AS decode_no FROM (SELECT run, f, ((f%12)//3)*6+[0,4,2][f%3+1] AS poc FROM tim)""",
    ["tim"],
)
def _(spark, sf):
    t = fx.timings(spark, sf).select("run", "f")
    n = t.groupBy("run").agg(F.max("f").alias("f")).withColumn("run_end", F.lit(True))
    f = F.col("f")
    poc = int_div(f % 12, 3) * 6 + F.get(F.array(F.lit(0), F.lit(4), F.lit(2)), (f % 3).cast("int"))
    frames = t.join(n, ["run", "f"], "left").select(
        F.col("run").alias("stream"), int_div(f, 12).alias("epoch"), f.alias("decode_no"), poc.cast("bigint").alias("poc"),
        ((f % 12 == 11) | F.coalesce("run_end", F.lit(False))).alias("last"),
    )
    return R.drain(S.reorder(_staged(spark, frames), depth=3))


@query("stream_flush_batches", PICTURES + " SELECT file_id, frame, seq, batch_id FROM fb", ["outc"])
def _(spark, sf):
    mb = _blocks(spark, sf).withColumn("frame", F.col("frame") + 30 * int_div(F.col("seq"), fx.MB_WIDTH * fx.MB_HEIGHT))
    mb = mb.withColumn("mb_y", F.col("mb_y") % fx.MB_HEIGHT).withColumn("last", _is_last())
    tail = mb.groupBy(*PICTURE).agg(F.max("seq").alias("seq")).withColumn("end", F.lit(True))
    rows = mb.join(tail, [*PICTURE, "seq"], "left").withColumn("end", F.coalesce("end", F.lit(False)))
    return R.drain(S.flush_batches(_staged(spark, rows), queue_max=64))


@query("stream_counter_changes", "SELECT run, f, v, prev FROM (SELECT *, lag(v) OVER (PARTITION BY run ORDER BY f) AS prev FROM ctr) WHERE v<>prev", ["ctr"])
def _(spark, sf):
    return R.counter_changes(_staged(spark, fx.counters(spark, sf).drop("ts")))


@query("stream_counter_steps", "SELECT run, f, v, prev FROM (SELECT *, lag(v) OVER (PARTITION BY run ORDER BY f) AS prev FROM ctr) WHERE v<>prev", ["ctr"])
def _(spark, sf):
    """The change points again, three micro-batches of four files each."""
    polls = cut_lineage(fx.counters(spark, sf).drop("ts"))
    path, third = work_dir(spark, "staged"), polls.groupBy("run").agg((F.max("f") / 3 + 1).cast("bigint").alias("third"))
    parts = polls.join(third, "run").withColumn("part", F.least(F.lit(2), F.floor(F.col("f") / F.col("third")))).drop("third")
    for k in range(3):
        parts.where(F.col("part") == k).drop("part").repartition(4).write.mode("append").parquet(path)
    return R.counter_changes(R.file_stream(spark, path, polls.schema, files_per_batch=4))


@query(
    "stream_counter_watch",
    """SELECT run, f, v, prev, 'change' AS kind FROM (SELECT *, lag(v) OVER (PARTITION BY run ORDER BY f) AS prev FROM ctr) WHERE v<>prev
       UNION ALL SELECT run, f, v, CASE WHEN f=0 THEN NULL ELSE v END, 'timeout' FROM (SELECT *, f-max(CASE WHEN v<>p THEN f END) OVER (PARTITION BY run ORDER BY f) AS since FROM (SELECT *, lag(v) OVER (PARTITION BY run ORDER BY f) AS p FROM ctr)) WHERE coalesce(since, f+1)=8""",
    ["ctr"],
)
def _(spark, sf):
    return R.counter_watch(_staged(spark, fx.counters(spark, sf).drop("ts")), max_polls=8)


@query(
    "stream_late_patch",
    "SELECT event_id, user_id, CASE WHEN event_id%2=0 THEN value*3 END AS late_value FROM events",
)
def _(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    late = e.where("event_id % 2 = 0").select("event_id", (F.col("ts") + F.expr("INTERVAL 5 minutes")).alias("ts"), (F.col("value") * 3).alias("value"))
    out = S.late_patch(e.select("event_id", "user_id", "ts"), late, ["event_id"])
    done = R.drain(out.select("event_id", "user_id", "late_value"))
    waiting = fx.table(spark, sf, "events").select("event_id", "user_id", F.lit(None).cast("double").alias("late_value"))
    return R.complete(done, waiting, ["event_id"])


@query("stream_first_matches", "SELECT event_id, user_id, value FROM events WHERE value>100 ORDER BY event_id LIMIT 40")
def _(spark, sf):
    return R.first_matches(_events(spark, sf).where("value > 100").select("event_id", "user_id", "value"), 40, ["event_id"])


@query(
    "stream_budget_monitor",
    """SELECT date_trunc('hour', ts) AS hour, user_id%10 AS run, count(*) AS n, count(*) FILTER (value<=33.333) AS met FROM events GROUP BY ALL""",
)
def _(spark, sf):
    cols = [F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("run"), F.col("value").alias("live_ms")]
    closed = R.drain(S.budget_monitor(_events(spark, sf).select(*cols)))
    # windows the watermark has not passed when the stream ends: only rows of its last stretch are read again
    e = fx.table(spark, sf, "events").select(*cols)
    last = e.agg(F.max("ts").alias("last")).select((F.col("last") - F.expr("INTERVAL 70 minutes")).alias("since"))
    recent = e.join(F.broadcast(last), F.col("ts") >= F.date_trunc("hour", F.col("since"))).drop("since")
    return R.complete(closed, S.budget_monitor(recent, delay=None), ["hour", "run"]).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


BOUND_MS = 20 * 60_000


def _by_time(spark, df, parts=3, files=4):
    """Rows with ts as a stream of ``parts`` micro-batches, one stretch of time each, of ``files`` files."""
    kept = cut_lineage(df)
    ends = kept.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    path, step = work_dir(spark, "staged"), (ends["b"] - ends["a"]) / parts
    cuts = [None, *(ends["a"] + step * k for k in range(1, parts)), None]
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = kept.where(F.lit(True) if a is None else F.col("ts") >= F.lit(a)).where(F.lit(True) if b is None else F.col("ts") < F.lit(b))
        part.repartition(files).write.mode("append").parquet(path)
    return R.file_stream(spark, path, kept.schema, files_per_batch=files)


@query(
    "stream_timeout",
    f"""WITH p AS (SELECT run, epoch_us(ts)//1000 AS ms, f, v, lag(v) OVER w AS prev FROM ctr WINDOW w AS (PARTITION BY run ORDER BY epoch_us(ts)//1000, f)),
      c AS (SELECT *, lead(ms) OVER (PARTITION BY run ORDER BY ms, f) AS next FROM p WHERE prev IS NULL OR v<>prev)
      SELECT run, ms, v, prev, 'change' AS kind FROM c WHERE prev IS NOT NULL
      UNION ALL SELECT run, ms+{BOUND_MS}, v, NULL, 'timeout' FROM c WHERE ms+{BOUND_MS}<coalesce(next, (SELECT max(ms)+1 FROM p))""",
    ["ctr"],
)
def _(spark, sf):
    polls = fx.counters(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return R.drain(Z.bounded_wait(_by_time(spark, polls), BOUND_MS, "0 seconds"))


@query(
    "stream_expiring_reorder",
    """SELECT run AS stream, f//12 AS epoch, row_number() OVER (PARTITION BY run, f//12 ORDER BY poc)-1 AS display_no, poc, f AS decode_no
       FROM (SELECT run, f, ((f%12)//3)*6+[0,4,2][f%3+1] AS poc FROM tim WHERE NOT (f%12=11 AND (f//12)%3=0))""",
    ["tim"],
)
def _(spark, sf):
    """A third of the epochs lose their last row; a row of another stream, far behind the others, lets the watermark pass them all."""
    f = F.col("f")
    poc = int_div(f % 12, 3) * 6 + F.get(F.array(F.lit(0), F.lit(4), F.lit(2)), (f % 3).cast("int"))
    frames = fx.timings(spark, sf).select(
        F.col("run").alias("stream"), int_div(f, 12).alias("epoch"), f.alias("decode_no"), poc.cast("bigint").alias("poc"), (f % 12 == 11).alias("last"), F.col("ts").cast("timestamp").alias("ts")
    ).where("not (last and epoch % 3 = 0)")
    end = frames.agg((F.max("ts") + F.expr("INTERVAL 400 days")).alias("ts")).select(
        *[F.lit(-1).cast("bigint").alias(c) for c in ("stream", "epoch", "decode_no", "poc")], F.lit(True).alias("last"), "ts"
    ).where("ts is not null")
    # an epoch's rows may lie days apart in the events
    shown = R.drain(Z.expiring_reorder(_by_time(spark, frames.unionByName(end), parts=1), depth=3, wait_ms=300 * 86_400_000, delay="1 day"))
    return shown.where("stream >= 0")


LOG_ROWS = 5000


def _grow(spark, rows, root, stage):
    """Log files of the rows up to a stage: each is written anew, longer, with the same beginning."""

    def write(pdf):
        system, base = opened(root)
        name = f"{base}/log{pdf['file'].iloc[0]}.txt"
        with system.open_output_stream(f"{base}/_{pdf['file'].iloc[0]}.part") as f:
            f.write("".join(line + "\n" for line in pdf.sort_values(["stage", "event_id"])["line"]).encode())
        system.move(f"{base}/_{pdf['file'].iloc[0]}.part", name)
        return pdf[["file"]].head(1)

    opened(root)[0].create_dir(opened(root)[1], recursive=True)
    # a file holds at most LOG_ROWS events
    rows.where(F.col("stage") <= stage).groupBy("file").applyInPandas(write, "file long").count()


@query("stream_growing_log", "SELECT event_id, user_id, event_type FROM events")
def _(spark, sf):
    """Lines of log files that grow three times; a query of its own follows each growth."""
    e = fx.table(spark, sf, "events").select("event_id", int_div(F.col("event_id"), LOG_ROWS).alias("file"), (F.col("event_id") % 3).alias("stage"), F.concat_ws(" ", "event_id", "user_id", "event_type").alias("line"))
    rows, root, base = cut_lineage(e), work_dir(spark, "logs"), work_dir(spark, "follow")
    for stage in range(3):
        _grow(spark, rows, root, stage)
        stream = growing_log(spark, root, 16 << 10)
        R.append_log(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    word = F.split("line", " ")
    got = spark.read.schema(stream.schema).parquet(f"{base}/out")
    return got.select(word[0].cast("bigint").alias("event_id"), word[1].cast("bigint").alias("user_id"), word[2].alias("event_type"))


@query("sink_epoch_log", "SELECT event_id, user_id, event_type FROM events")
def _(spark, sf):
    root, word = work_dir(spark, "log"), F.split("line", " ")
    e = fx.table(spark, sf, "events").select(F.concat_ws(" ", "event_id", "user_id", "event_type").alias("line"))
    path = work_dir(spark, "staged")
    e.repartition(6).write.parquet(path)
    write_epochs(R.file_stream(spark, path, e.schema, files_per_batch=2), root, work_dir(spark, "checkpoint")).awaitTermination()
    return read_epochs(spark, root).select(word[0].cast("bigint").alias("event_id"), word[1].cast("bigint").alias("user_id"), word[2].alias("event_type"))
