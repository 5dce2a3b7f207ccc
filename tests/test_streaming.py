"""Streams over several micro-batches written one after the other."""

import random

from pyspark.sql import functions as F

from mediaframe.functions.lineage import work_dir
from mediaframe.streaming import run as R
from mediaframe.streaming import stateful as S
from tests.test_walks import simulate


def staged(spark, frames):
    path = work_dir(spark, "src")
    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{path}/part{i}")
    return R.file_stream(spark, path + "/*", frames[0].schema, "*.parquet", files_per_batch=1)


def test_reorder_across_batches(spark):
    rows = [(s, 0, d, (d // 3) * 6 + (0, 4, 2)[d % 3], d == 29) for s in (1, 2) for d in range(30)]
    cols = "stream bigint, epoch bigint, decode_no bigint, poc bigint, last boolean"
    parts = [spark.createDataFrame([r for r in rows if r[2] % 30 in span], cols) for span in (range(0, 11), range(11, 20), range(20, 30))]
    out = R.drain(S.reorder(staged(spark, parts), depth=2)).collect()
    for s in (1, 2):
        got = sorted((r.display_no, r.poc) for r in out if r.stream == s)
        assert got == list(enumerate(sorted(r[3] for r in rows if r[0] == s)))


def test_flush_batches_across_batches(spark):
    rnd = random.Random(5)
    pic = [(s, s % 10, s // 10, rnd.random() < 0.1, rnd.random() < 0.7) for s in range(80)]
    want = simulate(pic, 6, (9, 7))
    rows = [(1, 2, *p, p[1:3] == (9, 7), p[0] == 79) for p in pic]
    cols = "file_id bigint, frame bigint, seq bigint, mb_x int, mb_y int, intra boolean, taken boolean, last boolean, end boolean"
    parts = [spark.createDataFrame(rows[a:b], cols) for a, b in ((0, 33), (33, 34), (34, 80))]
    got = R.drain(S.flush_batches(staged(spark, parts), queue_max=6)).collect()
    assert {r.seq: r.batch_id for r in got} == want


def test_counter_changes_across_batches(spark):
    vals = [0, 0, 1, 1, 1, 2, 5, 5, 5, 5, 5, 6]
    rows = [(r, f, v + r) for r in (0, 1) for f, v in enumerate(vals)]
    parts = [spark.createDataFrame([x for x in rows if x[1] in span], "run bigint, f bigint, v bigint") for span in (range(0, 3), range(3, 7), range(7, 12))]
    want = {(r, f, vals[f] + r, vals[f - 1] + r) for r in (0, 1) for f in range(1, 12) if vals[f] != vals[f - 1]}
    assert {tuple(x) for x in R.counter_changes(staged(spark, parts)).select("run", "f", "v", "prev").collect()} == want
    seen = R.counter_watch(staged(spark, parts), max_polls=4).collect()
    assert {(x.run, x.f, x.v, x.prev) for x in seen if x.kind == "change"} == want
    assert {(x.run, x.f) for x in seen if x.kind == "timeout"} == {(0, 10), (1, 10)}


def test_late_rows_are_dropped_by_the_watermark(spark):
    mk = lambda rows: spark.createDataFrame(rows, "t string, run bigint, live_ms double").select(F.to_timestamp("t").alias("ts"), "run", "live_ms")
    parts = [
        mk([("2024-01-01 00:10:00", 1, 10.0), ("2024-01-01 00:20:00", 1, 50.0)]),
        mk([("2024-01-01 03:00:00", 1, 10.0)]),
        mk([("2024-01-01 03:30:00", 1, 90.0)]),  # rows are judged late by the watermark one micro-batch back
        mk([("2024-01-01 00:30:00", 1, 10.0)]),  # two hours late
        mk([("2024-01-01 06:00:00", 1, 10.0)]),
    ]
    out = R.drain(S.budget_monitor(staged(spark, parts))).orderBy("hour").collect()
    assert [(r.hour.hour, r.n, r.met) for r in out] == [(0, 2, 1), (3, 2, 1)]


def test_first_matches_stop(spark):
    parts = [spark.range(i * 10, i * 10 + 10).select(F.col("id")) for i in range(5)]
    out = R.first_matches(staged(spark, parts), 13, ["id"])
    assert sorted(r.id for r in out.collect()) == list(range(13))
