"""Timers and state expiry over several micro-batches, restarts included."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mediaframe.functions.lineage import work_dir
from mediaframe.streaming import run as R
from mediaframe.streaming import timers as Z

START = dt.datetime(2024, 1, 1)
POLLS = "run bigint, ts timestamp, f bigint, v bigint"
FRAMES = "stream bigint, epoch bigint, decode_no bigint, poc bigint, last boolean, ts timestamp"


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def source(spark, parts, schema):
    """One file, and one micro-batch, for each part."""
    path = work_dir(spark, "src")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part{i}")
    return R.file_stream(spark, path + "/*", spark.createDataFrame([], schema).schema, "*.parquet", files_per_batch=1)


def waits(rows, bound):
    """Step by step: (run, ms, v, prev, kind) of polls (run, ms, f, v); the watermark ends at the last poll of all."""
    out, end = [], max(r[1] for r in rows)
    for run in {r[0] for r in rows}:
        polls = sorted((ms, f, v) for r, ms, f, v in rows if r == run)
        since, value = polls[0][0], polls[0][2]
        for ms, _, v in [*polls[1:], (None, None, None)]:
            if ms is None or v != value:
                if since + bound < (end + 1 if ms is None else ms):
                    out.append((run, since + bound, value, None, "timeout"))
                if ms is not None:
                    out.append((run, ms, v, value, "change"))
                    since, value = ms, v
    return sorted(out, key=str)


def seen(df):
    zero = int(START.timestamp() * 1000)
    return sorted(((r.run, r.ms - zero, r.v, r.prev, r.kind) for r in df.collect()), key=str)


def batches(rows, cuts):
    return [[(r, at(ms), f, v) for r, ms, f, v in rows if a <= ms < b] for a, b in zip([0, *cuts], [*cuts, 1 << 60], strict=True)]


@pytest.fixture
def utc(spark):
    import os
    import time

    before = os.environ.get("TZ")
    os.environ["TZ"] = "UTC"
    time.tzset()
    yield
    os.environ.pop("TZ") if before is None else os.environ.update(TZ=before)
    time.tzset()


def test_a_silent_counter_times_out(spark, utc):
    """Run 1 is polled but stands still, run 2 falls silent, run 3 changes at the very bound."""
    rows = [(1, ms, ms, 7) for ms in range(0, 3000, 100)] + [(2, 0, 0, 5), (2, 50, 1, 6)] + [(3, 0, 0, 1), (3, 1000, 1, 2), (3, 2500, 2, 3)] + [(4, 2900, 0, 1)]
    got = seen(R.drain(Z.bounded_wait(source(spark, batches(rows, [60, 900, 2600]), POLLS), 1000, "0 seconds")))
    assert got == waits(rows, 1000)
    assert [x for x in got if x[0] == 2] == [(2, 1050, 6, None, "timeout"), (2, 50, 6, 5, "change")]
    assert [x[1] for x in got if x[0] == 3 and x[4] == "timeout"] == [2000]


@pytest.mark.parametrize("seed", [1, 2])
def test_waits_equal_the_simulation(spark, utc, seed):
    rng = random.Random(seed)
    rows = [(run, ms, f, rng.randrange(3)) for run in range(5) for f, ms in enumerate(sorted(rng.sample(range(10_000), 30)))]
    cuts = sorted(rng.sample(range(10_000), 3))
    assert seen(R.drain(Z.bounded_wait(source(spark, batches(rows, cuts), POLLS), 700, "0 seconds"))) == waits(rows, 700)


def test_polls_out_of_order_within_the_delay(spark, utc):
    rows = [(1, 0, 0, 1), (1, 2000, 2, 3), (1, 1000, 1, 2), (1, 9000, 3, 3), (2, 60_000, 0, 0)]
    parts = [[(r, at(ms), f, v) for r, ms, f, v in rows[i : i + 1]] for i in range(len(rows))]
    got = seen(R.drain(Z.bounded_wait(source(spark, parts, POLLS), 5000, "5 seconds")))
    assert got == [(1, 1000, 2, 1, "change"), (1, 2000, 3, 2, "change"), (1, 7000, 3, None, "timeout")]


def test_waits_survive_a_restart(spark, utc):
    rows = [(1, ms, ms, ms // 1500) for ms in range(0, 6000, 250)] + [(2, 100, 0, 4)]
    path, base = work_dir(spark, "src"), work_dir(spark, "out")
    schema = spark.createDataFrame([], POLLS).schema
    for i, part in enumerate(batches(rows, [1000, 3000])):
        spark.createDataFrame(part, POLLS).coalesce(1).write.parquet(f"{path}/part{i}")
        stream = Z.bounded_wait(R.file_stream(spark, path + "/*", schema, "*.parquet", files_per_batch=1), 800, "0 seconds")
        R.append_log(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()  # a query of its own each time
    assert seen(spark.read.parquet(f"{base}/out")) == waits(rows, 800)


def test_lost_last_rows_are_shown_and_state_ends_empty(spark, utc):
    rows = [(s, e, 12 * e + d, 6 * (d // 3) + (0, 4, 2)[d % 3], d == 11, at(60_000 * e + 1000 * d)) for s in (1, 2) for e in range(4) for d in range(12)]
    lost = [r for r in rows if not (r[4] and (r[0] + r[1]) % 2) and not (r[0] == 2 and r[1] == 3 and r[2] % 12 > 2)]
    end = [(-1, 0, 0, 0, True, at(3_600_000))]
    parts = [[r for r in lost if r[1] < 2], [r for r in lost if r[1] >= 2], end]
    base = work_dir(spark, "out")
    stream = Z.expiring_reorder(source(spark, parts, FRAMES), depth=3, wait_ms=30_000, delay="10 seconds")
    q = R.append_log(stream, f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    got = spark.read.parquet(f"{base}/out").where(F.col("stream") > 0).collect()
    assert len(got) == len(lost)
    for s in (1, 2):
        for e in range(4):
            mine = sorted((r.display_no, r.poc, r.decode_no) for r in got if (r.stream, r.epoch) == (s, e))
            want = sorted((r[3], r[2]) for r in lost if r[:2] == (s, e))
            assert mine == [(i, *w) for i, w in enumerate(want)]
    assert q.lastProgress.stateOperators[0].numRowsTotal == 0


def test_a_key_that_ends_in_its_first_batch_makes_one_state_call():
    import pandas as pd

    from mediaframe.streaming.stateful import FlushBatches
    from mediaframe.streaming.timers import ExpiringReorder

    calls = []

    class State:
        def exists(self):
            calls.append("exists")
            return False

        def __getattr__(self, name):
            raise AssertionError(f"{name} of a state that does not exist")

    p = ExpiringReorder(3, 1000)
    p.pending = p.shown = p.latest = p.handle = State()
    rows = pd.DataFrame({"decode_no": [2, 0, 1], "poc": [4, 0, 2], "last": [True, False, False], "ms": [5, 3, 4]})
    out = pd.concat(p.handleInputRows((7, 0), iter([rows]), None))
    assert out[["display_no", "poc", "decode_no"]].to_numpy().tolist() == [[0, 0, 0], [1, 2, 1], [2, 4, 2]] and calls == ["exists"]
    q = FlushBatches(2)
    q.queue = State()
    mb = pd.DataFrame({"seq": [1, 0], "mb_x": [1, 0], "mb_y": [0, 0], "intra": [True, False], "taken": [True, True], "last": [False, False], "end": [True, False]})
    out = pd.concat(q.handleInputRows((1, 0), iter([mb]), None))
    assert out[["seq", "batch_id"]].to_numpy().tolist() == [[0, 0], [1, 1]] and calls == ["exists", "exists"]
