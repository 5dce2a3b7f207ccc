"""Forward walks, capacity packing and flush batches against step-by-step simulation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaframe.functions.ordered import by_width, next_after
from mediaframe.functions.reach import _exits, reachable
from mediaframe.operators.batching import batch_stats, complete_items, flush_batches
from mediaframe.operators.motion import capacity_chunks, chroma_inside, luma_inside, outcomes
from mediaframe.plans import fixtures, streaming_q


def walk(nxt):
    at, out = 0, []
    while at in nxt:
        out.append(at)
        at = nxt[at]
    return out


@pytest.mark.parametrize("block", [2, 8, 1 << 16])
@pytest.mark.parametrize("longest", [3, 700])
def test_reachable(spark, block, longest):
    rnd = random.Random(block + longest)
    edges = {g: {p: p + rnd.randint(1, longest) for p in range(n) if rnd.random() < 0.95 or p == 0} for g, n in (("hot", 900), ("x", 5), ("y", 77))}
    rows = [(g, p, n) for g, e in edges.items() for p, n in e.items()]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, pos bigint, nxt bigint").repartition(4)
    got = {}
    for r in reachable(df, ["g"], block).collect():
        got.setdefault(r.g, []).append(r.pos)
    assert {g: sorted(v) for g, v in got.items()} == {g: walk(e) for g, e in edges.items()}


def next_fit(widths, cap):
    chunk, used, out = 0, 0, []
    for i, w in enumerate(widths):
        if i and used + w > cap:
            chunk, used = chunk + 1, 0
        out.append((chunk, used))
        used += w
    return out


def test_capacity_chunks(spark):
    rnd = random.Random(3)
    data = {g: [rnd.choice([4, 8, 16, 16, 70]) for _ in range(n)] for g, n in (("hot", 400), ("b", 30), ("c", 1))}
    data["exact"] = [16] * 12  # fills chunks to the last column
    rows = [(g, i, w) for g, ws in data.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "g string, ord bigint, w int").repartition(4)
    got = {(r.g, r.ord): (r.chunk_no, r.start_col) for r in capacity_chunks(df, ["g"], ["ord"], by_width("ord", 16), "w", cap=64).collect()}
    for g, ws in data.items():
        assert [got[g, i] for i in range(len(ws))] == next_fit(ws, 64)


def simulate(rows, queue_max, last):
    """rows: (seq, x, y, intra, taken) in order."""
    queue, batch, out = [], 0, {}
    for seq, x, y, intra, taken in rows:
        if intra and queue and (queue[0][1] < y or (x - 1, y) in queue):
            queue, batch = [], batch + 1
        if taken:
            if len(queue) >= queue_max:
                queue, batch = [], batch + 1
            queue.append((x, y))
            out[seq] = batch
        if (x, y) == last and queue:
            queue, batch = [], batch + 1
    return out


@pytest.mark.parametrize("queue_max,p_intra", [(7, 0.05), (1024, 0.02), (5, 0.4)])
def test_flush_batches(spark, queue_max, p_intra):
    rnd = random.Random(queue_max)
    rows, want = [], {}
    for frame in range(4):
        pic = [(s, s % 12, s // 12, rnd.random() < p_intra, rnd.random() < 0.7) for s in range(12 * 9)]
        rows += [(frame, *r) for r in pic]
        want.update({(frame, s): b for s, b in simulate(pic, queue_max, (11, 8)).items()})
    df = spark.createDataFrame(rows, "frame bigint, seq bigint, mb_x int, mb_y int, intra boolean, taken boolean")
    got = flush_batches(df, ["frame"], (F.col("mb_x") == 11) & (F.col("mb_y") == 8), queue_max)
    assert {(r.frame, r.seq): r.batch_id for r in got.collect()} == want
    stats = {r.frame: r.blocks for r in batch_stats(got, ["frame"]).collect()}
    assert sum(stats.values()) == len(want)


@pytest.mark.parametrize("p_intra", [0.005, 0.3])
def test_flush_batches_of_a_picture_of_many_blocks(spark, p_intra):
    rnd = random.Random(5)
    pic = [(s, s % 2, s // 2, rnd.random() < p_intra, rnd.random() < 0.4) for s in range(2 * 900)]
    df = spark.createDataFrame(pic, "seq bigint, mb_x int, mb_y int, intra boolean, taken boolean").withColumn("frame", F.lit(1))
    got = flush_batches(df, ["frame"], (F.col("mb_x") == 1) & (F.col("mb_y") == 899), 50)
    assert {r.seq: r.batch_id for r in got.collect()} == simulate(pic, 50, (1, 899))
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Join") == 1  # only the block totals


def test_next_after_beyond_the_own_value(spark):
    rows = [(g, i, i // 3, rnd) for g in "ab" for i in range(60) for rnd in [random.Random(f"{g}{i}").choice([None, None, 60 - i, i])]]
    df = spark.createDataFrame(rows, "g string, i bigint, row bigint, v bigint").repartition(3)
    got = next_after(df, ["g"], ["i"], by_width("row", 4), {"near": F.col("v")}, {"least": ("row", F.col("v"))}).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [x for x in rows if x[0] == r.g and x[3] is not None]
        assert r.least == min((x[3] for x in mine if x[2] > r.row), default=None)
        assert r.near == next((x[3] for x in mine if x[1] > r.i), None)


def test_complete_items_judges_an_item_on_its_row(spark):
    rows = [(1, [(0, True), (1, True)]), (2, [(0, True), (1, False), (2, True)]), (3, []), (4, None), (5, [(0, True)])]
    items = spark.createDataFrame(rows, "item int, parts array<struct<n:int,ok:boolean>>")
    bad = F.get(F.filter("parts", lambda p: ~p["ok"]), F.lit(0))["n"]
    got = complete_items(items, ["item"], F.col("parts"), bad)
    assert sorted((r.item, r.n) for r in got.collect()) == [(1, 0), (1, 1), (5, 0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_margins_at_their_edges(spark):
    at = [-9, -8, -1, 0, 7, 8, 9, 700, *range(4 * (64 - 16) - 20, 4 * 64 + 4)]
    rows = [(x, y, w, h) for x in at for y in (8, 20) for w, h in ((16, 16), (8, 4), (4, 8))] + [(y, x, w, h) for x in at for y in (8, 20) for w, h in ((16, 16), (8, 4), (4, 8))]
    df = spark.createDataFrame(rows, "x int, y int, w int, h int")
    args = (F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(64), F.lit(64))
    for x, y, w, h, luma, chroma in df.select("*", luma_inside(*args), chroma_inside(*args)).collect():
        assert luma == all((v >> 2) - 2 >= 0 and (v >> 2) + n + 2 < 64 for v, n in ((x, w), (y, h)))
        assert chroma == all((v >> 3) >= 0 and (v >> 3) + n // 2 + 1 < 32 for v, n in ((x, w), (y, h)))


def test_capacity_chunks_joins_only_block_totals(spark):
    rnd = random.Random(1)
    widths = [rnd.choice([4, 8, 16, 90]) for _ in range(200)]
    df = spark.createDataFrame([(1, i, w, "x") for i, w in enumerate(widths)], "g int, ord bigint, w int, more string").repartition(3)
    got = capacity_chunks(df, ["g"], ["ord"], by_width("ord", 16), "w", cap=64)
    assert [(r.chunk_no, r.start_col) for r in got.orderBy("ord").collect()] == next_fit(widths, 64)
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Join") == 1


def test_exits_of_a_long_block():
    rnd = random.Random(4)
    edges = {p: p + rnd.choice([1, 1, 2, 700]) for p in range(3000) if rnd.random() < 0.9}
    pos, nxt = np.array(list(edges))[::-1], np.array(list(edges.values()))[::-1]
    wanted = np.arange(0, 3100, 7)
    entries, exits = _exits(pos, nxt, wanted)
    assert isinstance(exits, np.ndarray)
    known = [w for w in wanted.tolist() if w in edges]
    assert entries.tolist() == known

    def leave(at):
        while at in edges:
            at = edges[at]
        return at

    assert exits.tolist() == [leave(w) for w in known]
    assert [len(a) for a in _exits(pos[:0], nxt[:0], wanted)] == [0, 0]


def test_cell_arrays_are_built_for_judged_blocks_only(spark):
    sf, key = "/root/testdata/sf0.001", ["file_id", "frame", "seq"]
    got = streaming_q._blocks(spark, sf)
    assert sorted(got.select(*key, "taken").collect()) == sorted(outcomes(fixtures.macroblock_info(spark, sf)).select(*key, "taken").collect())
    lines = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "array_repeat" in x]
    assert lines and all("CASE WHEN" in x.split("array_repeat")[0] for x in lines)
