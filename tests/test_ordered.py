"""Blocked scans against plain Python, with blocks far smaller than the hot group."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediaframe.functions.ordered import BLK, by_width, first_k, in_blocks, lag_rows, last_at, next_after, row_index, running_sums, with_halo


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for g, n in (("hot", 400), ("b", 90), ("c", 1)):
        pos = sorted(rnd.sample(range(1000), n))
        out += [(g, p, rnd.randint(-5, 9), rnd.choice([None, None, rnd.randint(0, 99)])) for p in pos]
    rnd.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g string, pos bigint, v bigint, maybe bigint").repartition(5)


def groups(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [4, 64, 1 << 16])
def test_running_sums_and_index(df, rows, width):
    got = running_sums(df, ["g"], ["pos"], by_width("pos", width), {"incl": (F.col("v"), True), "excl": (F.col("v"), False)})
    idx = {(r.g, r.pos): r.i for r in row_index(df, ["g"], ["pos"], by_width("pos", width), "i").collect()}
    seen = {(r.g, r.pos): (r.incl, r.excl) for r in got.collect()}
    for g, rs in groups(rows).items():
        total = 0
        for i, (_, p, v, _m) in enumerate(rs):
            assert seen[g, p] == (total + v, total)
            assert idx[g, p] == i
            total += v


@pytest.mark.parametrize("width", [4, 1 << 16])
def test_carries_and_lag(df, rows, width):
    blk = lambda: by_width("pos", width)
    at = {(r.g, r.pos): r.x for r in last_at(df, ["g"], ["pos"], blk(), {"x": F.col("maybe")}).collect()}
    after = {(r.g, r.pos): r.x for r in next_after(df, ["g"], ["pos"], blk(), {"x": F.col("maybe")}).collect()}
    lag = {(r.g, r.pos): (r.a, r.b) for r in lag_rows(df, ["g"], ["pos"], blk(), {"a": F.col("v"), "b": F.col("maybe")}).collect()}
    for g, rs in groups(rows).items():
        for i, (_, p, _v, _m) in enumerate(rs):
            known = [m for _, _, _, m in rs[: i + 1] if m is not None]
            later = [m for _, _, _, m in rs[i + 1 :] if m is not None]
            assert at[g, p] == (known[-1] if known else None)
            assert after[g, p] == (later[0] if later else None)
            assert lag[g, p] == ((rs[i - 1][2], rs[i - 1][3]) if i else (None, None))


def test_chain_over_the_same_blocks_shuffles_rows_once(df):
    chained = in_blocks(df, by_width("pos", 16))
    once = running_sums(chained, ["g"], ["pos"], None, {"s": (F.col("v"), True)})
    assert BLK in once.columns
    both = lag_rows(once, ["g"], ["pos"], None, {"p": F.col("s")}).drop(BLK)
    for r in both.where("p is not null").collect():
        assert r.s == r.p + r.v


def test_halo_windows_match_whole_windows(spark):
    d = spark.range(500).select(F.lit("k").alias("g"), F.col("id").alias("pos"), (F.col("id") * 7 % 31).alias("w"))
    h = with_halo(d, "pos", before=2, after=3, width=16)
    w = Window.partitionBy("g", BLK).orderBy("pos")
    got = h.select("g", "pos", "halo", F.lag("w", 2).over(w).alias("a"), F.lead("w", 3).over(w).alias("b")).where("not halo").drop("halo")
    whole = Window.partitionBy("g").orderBy("pos")
    want = d.select("g", "pos", F.lag("w", 2).over(whole).alias("a"), F.lead("w", 3).over(whole).alias("b"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_first_k_beyond_the_group_limit(spark):
    d = spark.range(9000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("o"))
    got = first_k(d, ["g"], ["o"], 3000).groupBy("g").agg(F.count("*").alias("n"), F.max("rank").alias("r"), F.max("o").alias("hi")).collect()
    for r in got:
        want = sorted(x.o for x in d.where(F.col("g") == r.g).collect())[:3000]
        assert (r.n, r.r, r.hi) == (3000, 2999, want[-1])
    plan = first_k(d, ["g"], ["o"], 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
