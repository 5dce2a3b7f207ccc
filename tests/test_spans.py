"""Span lookups against a scan of all spans."""

import random

import pytest
from pyspark.sql import functions as F

from mediaframe.functions.spans import first_span, span_join
from mediaframe.operators import trace as X

SPANS = "low long, high long, rank long, name string"


def scan(v, spans):
    held = [(r, lo, hi, n) for lo, hi, r, n in spans if lo <= v <= hi] if v is not None else []
    return min(held)[3] if held else None


@pytest.mark.parametrize("seed", [1, 2])
def test_first_span_wins(spark, seed):
    rnd = random.Random(seed)
    spans = []
    for i in range(300):
        low = rnd.randrange(-5000, 5000)
        spans.append((low, low + rnd.choice([-3, 0, 0, 1, 7, 64, 1023, 4000]), rnd.randrange(40), f"s{i}"))
    spans += [(-(1 << 40), 1 << 40, 99, "everything")] if seed == 1 else [(1 << 31, 1 << 33, 0, "far")]
    values = [rnd.randrange(-6000, 10_000) for _ in range(2000)] + [7] * 1000 + [None, 1 << 32, -(1 << 41), (1 << 63) - 1, -(1 << 63)]
    rows = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    got = {r.i: r.name for r in span_join(rows, spark.createDataFrame(spans, SPANS), "v", "i").collect()}
    assert got == {i: scan(v, spans) for i, v in enumerate(values)}


def test_no_spans_and_no_rows(spark):
    rows, none = spark.createDataFrame([(1, 5)], "i long, v long"), spark.createDataFrame([], SPANS)
    assert [r.name for r in span_join(rows, none, "v", "i").collect()] == [None]
    assert span_join(rows.limit(0), spark.createDataFrame([(0, 9, 0, "a")], SPANS), "v", "i").count() == 0


def test_no_range_join_in_the_plan(spark):
    spans = spark.createDataFrame([(i, i + 5, 0, "a") for i in range(50)], SPANS)
    df = span_join(spark.range(100).selectExpr("id AS i", "id * 3 AS v"), spans, "v", "i")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_the_fixed_blocks_as_a_table(spark):
    """The list of register blocks, looked up as a table of spans, gives what the column of fixed cases gives."""
    spans = spark.createDataFrame([(lo, hi - 1, i, n) for i, (lo, hi, n) in enumerate(X.BLOCKS)], SPANS)
    rows = spark.range(0, 40_000, 4).selectExpr("id AS i", "id AS addr")
    both = span_join(rows, spans, "addr", "i").select("name", X.block_of(F.col("addr")).alias("block"))
    assert both.where("not (name <=> block)").count() == 0 and both.where("name is not null").count() > 0


def test_overlapping_spans_do_not_multiply(spark):
    """A value inside thousands of spans meets one row a width; the ends of the range of a long are spans too."""
    big = (1 << 63) - 1
    spans = spark.range(3000).select((F.col("id") % 50 - 7).alias("low"), (F.col("id") % 50 + 900 + F.col("id") % 7).alias("high"), (F.col("id") % 11 + 1).alias("rank"), F.col("id").cast("string").alias("name"))
    spans = spans.unionByName(spark.createDataFrame([(-big - 1, big, 50, "all"), (big, big, 0, "top"), (-big - 1, -big, 0, "bottom"), (5, 4, 0, "none")], spans.schema)).cache()
    values = [-big - 1, -big, -8, -7, 0, 41, 42, 899, 955, 956, big - 1, big]
    found = first_span(spark.createDataFrame([(v,) for v in values], "v long"), spans, "v", "low", "high", "rank", ["name"])
    held = spans.collect()
    want = {v: min((s["rank"], s["low"], s["high"], s["name"]) for s in held if s["low"] <= v <= s["high"])[3] for v in values}
    assert {r["v"]: r["name"] for r in found.collect()} == want
    assert ">= __lo" not in found._jdf.queryExecution().toString()  # joined by pieces alone
