"""Profile operators on published measurements."""

from pyspark.sql import functions as F

from mediaframe.functions.ordered import by_width
from mediaframe.operators import profile as P


def frame(spark, rows, cols):
    return spark.createDataFrame(rows, cols)


def test_thread_scaling(spark):
    df = frame(spark, [("720p", 1, 16.9), ("720p", 4, 5.0), ("1080p", 1, 39.3), ("1080p", 2, 20.9), ("1080p", 4, 11.9)], "clip string, threads int, ms double")
    got = {(r.clip, r.threads): round(r.speedup, 2) for r in P.thread_scaling(df, ["clip"]).collect()}
    assert got == {("720p", 1): 1.0, ("720p", 4): 3.38, ("1080p", 1): 1.0, ("1080p", 2): 1.88, ("1080p", 4): 3.3}


def test_config_ratio(spark):
    df = frame(spark, [("steady", "p360", 35.4), ("steady", "p720", 207.9), ("trips", "p360", 10.0), ("trips", "p720", 122.0)], "metric string, cfg string, v double")
    got = {r.metric: round(r.ratio, 1) for r in P.config_ratio(df, "metric", "cfg", "v", "p360", "p720").collect()}
    assert got == {"steady": 5.9, "trips": 12.2}


def test_steady_state_and_budget(spark):
    rows = [("a", 0, 695.9, 59.8), ("a", 1, 388.6, 21.1), ("a", 2, 19.6, 16.8), ("one", 0, 5.0, 5.0)]
    df = frame(spark, rows, "run string, f bigint, live_ms double, ref_ms double")
    s = P.steady_state(df, ["run"]).collect()
    assert [r.run for r in s] == ["a"] and s[0].label == "slower" and round(s[0].ratio, 2) == round(408.2 / 37.9, 2)
    b = {r.run: (r.met, r.n, r.pct, r.realtime) for r in P.budget_check(df, ["run"]).collect()}
    assert b == {"a": (1, 2, 50.0, False), "one": (0, 0, 0.0, False)}
    w = {r.run: (r.iters, r.mean_ms) for r in P.without_warmup(df, ["run"], "f", "live_ms").collect()}
    assert w == {"a": (1, 19.6), "one": (0, None)}


def test_floor_and_ab(spark):
    df = frame(spark, [("blocking", 0.130), ("polled", 0.077)], "variant string, ms double")
    r = P.ab_verdict(df, [], "variant", "ms", "blocking", "polled").first()
    assert round(r.pct) == 41 and r.verdict == "faster"
    ph = frame(spark, [("t", "pack", 0.12), ("t", "upload", 0.06), ("t", "draw", 0.254), ("t", "read", 0.34)], "site string, phase string, ms double")
    f = {r.phase: round(r.times_floor, 2) for r in P.above_floor(ph, ["site"], "phase", "ms", "upload").collect()}
    assert f == {"pack": 2.0, "upload": 1.0, "draw": 4.23, "read": 5.67}


def test_shares_with_zero_guards(spark):
    df = frame(spark, [("a", 5194.2, 3898.9), ("idle", 0.0, 0.0)], "site string, wall_ms double, cpu_ms double")
    got = {r.site: round(r.cpu_pct) for r in P.cpu_share(df).collect()}
    assert got == {"a": 75, "idle": 0, None: 75}
    calls = P.per_call(frame(spark, [("a", 632.2), ("none", None)], "site string, wall_ms double"), ["site"])
    assert {r.site: (r.calls, r.mean_ms) for r in calls.collect()} == {"a": (1, 632.2), "none": (0, 0.0)}


def test_behaviour_classes(spark):
    df = frame(spark, [(84.0, 84.0 * 0.028), (6.3, 6.3 * 0.74), (10.0, 5.0)], "w double, c double")
    assert [r.b for r in df.select(P.cpu_behaviour(F.col("w"), F.col("c")).alias("b")).collect()] == ["yields", "busy", "partial"]


def test_fit_and_cost(spark):
    df = frame(spark, [("k", 1.0, 5.0), ("k", 3.0, 9.0), ("k", 2.0, 7.0)], "k string, x double, y double")
    r = P.two_point_fit(df, ["k"], "x", "y", 6.0).first()
    assert (r.slope, r.intercept, round(r.fixed_share, 3), r.ls_r2) == (2.0, 3.0, 0.2, 1.0)
    c = P.cost_per_unit(frame(spark, [("full", 0.192, 1000)], "c string, ms double, n bigint"), ["c"], "ms", F.col("n")).first()
    assert round(c.ns_per_px, 2) == 3.0


def test_component_bound_and_spans(spark):
    d = frame(spark, [(16.65, 10.92), (5.0, 5.0)], "total double, part double")
    assert [None if r.max_speedup is None else round(r.max_speedup, 2) for r in P.without_component(d, "total", "part").collect()] == [2.91, None]
    ev = [(1, "start", 10.0, 1.0, 0.5), (1, "stop", 25.0, 7.0, 2.5)]
    s = P.spans(frame(spark, ev, "span int, kind string, t_ms double, user_ms double, sys_ms double"), ["span"]).first()
    assert (s.wall_ms, s.cpu_ms) == (15.0, 8.0)


def test_gaps_and_progress(spark):
    df = spark.range(120).select(F.lit("r").alias("run"), F.col("id").alias("f"), F.timestamp_millis(F.col("id") * F.col("id")).alias("ts"))
    g = P.inter_arrival(df, ["run"], ["f"], by_width("f", 16), "ts")
    assert {r.f: r.gap_ms for r in g.collect()} == {i: (None if i == 0 else float(2 * i - 1)) for i in range(120)}
    assert [r.f for r in P.progress_rows(df, "f").orderBy("f").collect()] == [0, 1, 2, 49, 99]
