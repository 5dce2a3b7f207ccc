"""Profile queries. Times are whole ticks, so sums do not depend on their order; quotients are rounded for the reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediaframe.functions.ordered import by_span
from mediaframe.operators import profile as P
from mediaframe.plans import fixtures as fx
from mediaframe.plans.registry import query


def r4(df, *keep):
    """Round every double column but the named ones to 4 places."""
    return df.select(*[F.round(F.col(c), 4).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query(
    "profile_inter_arrival",
    """SELECT run, f, round((epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY run ORDER BY f)))/1000.0::DOUBLE, 4) AS gap_ms FROM tim""",
    ["tim"],
)
def _(spark, sf):
    t = fx.timings(spark, sf).select("run", "f", "ts")
    return r4(P.inter_arrival(t, ["run"], ["ts", "f"], by_span("ts"), "ts")).drop("ts")


@query(
    "profile_totals",
    """SELECT run, count(*) AS frames, round(sum(live_ms),4) AS live_total, round(avg(live_ms),4) AS live_avg, round(sum(ref_ms),4) AS ref_total, round(avg(ref_ms),4) AS ref_avg
       FROM tim GROUP BY run""",
    ["tim"],
)
def _(spark, sf):
    return r4(P.totals(fx.timings(spark, sf), ["run"]))


@query(
    "profile_steady_state",
    """SELECT run, round(l,4) AS live_steady, round(r,4) AS ref_steady, n AS warm_frames, round(greatest(l,r)/least(l,r),4) AS ratio, CASE WHEN l>r THEN 'slower' ELSE 'faster' END AS label
       FROM (SELECT run, avg(live_ms) AS l, avg(ref_ms) AS r, count(*) AS n FROM tim WHERE f>0 GROUP BY run)""",
    ["tim"],
)
def _(spark, sf):
    return r4(P.steady_state(fx.timings(spark, sf), ["run"]))


@query(
    "profile_budget_check",
    """SELECT run, met, n, round(100.0::DOUBLE*met/n,4) AS pct, met=n AS realtime FROM (SELECT run, count(*) FILTER (live_ms<=33.333) AS met, count(*) AS n FROM tim WHERE f>0 GROUP BY run)""",
    ["tim"],
)
def _(spark, sf):
    return r4(P.budget_check(fx.timings(spark, sf), ["run"]))


@query(
    "profile_without_warmup",
    "SELECT run, count(*) FILTER (f>=2) AS iters, round(avg(live_ms) FILTER (f>=2),4) AS mean_ms FROM tim GROUP BY run",
    ["tim"],
)
def _(spark, sf):
    return r4(P.without_warmup(fx.timings(spark, sf), ["run"], "f", "live_ms"))


@query(
    "profile_per_call",
    """SELECT site, phase, count(v) AS calls, round(coalesce(sum(v),0),4) AS total_ms, round(coalesce(sum(v)/nullif(count(v),0),0),4) AS mean_ms
       FROM (SELECT site, phase, CASE WHEN phase<>'read' THEN wall_ms END AS v FROM prof) GROUP BY ALL""",
    ["prof"],
)
def _(spark, sf):
    p = fx.profile_rows(spark, sf).withColumn("wall_ms", F.when(F.col("phase") != "read", F.col("wall_ms")))
    return r4(P.per_call(p, ["site", "phase"]))


@query(
    "profile_cpu_share",
    """SELECT site, round(sum(wall_ms),4) AS wall_ms, round(sum(cpu_ms),4) AS cpu_ms, round(CASE WHEN sum(wall_ms)=0 THEN 0 ELSE 100*sum(cpu_ms)/sum(wall_ms) END,4) AS cpu_pct FROM prof GROUP BY ROLLUP(site)""",
    ["prof"],
)
def _(spark, sf):
    return r4(P.cpu_share(fx.profile_rows(spark, sf)))


@query(
    "profile_phase_breakdown",
    "SELECT site, "
    + ", ".join(
        f"round(sum(wall_ms) FILTER (phase='{p}'),4) AS {p}_wall, round(sum(cpu_ms) FILTER (phase='{p}'),4) AS {p}_cpu, "
        f"round(100*(sum(cpu_ms) FILTER (phase='{p}'))/(sum(wall_ms) FILTER (phase='{p}')),4) AS {p}_pct"
        for p in P.PHASES
    )
    + " FROM prof GROUP BY site",
    ["prof"],
)
def _(spark, sf):
    return r4(P.phase_breakdown(fx.profile_rows(spark, sf)))


@query(
    "profile_phase_cube",
    "SELECT site, phase, round(sum(wall_ms),4) AS wall_ms, count(*) AS calls FROM prof GROUP BY CUBE(site, phase)",
    ["prof"],
)
def _(spark, sf):
    return r4(P.phase_cube(fx.profile_rows(spark, sf)))


@query(
    "profile_spans",
    """SELECT user_id, event_id AS span, round(wall_ms,4) AS wall_ms, round(cpu_ms*0.75+cpu_ms*0.25,4) AS cpu_ms FROM prof""",
    ["prof"],
)
def _(spark, sf):
    p = fx.profile_rows(spark, sf)
    t0 = (F.col("event_id") % 1000).cast("double")
    rec = lambda k, t, u, s: F.struct(F.lit(k).alias("kind"), t.alias("t_ms"), u.alias("user_ms"), s.alias("sys_ms"))
    ev = p.select(
        "user_id", F.col("event_id").alias("span"),
        F.inline(F.array(
            rec("start", t0, t0 * 2, t0),
            rec("stop", t0 + F.col("wall_ms"), t0 * 2 + F.col("cpu_ms") * 0.75, t0 + F.col("cpu_ms") * 0.25),
        )),
    )
    return r4(P.spans(ev, ["user_id", "span"]))


@query(
    "profile_cache_stats",
    """SELECT site, h AS hits, round(hm,4) AS hit_ms, m AS misses, round(mm,4) AS miss_ms, round(CASE WHEN h=0 THEN 0 ELSE hm/h END,4) AS ms_per_hit, round(CASE WHEN m=0 THEN 0 ELSE mm/m END,4) AS ms_per_miss
       FROM (SELECT site, count(*) FILTER (cpu_ms<wall_ms*0.5) AS h, coalesce(sum(wall_ms) FILTER (cpu_ms<wall_ms*0.5),0) AS hm,
         count(*) FILTER (NOT cpu_ms<wall_ms*0.5) AS m, coalesce(sum(wall_ms) FILTER (NOT cpu_ms<wall_ms*0.5),0) AS mm FROM prof GROUP BY site)""",
    ["prof"],
)
def _(spark, sf):
    p = fx.profile_rows(spark, sf).withColumn("is_hit", F.col("cpu_ms") < F.col("wall_ms") * 0.5)
    return r4(P.cache_stats(p, ["site"]))


@query(
    "profile_cpu_behaviour",
    "SELECT event_id, CASE WHEN cpu_ms>wall_ms*0.7 THEN 'busy' WHEN cpu_ms<wall_ms*0.2 THEN 'yields' ELSE 'partial' END AS behaviour FROM prof",
    ["prof"],
)
def _(spark, sf):
    return fx.profile_rows(spark, sf).select("event_id", P.cpu_behaviour(F.col("wall_ms"), F.col("cpu_ms")).alias("behaviour"))


STAGES = """(SELECT clip, avg(ms) FILTER (stage='full') AS a, avg(ms) FILTER (stage='nodeblock') AS b, avg(ms) FILTER (stage='entropy') AS c FROM stg GROUP BY clip)"""


@query(
    "profile_stage_decomposition",
    f"""SELECT clip, round(a,4) AS "full", round(b,4) AS nodeblock, round(c,4) AS entropy, round(a-b,4) AS deblock, round(b-c,4) AS recon, round(1-c/a,4) AS offloadable, round(1000/a,4) AS fps FROM {STAGES}""",
    ["stg"],
)
def _(spark, sf):
    return r4(P.stage_decomposition(fx.stage_rows(spark, sf), ["clip"]))


@query(
    "profile_without_component",
    f"""SELECT clip, round(a,4) AS total, round(c,4) AS part, round(a-c,4) AS remaining, round(CASE WHEN a-c>0 THEN a/(a-c) END,4) AS max_speedup FROM {STAGES}""",
    ["stg"],
)
def _(spark, sf):
    d = P.stage_decomposition(fx.stage_rows(spark, sf), ["clip"]).select("clip", F.col("full").alias("total"), F.col("entropy").alias("part"))
    return r4(P.without_component(d, "total", "part"))


@query(
    "profile_config_ratio",
    """SELECT stage, round(a,4) AS base, round(b,4) AS other, round(b/a,4) AS ratio FROM (SELECT stage, avg(ms) FILTER (clip=0) AS a, avg(ms) FILTER (clip=1) AS b FROM stg GROUP BY stage)""",
    ["stg"],
)
def _(spark, sf):
    s = fx.stage_rows(spark, sf).withColumn("cfg", F.concat(F.lit("c"), F.col("clip").cast("string")))
    return r4(P.config_ratio(s, "stage", "cfg", "ms", "c0", "c1"))


@query(
    "profile_thread_scaling",
    """SELECT clip, threads, round(m,4) AS ms, round(first_value(m) OVER (PARTITION BY clip ORDER BY threads)/m,4) AS speedup FROM (SELECT clip, threads, avg(ms) AS m FROM stg GROUP BY ALL)""",
    ["stg"],
)
def _(spark, sf):
    return r4(P.thread_scaling(fx.stage_rows(spark, sf), ["clip"]))


@query(
    "profile_two_point_fit",
    """SELECT clip, round(ls,4) AS ls_slope, round(li,4) AS ls_intercept, round(r2,4) AS ls_r2, round(s,4) AS slope, round(y0-s*x0,4) AS intercept, round((y0-s*x0)/((y0-s*x0)+s*4096),4) AS fixed_share
       FROM (SELECT *, (y1-y0)/(x1-x0) AS s FROM (SELECT clip, regr_slope(ms, x) AS ls, regr_intercept(ms, x) AS li, regr_r2(ms, x) AS r2,
         min(x) AS x0, max(x) AS x1, arg_min(ms, (x, ms)) AS y0, arg_max(ms, (x, ms)) AS y1 FROM (SELECT clip, ms, (event_id%997)::DOUBLE AS x FROM stg) GROUP BY clip))""",
    ["stg"],
)
def _(spark, sf):
    s = fx.stage_rows(spark, sf).withColumn("x", (F.col("event_id") % 997).cast("double"))
    return r4(P.two_point_fit(s, ["clip"], "x", "ms", 4096.0))


@query(
    "profile_ab_verdict",
    """SELECT clip, round(a,4) AS "full", round(b,4) AS nodeblock, round(100*abs(a-b)/a,4) AS pct, CASE WHEN b<a THEN 'faster' WHEN b>a THEN 'slower' ELSE 'same' END AS verdict FROM """ + STAGES,
    ["stg"],
)
def _(spark, sf):
    return r4(P.ab_verdict(fx.stage_rows(spark, sf), ["clip"], "stage", "ms", "full", "nodeblock"))


@query(
    "profile_variant_matrix",
    """WITH v AS (SELECT phase, avg(wall_ms) AS m FROM prof GROUP BY phase)
       SELECT a.phase AS num, b.phase AS den, round(a.m/b.m,4) AS ratio FROM v a, v b WHERE (a.phase,b.phase) IN (('upload','pack'),('read','pack'),('draw','pack'),('draw','read'))""",
    ["prof"],
)
def _(spark, sf):
    pairs = [("upload", "pack"), ("read", "pack"), ("draw", "pack"), ("draw", "read")]
    return r4(P.variant_matrix(fx.profile_rows(spark, sf), "phase", "wall_ms", pairs))


@query(
    "profile_above_floor",
    """SELECT site, phase, round(m,4) AS mean_ms, round(f,4) AS floor_ms, round(m-f,4) AS above_ms, round(m/f,4) AS times_floor
       FROM (SELECT *, max(CASE WHEN phase='pack' THEN m END) OVER (PARTITION BY site) AS f FROM (SELECT site, phase, avg(wall_ms) AS m FROM prof GROUP BY ALL))""",
    ["prof"],
)
def _(spark, sf):
    return r4(P.above_floor(fx.profile_rows(spark, sf), ["site"], "phase", "wall_ms", "pack"))


@query(
    "profile_cost_per_unit",
    """SELECT site, round(sum(wall_ms),4) AS ms, sum(event_id%50+1)::BIGINT AS units, round(sum(wall_ms)*1e6/(sum(event_id%50+1)*64),4) AS ns_per_px FROM prof GROUP BY site""",
    ["prof"],
)
def _(spark, sf):
    return r4(P.cost_per_unit(fx.profile_rows(spark, sf), ["site"], "wall_ms", F.col("event_id") % 50 + 1))


@query(
    "profile_sweep_elbow",
    """SELECT clip, threads, round(m,4) AS mean_ms, round(g,4) AS gain, coalesce(threads=min(CASE WHEN g<0.05 THEN threads END) OVER (PARTITION BY clip), false) AS elbow
       FROM (SELECT *, 1-m/lag(m) OVER (PARTITION BY clip ORDER BY threads) AS g FROM (SELECT clip, threads, avg(ms) AS m FROM stg GROUP BY ALL))""",
    ["stg"],
)
def _(spark, sf):
    return r4(P.sweep_elbow(fx.stage_rows(spark, sf), ["clip"], "threads", "ms"))


@query(
    "profile_reconcile",
    """SELECT run, a, b, c, a+b+c AS classified, round((a+b+c)/10.0::DOUBLE,4) AS frames_decoded, (a+b+c)%10=0 AS whole_frames, round((a+b+c)/10.0::DOUBLE-fr,4) AS extra_frames FROM (
       SELECT run, count(*) FILTER (event_type='purchase') AS a, count(*) FILTER (event_type='view') AS b, count(*) FILTER (event_type NOT IN ('purchase','view')) AS c, max(f)//10 AS fr FROM tim GROUP BY run)""",
    ["tim"],
)
def _(spark, sf):
    e = F.col("event_type")
    c = fx.timings(spark, sf).groupBy("run").agg(
        F.count_if(e == "purchase").alias("a"), F.count_if(e == "view").alias("b"), F.count_if(~e.isin("purchase", "view")).alias("c"),
        F.call_function("div", F.max("f"), F.lit(10)).alias("fr"),
    )
    return r4(P.reconcile(c, ["a", "b", "c"], F.lit(10), F.col("fr"))).drop("fr")


@query("profile_progress_rows", "SELECT run, f, live_ms FROM tim WHERE f+1<=3 OR (f+1)%50=0", ["tim"])
def _(spark, sf):
    return P.progress_rows(fx.timings(spark, sf).select("run", "f", "live_ms"), "f")
