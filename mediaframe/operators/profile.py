"""Profile operators: timing tables in, report tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediaframe.functions.ordered import lag_rows


def ratio0(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def inter_arrival(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, ts: str, out: str = "gap_ms") -> DataFrame:
    """Milliseconds since the previous output row of the run; NULL on the first."""
    prev = lag_rows(df, keys, order, block, {"__t": F.col(ts)})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return prev.select(*df.columns, ((micros(ts) - micros("__t")) / 1000.0).alias(out))


def totals(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("frames"), F.sum("live_ms").alias("live_total"), F.avg("live_ms").alias("live_avg"),
        F.sum("ref_ms").alias("ref_total"), F.avg("ref_ms").alias("ref_avg"),
    )


def speed_ratio(a: Column, b: Column) -> tuple[Column, Column]:
    """Ratio that is never below 1, and the label for a against b."""
    return F.greatest(a, b) / F.least(a, b), F.when(a > b, "slower").otherwise("faster")


def steady_state(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means without frame 0, for runs of more than one frame, with the speed ratio."""
    warm = F.col("f") > 0
    r = df.groupBy(*by).agg(
        F.avg(F.when(warm, F.col("live_ms"))).alias("live_steady"), F.avg(F.when(warm, F.col("ref_ms"))).alias("ref_steady"),
        F.count_if(warm).alias("warm_frames"),
    ).where("warm_frames > 0")
    ratio, label = speed_ratio(F.col("live_steady"), F.col("ref_steady"))
    return r.withColumn("ratio", ratio).withColumn("label", label)


def budget_check(df: DataFrame, by: Sequence[str], budget_ms: float = 33.333) -> DataFrame:
    """Frames after the first that met the budget."""
    warm = F.col("f") > 0
    r = df.groupBy(*by).agg(F.count_if(warm & (F.col("live_ms") <= budget_ms)).alias("met"), F.count_if(warm).alias("n"))
    pct = F.when(F.col("n") > 0, F.lit(100.0) * F.col("met") / F.when(F.col("n") > 0, F.col("n"))).otherwise(0.0)
    done = (F.col("n") > 0) & (F.col("met") == F.col("n"))
    return r.withColumn("pct", pct).withColumn("realtime", done)


def without_warmup(df: DataFrame, by: Sequence[str], index: str, value: str, skip: int = 2) -> DataFrame:
    """Mean per iteration, leaving out the first ``skip`` iterations (index is 0-based)."""
    kept = F.when(F.col(index) >= skip, F.col(value))
    return df.groupBy(*by).agg(F.count(kept).alias("iters"), F.avg(kept).alias("mean_ms"))


def per_call(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Calls, total and mean per site; 0 for a site without calls (value NULL)."""
    r = df.groupBy(*by).agg(F.count("wall_ms").alias("calls"), F.coalesce(F.sum("wall_ms"), F.lit(0.0)).alias("total_ms"))
    return r.withColumn("mean_ms", ratio0(F.col("total_ms"), F.col("calls")))


def cpu_share(df: DataFrame) -> DataFrame:
    """CPU percent of wall per site and overall (site NULL)."""
    base = df.groupBy("site").agg(F.sum("wall_ms").alias("w"), F.sum("cpu_ms").alias("c"))
    r = base.rollup("site").agg(F.sum("w").alias("wall_ms"), F.sum("c").alias("cpu_ms"))
    return r.withColumn("cpu_pct", ratio0(F.lit(100.0) * F.col("cpu_ms"), F.col("wall_ms")))


PHASES = ("pack", "upload", "draw", "read")


def phase_breakdown(df: DataFrame, phases: Sequence[str] = PHASES) -> DataFrame:
    """Wall, CPU and CPU share per phase, one row per site."""
    r = df.groupBy("site").pivot("phase", list(phases)).agg(F.sum("wall_ms").alias("wall"), F.sum("cpu_ms").alias("cpu"))
    for p in phases:
        r = r.withColumn(f"{p}_pct", ratio0(F.lit(100.0) * F.col(f"{p}_cpu"), F.col(f"{p}_wall")))
    return r


def phase_cube(df: DataFrame) -> DataFrame:
    """Wall totals for every combination of site and phase; input collapses before the cube expands it."""
    base = df.groupBy("site", "phase").agg(F.sum("wall_ms").alias("w"), F.count("*").alias("n"))
    return base.cube("site", "phase").agg(F.sum("w").alias("wall_ms"), F.sum("n").alias("calls"))


def spans(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wall and CPU milliseconds from start/stop records sharing a span key.

    ``events`` has kind ('start'/'stop'), t_ms, user_ms and sys_ms; a span has one record of each kind.
    """
    at = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    r = events.groupBy(*keys).agg(*[at(k, c).alias(f"{k}_{c}") for k in ("start", "stop") for c in ("t_ms", "user_ms", "sys_ms")])
    wall = F.col("stop_t_ms") - F.col("start_t_ms")
    cpu = F.col("stop_user_ms") - F.col("start_user_ms") + F.col("stop_sys_ms") - F.col("start_sys_ms")
    return r.select(*keys, wall.alias("wall_ms"), cpu.alias("cpu_ms"))


def cache_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Hit and miss counts with mean cost (0 when there are none)."""
    hit = F.col("is_hit")
    part = lambda c: (F.count_if(c), F.coalesce(F.sum(F.when(c, F.col("wall_ms"))), F.lit(0.0)))
    (nh, sh), (nm, sm) = part(hit), part(~hit)
    r = df.groupBy(*by).agg(nh.alias("hits"), sh.alias("hit_ms"), nm.alias("misses"), sm.alias("miss_ms"))
    return r.withColumn("ms_per_hit", ratio0(F.col("hit_ms"), F.col("hits"))).withColumn("ms_per_miss", ratio0(F.col("miss_ms"), F.col("misses")))


def cpu_behaviour(wall: Column, cpu: Column) -> Column:
    return F.when(cpu > wall * 0.7, "busy").when(cpu < wall * 0.2, "yields").otherwise("partial")


def stage_decomposition(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stage costs by subtraction, offloadable share and frame rate."""
    r = df.groupBy(*by).pivot("stage", ["full", "nodeblock", "entropy"]).agg(F.avg("ms"))
    return r.select(
        *by, "full", "nodeblock", "entropy",
        (F.col("full") - F.col("nodeblock")).alias("deblock"),
        (F.col("nodeblock") - F.col("entropy")).alias("recon"),
        (1 - F.col("entropy") / F.col("full")).alias("offloadable"),
        (1000.0 / F.col("full")).alias("fps"),
    )


def without_component(df: DataFrame, total: str, component: str) -> DataFrame:
    """Bound on the gain from removing one component."""
    left = F.col(total) - F.col(component)
    return df.withColumn("remaining", left).withColumn("max_speedup", F.when(left > 0, F.col(total) / F.when(left > 0, left)))


def config_ratio(df: DataFrame, metric: str, config: str, value: str, base: str, other: str) -> DataFrame:
    """Metric of one configuration relative to another."""
    r = df.groupBy(metric).pivot(config, [base, other]).agg(F.avg(value))
    return r.select(metric, F.col(base).alias("base"), F.col(other).alias("other"), (F.col(other) / F.col(base)).alias("ratio"))


def thread_scaling(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Speed-up over the smallest thread count; the table is one row per (by, threads) after aggregation."""
    m = df.groupBy(*by, "threads").agg(F.avg("ms").alias("ms"))
    first = F.first_value("ms").over(Window.partitionBy(*by).orderBy("threads"))
    return m.withColumn("speedup", first / F.col("ms"))


def two_point_fit(df: DataFrame, by: Sequence[str], x: str, y: str, at: float) -> DataFrame:
    """Line through the end points, least-squares fit, and the fixed share of the line at x = at."""
    lo = F.min_by(F.struct(x, y), F.struct(F.col(x), F.col(y)))
    hi = F.max_by(F.struct(x, y), F.struct(F.col(x), F.col(y)))
    r = df.groupBy(*by).agg(
        lo.alias("lo"), hi.alias("hi"),
        F.regr_slope(y, x).alias("ls_slope"), F.regr_intercept(y, x).alias("ls_intercept"), F.regr_r2(y, x).alias("ls_r2"),
    )
    dx = F.col(f"hi.{x}") - F.col(f"lo.{x}")
    slope = F.when(dx != 0, (F.col(f"hi.{y}") - F.col(f"lo.{y}")) / F.when(dx != 0, dx))
    r = r.withColumn("slope", slope).withColumn("intercept", F.col(f"lo.{y}") - F.col("slope") * F.col(f"lo.{x}"))
    line = F.col("intercept") + F.col("slope") * at
    return r.withColumn("fixed_share", F.when(line != 0, F.col("intercept") / F.when(line != 0, line))).drop("lo", "hi")


def ab_verdict(df: DataFrame, by: Sequence[str], variant: str, value: str, a: str, b: str) -> DataFrame:
    """Percent difference of variant b against a, and which is faster."""
    r = df.groupBy(*by).pivot(variant, [a, b]).agg(F.avg(value))
    pct = F.lit(100.0) * F.abs(F.col(a) - F.col(b)) / F.col(a)
    r = r.withColumn("pct", pct)
    return r.withColumn("verdict", F.when(F.col(b) < F.col(a), "faster").when(F.col(b) > F.col(a), "slower").otherwise("same"))


def variant_matrix(df: DataFrame, variant: str, value: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Ratio of mean value for each wanted pair of variants, from one aggregate row."""
    names = sorted({v for p in pairs for v in p})
    r = df.groupBy().pivot(variant, names).agg(F.avg(value))
    return r.select(
        F.inline(F.array(*[
            F.struct(F.lit(p).alias("num"), F.lit(q).alias("den"), (F.col(p) / F.col(q)).alias("ratio")) for p, q in pairs
        ]))
    )


def above_floor(df: DataFrame, by: Sequence[str], phase: str, value: str, floor_phase: str) -> DataFrame:
    """Mean cost per phase, what is left after the floor phase, and the ratio to it."""
    m = df.groupBy(*by, phase).agg(F.avg(value).alias("mean_ms"))
    # the aggregate has one row per (by, phase), so the floor is a window over that small table
    floor = F.max(F.when(F.col(phase) == floor_phase, F.col("mean_ms"))).over(Window.partitionBy(*by))
    return m.withColumn("floor_ms", floor).withColumn("above_ms", F.col("mean_ms") - F.col("floor_ms")).withColumn(
        "times_floor", F.col("mean_ms") / F.col("floor_ms")
    )


def cost_per_unit(df: DataFrame, by: Sequence[str], ms: str, units: Column, per_unit: int = 64) -> DataFrame:
    """Nanoseconds per pixel: units of ``per_unit`` pixels each."""
    r = df.groupBy(*by).agg(F.sum(ms).alias("ms"), F.sum(units).alias("units"))
    return r.withColumn("ns_per_px", ratio0(F.col("ms") * 1e6, F.col("units") * per_unit))


def sweep_elbow(df: DataFrame, by: Sequence[str], param: str, value: str, threshold: float = 0.05) -> DataFrame:
    """Relative gain per parameter step and the first step whose gain is below the threshold."""
    m = df.groupBy(*by, param).agg(F.avg(value).alias("mean_ms"))
    w = Window.partitionBy(*by).orderBy(param)
    m = m.withColumn("gain", 1 - F.col("mean_ms") / F.lag("mean_ms").over(w))
    first = F.min(F.when(F.col("gain") < threshold, F.col(param))).over(Window.partitionBy(*by))
    return m.withColumn("elbow", F.coalesce(F.col(param) == first, F.lit(False)))


def reconcile(counts: DataFrame, classes: Sequence[str], blocks_per_frame: Column, frames: Column) -> DataFrame:
    """Do the class counts add up to whole frames, and to the stated number of them."""
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    r = counts.withColumn("classified", total).withColumn("frames_decoded", F.col("classified") / blocks_per_frame)
    return r.withColumn("whole_frames", F.col("classified") % blocks_per_frame == 0).withColumn(
        "extra_frames", F.col("frames_decoded") - frames
    )


def progress_rows(df: DataFrame, index: str, head: int = 3, every: int = 50) -> DataFrame:
    """The first rows and then every n-th, from a 0-based index."""
    n = F.col(index) + 1
    return df.where((n <= head) | (n % every == 0))


