"""User function queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.operators import udf as U
from mediaframe.operators.blocks import smooth_edge
from mediaframe.plans import fixtures as fx
from mediaframe.plans.blocks_q import edge_rows
from mediaframe.plans.container_q import UNITS
from mediaframe.plans.registry import query
from mediaframe.plans.trace_q import HEADS
from mediaframe.sources.ranged import movie_rows


@F.pandas_udf(T.IntegerType())
def short_vectors(mv_x: pd.Series, mv_y: pd.Series) -> pd.Series:
    """Handles vectors up to 40 quarter pels, declines the rest."""
    cost = mv_x.abs() + mv_y.abs()
    return cost.where(cost <= 40).astype("Int32")


@F.pandas_udf(T.IntegerType())
def flat_edges(alpha: pd.Series, beta: pd.Series) -> pd.Series:
    total = alpha + beta
    return total.where(total % 2 == 0).astype("Int32")


COST = "abs(mv_x)+abs(mv_y)"


@query("udf_with_fallback", f"SELECT file_id, frame, seq, CASE WHEN {COST}<=40 THEN {COST} ELSE -1 END AS cost, {COST}<=40 AS handled FROM mb", ["mb"])
def _(spark, sf):
    mb = fx.macroblocks(spark, sf).select("file_id", "frame", "seq", "mv_x", "mv_y")
    return U.with_fallback(mb, "cost", short_vectors, ["mv_x", "mv_y"], F.lit(-1)).drop("mv_x", "mv_y")


@query("udf_disabled", "SELECT file_id, frame, seq, -1::BIGINT AS cost, false AS handled FROM mb", ["mb"])
def _(spark, sf):
    mb = fx.macroblocks(spark, sf).select("file_id", "frame", "seq", "mv_x", "mv_y")
    return U.with_fallback(mb, "cost", short_vectors, ["mv_x", "mv_y"], F.lit(-1), enabled=False).drop("mv_x", "mv_y")


@query("udf_handled_counts", f"SELECT slice, count(*) FILTER ({COST}<=40) AS taken, count(*) FILTER ({COST}>40) AS declined FROM mb GROUP BY slice", ["mb"])
def _(spark, sf):
    mb = fx.macroblocks(spark, sf).select("slice", "mv_x", "mv_y")
    return U.handled_counts(U.with_fallback(mb, "cost", short_vectors, ["mv_x", "mv_y"], F.lit(-1)), ["slice"])


@query("udf_observed", "SELECT count(*) AS seen, max(value) AS max_value, count(DISTINCT event_type) AS types FROM events")
def _(spark, sf):
    e = fx.table(spark, sf, "events").select("event_type", "value")
    seen, metrics = U.observed(e, "events_seen", F.count(F.lit(1)).alias("seen"), F.max("value").alias("max_value"))
    types = len(seen.groupBy("event_type").agg(F.count("*").alias("n")).collect())  # five event types
    return spark.createDataFrame([(metrics.get["seen"], metrics.get["max_value"], types)], "seen long, max_value double, types long")


@query(
    "udf_edge_fallback",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN t%2=0 THEN t ELSE q END AS result, t%2=0 AS handled FROM (
       SELECT *, 21+l_partkey%30+l_partkey%10 AS t, (l_partkey*2)%24+100 AS q FROM lineitem)""",
)
def _(spark, sf):
    e = edge_rows(spark, sf)
    # default path: the filter itself; a negative strength leaves the pixel as it is
    default = F.get(smooth_edge(F.get("window", F.lit(0)), F.col("alpha"), F.col("beta"), F.lit(-1)), F.lit(0))
    return U.with_fallback(e, "result", flat_edges, ["alpha", "beta"], default).select(*fx.LINE_ORDER, "result", "handled")


@query(
    "udf_split_units",
    UNITS + ", z AS (SELECT path, sample_idx, min(off-CASE WHEN bad_tail THEN 0 ELSE 4 END) AS o FROM u GROUP BY ALL) SELECT path, sample_idx, nal_idx, off-o AS off, len, nal_type, bad_tail FROM u JOIN z USING (path, sample_idx)",
)
def _(spark, sf):
    return U.units_of(movie_rows(spark, fx.movie_folder(spark, sf), "payloads"), "payload", 4, ["path", "sample_idx"])


@query("udf_packets", HEADS + " SELECT stream_id, dw, w, kind, cnt, complete FROM h", ["word"])
def _(spark, sf):
    U.register_table_functions(spark)
    w = fx.words(spark, sf)
    # at most 60 words per stream
    packed = w.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("dw", "w"))).alias("a")).select("stream_id", F.col("a.w").alias("words"))
    packed.createOrReplaceTempView("mediaframe_buffers")
    return spark.sql("SELECT stream_id, p.* FROM mediaframe_buffers, LATERAL packets(words) p")
