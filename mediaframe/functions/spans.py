"""Look values up in a table of spans of any size: spans are cut into aligned pieces, of which each keeps its best span."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.lineage import cut_lineage
from mediaframe.functions.skew import spread_join

# (__n, __bin) of the aligned pieces of [__lo, __hi], from both ends inwards: at each width the first and the last whole piece left, if the next width does not take them.
# No sum leaves the range of a long
PIECES = """filter(flatten(transform(
    transform(sequence(0, least(63, coalesce(length(bin(try_subtract(__hi, __lo))), 63))), n -> struct(n,
      shiftright(__lo, n) + CASE WHEN shiftleft(shiftright(__lo, n), n) = __lo THEN 0L ELSE 1L END AS l,
      shiftright(__hi, n) - CASE WHEN shiftleft(shiftright(~__hi, n), n) = ~__hi THEN 0L ELSE 1L END AS h)),
    p -> array(CASE WHEN p.l <= p.h AND p.l & 1L = 1 THEN struct(p.n AS __n, p.l AS __bin) END,
      CASE WHEN p.l <= p.h AND p.h & 1L = 0 THEN struct(p.n AS __n, p.h AS __bin) END))), c -> c IS NOT NULL)"""


def first_span(values: DataFrame, spans: DataFrame, value: str, low: str, high: str, rank: str, keep: Sequence[str]) -> DataFrame:
    """value and the ``keep`` columns of the span [low, high] of the smallest rank that holds it, for the distinct values that lie in one.

    A span is cut into aligned pieces of 2^n integers, two a width at most, and each piece keeps the best span that covers it, however many do. A value meets the one
    piece that holds it at each width in use, 64 at most, so the work grows with spans and values, not with their overlaps. Of equal ranks the lower, then the
    shorter span wins. Spans that end before they begin hold nothing.
    """
    s = spans.select(F.col(low).cast("long").alias("__lo"), F.col(high).cast("long").alias("__hi"), F.col(rank).alias("__rank"), *keep)
    s = s.where("__lo <= __hi").withColumn("__cut", F.explode(F.expr(PIECES))).select("__cut.*", F.struct("__rank", "__lo", "__hi", *keep).alias("__s"))
    s = s.groupBy("__n", "__bin").agg(F.min("__s").alias("__s"))
    s = cut_lineage(s)  # read for its widths and for the join
    used = sorted(r["__n"] for r in s.select("__n").distinct().collect())  # widths: a few dozen at most
    v = values.select(F.col(value).cast("long").alias("__v")).where("__v is not null").distinct()
    if not used:
        return v.join(s, F.col("__v") == F.col("__bin")).select(F.col("__v").alias(value), *[F.col("__s")[c].alias(c) for c in keep])  # no span, no row
    at = F.array(*[F.struct(F.lit(n).alias("__n"), F.shiftright("__v", n).alias("__bin")) for n in used])
    met = v.select("__v", F.inline(at)).join(s, ["__n", "__bin"])
    best = met.groupBy("__v").agg(F.min("__s").alias("__s"))
    return best.select(F.col("__v").alias(value), *[F.col("__s")[c].alias(c) for c in keep])


def span_join(rows: DataFrame, spans: DataFrame, value: str, by: str, low: str = "low", high: str = "high", rank: str = "rank", keep: Sequence[str] = ("name",)) -> DataFrame:
    """rows with the ``keep`` columns of the first span that holds ``value``, NULL where none does. Each distinct value is looked up once; rows of a
    frequent value are dealt by the column ``by``."""
    keyed = rows.withColumn("__k", F.col(value).cast("long"))
    found = first_span(keyed, spans, "__k", low, high, rank, keep)
    return spread_join(keyed, found, "__k", by, "left").drop("__k")
