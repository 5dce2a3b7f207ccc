"""User functions: handle-or-decline callbacks, observers, table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mediaframe.functions.batches import small_batches
from mediaframe.sources.movie import split_units


def with_fallback(df: DataFrame, out: str, user: Callable[..., Column], args: list[str], default: Column, enabled: bool = True) -> DataFrame:
    """Value of a user function, or the default where it declines (NULL); ``handled`` tells which.

    With enabled = False the plan does not contain the user function at all.
    """
    if not enabled:
        return df.withColumn(out, default).withColumn("handled", F.lit(False))
    tried = df.withColumn("__u", user(*[F.col(a) for a in args]))
    return tried.withColumn(out, F.coalesce("__u", default)).withColumn("handled", F.col("__u").isNotNull()).drop("__u")


def handled_counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count_if("handled").alias("taken"), F.count_if(~F.col("handled")).alias("declined"))


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """Same rows, with metrics collected while they pass."""
    o = Observation(name)
    return df.observe(o, *metrics), o


class SplitUnits:
    """Table function: length-prefixed units of one payload."""

    def eval(self, payload: bytes, prefix: int) -> Iterator[tuple]:
        if payload:
            for i, off, n, kind, bad in split_units(bytes(payload), 0, len(payload), prefix):
                yield i, off, n, kind, bad


class Packets:
    """Table function: packet headers of one submission buffer given as an array of words."""

    def eval(self, words: list[int]) -> Iterator[tuple]:
        n = len(words or [])
        at = 0
        while at < n:
            w = words[at]
            kind = w >> 30
            data = 0 if w == 0 or kind == 2 else 2 if kind == 1 else (w >> 16 & 0x3FFF) + 1
            yield at, w, kind, data, at + 1 + data <= n
            at += 1 + data


UNIT = [("nal_idx", pa.int32()), ("off", pa.int64()), ("len", pa.int64()), ("nal_type", pa.int32()), ("bad_tail", pa.bool_())]


def unit_lists(payloads: pa.Array, prefixes: pa.Array) -> pa.Array:
    """``split_units`` of every payload of an Arrow batch, as one list a payload. Only the lengths are walked in a loop."""
    ends, at_, len_, kind_, bad_ = [0], [], [], [], []
    for buf, prefix in zip(payloads.to_pylist(), prefixes.to_pylist()):
        at, end = 0, len(buf or b"")
        while end - at > prefix:
            start = at + prefix
            n = int.from_bytes(buf[at:start], "big")
            if n == 0 or n > end - start:
                break
            at_.append(start)
            len_.append(n)
            kind_.append(buf[start] & 31)
            at = start + n
        bad_.append(at < end)
        if at < end:
            at_.append(at)
            len_.append(end - at)
            kind_.append(None)
        ends.append(len(at_))
    stops = np.array(ends, "int64")
    counts = np.diff(stops)
    bad = np.zeros(len(at_), bool)
    bad[stops[1:][np.array(bad_, bool)] - 1] = True
    columns = [np.arange(len(at_)) - np.repeat(stops[:-1], counts), at_, len_, kind_, bad]
    rows = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, UNIT)], fields=[pa.field(n, t) for n, t in UNIT])
    return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), rows)


def units_of(payloads: DataFrame, payload: str, prefix: int, keep: list[str]) -> DataFrame:
    """The rows of ``split_units(payload, prefix)`` beside the columns ``keep``, an Arrow batch of payloads at a time."""
    lists = F.arrow_udf(unit_lists, "array<struct<nal_idx:int,off:bigint,len:bigint,nal_type:int,bad_tail:boolean>>")
    return small_batches(payloads).select(*keep, F.inline(lists(F.col(payload), F.lit(prefix))))


def register_table_functions(spark: SparkSession) -> None:
    """split_units(payload, prefix) and packets(words) for SQL, one row of input at a time."""
    units = F.udtf(SplitUnits, returnType="nal_idx int, off bigint, len bigint, nal_type int, bad_tail boolean")
    heads = F.udtf(Packets, returnType="dw bigint, w bigint, kind int, cnt int, complete boolean")
    spark.udtf.register("split_units", units)
    spark.udtf.register("packets", heads)
