"""Joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def spread_join(left: DataFrame, right: DataFrame, keys: str | Sequence[str], by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join of many rows to one row per key where a key may hold a third of all rows: the left rows of a key are dealt to ``salts``
    parts by the column ``by``, and the right row is copied to each."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
