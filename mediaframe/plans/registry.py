"""Query registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.plans.fixtures import with_clause

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def plain_types(df: DataFrame) -> DataFrame:
    """Widen integers to BIGINT and decimals/floats to DOUBLE so results compare across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint").alias(f.name)
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double").alias(f.name)
        out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None, uses: Sequence[str] = ()):
    """Register ``fn(spark, sf_dir)``; ``uses`` names the derived inputs the SQL text reads."""

    def wrap(fn: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_types(fn(spark, sf_dir))

        REGISTRY[name] = Query(name, build, None if sql is None else with_clause(uses, sql))
        return fn

    return wrap
