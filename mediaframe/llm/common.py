"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaframe.functions.lineage import work_dir

SPACE = b" \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df below spark.checkpoint.dir and read it back: computed once, and safe from lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of at most BATCH_ROWS rows in its session from here on.

    Spark sizes batches by rows alone and 10,000 long texts, held as Arrow and again as Python strings, are too many for a
    worker. The setting belongs to the session because Spark reads it when the plan runs; a smaller value is left alone.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def column(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def runs(texts, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """[start, end) slices of a batch holding at most ``limit`` characters each, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
