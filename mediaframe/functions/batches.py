"""Bounds on what a Python worker is handed at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> DataFrame:
    """df, with Arrow batches of at most ``rows`` rows and, as far as Spark knows that setting, ``size`` bytes in its session from here on.

    By default a batch is 10,000 rows however long they are, and a worker holds it as Arrow, as Python objects and as results. The settings
    belong to the session because Spark reads them when the plan runs; smaller values are left alone.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = conf.get(name, None)
        now = int(now.rstrip("Bb")) if now else -1
        if not 0 < now <= most:
            conf.set(name, str(most))
    return df
