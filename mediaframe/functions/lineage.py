"""Shared working folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_roots: dict[str, str] = {}


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a local one only for a local session without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        root = _local_roots.setdefault(app, "") or tempfile.mkdtemp(prefix="spark-")
        _local_roots[app] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    Used where several branches read the same costly intermediate: it is computed once, and a lost executor only
    costs re-reading files.
    """
    spark = df.sparkSession
    path = work_dir(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
