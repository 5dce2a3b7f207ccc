"""Fixed-width records: round trip, columns by offset, groups and files skipped by their keys."""

import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from mediaframe.sources import records as R

LAYOUT = [("frame", "<i4", 1), ("block", "<i4", 1), ("v", "<i2", 4), ("q", "<u1", 1), ("share", "<f8", 1), ("big", "<i8", 1)]


@pytest.fixture
def root(spark, tmp_path):
    df = spark.range(0, 600, 1, 6).select(
        (F.col("id") / 20).cast("int").alias("frame"), (F.col("id") % 20).cast("int").alias("block"),
        F.when(F.col("id") % 7 > 0, F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i * 100 - F.col("id")).cast("smallint"))).alias("v"),
        (F.col("id") % 256).cast("smallint").alias("q"), F.when(F.col("id") % 5 > 0, F.col("id") / 7).alias("share"), (F.col("id") * (1 << 40)).alias("big"), F.lit("x").alias("other"),
    )
    for half in (df.where("frame < 15"), df.where("frame >= 15")):  # two files at least
        R.write_records(half, str(tmp_path / "out"), LAYOUT, ["frame", "block"], group=10)
    return df, str(tmp_path / "out")


def rows(df):
    return sorted(map(str, df.collect()))


def test_round_trip(spark, root):
    df, path = root
    assert rows(R.read_records(spark, path)) == rows(df.drop("other"))
    assert rows(R.read_records(spark, path, ["big", "v"])) == rows(df.select("big", "v"))
    R.write_records(df.limit(0), path, LAYOUT, ["frame"], "overwrite")
    assert R.read_records(spark, path).count() == 0


def taken(reader):
    return sum(b.num_rows for p in reader.partitions() for b in reader.read(p))


def test_filters_skip_files_and_groups(root):
    _, path = root
    schema = T.StructType([T.StructField("frame", T.IntegerType())])
    read = lambda *filters: (r := R.PushingReader({"path": path}, schema), list(r.pushFilters(list(filters))))
    every, kept = read()
    assert taken(every) == 600 and kept == []
    r, kept = read(IsNotNull(("frame",)), EqualTo(("frame",), 7))
    assert len(kept) == 2 and 20 <= taken(r) <= 40 and len(r.partitions()) < len(every.partitions())
    assert taken(read(GreaterThan(("frame",), 27), LessThanOrEqual(("frame",), 28))[0]) <= 60
    assert 40 <= taken(read(In(("frame",), (3, 4)))[0]) <= 60
    assert taken(read(EqualTo(("frame",), 99))[0]) == 0
    assert taken(read(EqualTo(("other",), 99))[0]) == 600


def test_pushdown_in_spark_gives_the_same_rows(spark, root):
    df, path = root
    name = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(name, "true")
    try:
        for cond in ("frame = 7", "frame > 25 and block < 3", "frame in (1, 2) and q = 30", "share is null and frame <= 4"):
            assert rows(R.read_records(spark, path).where(cond)) == rows(df.drop("other").where(cond))
    finally:
        spark.conf.unset(name)
    near = R.read_records(spark, path, ["frame", "block"], between=[("frame", 7, 8)])
    assert rows(near.where("frame between 7 and 8")) == rows(df.where("frame between 7 and 8").select("frame", "block")) and near.count() < 80


def test_arrays_of_another_length_are_refused(spark, tmp_path):
    df = spark.createDataFrame([([1, 2, 3],)], "v array<int>")
    with pytest.raises(Exception, match="needs 4 values"):
        R.write_records(df, str(tmp_path / "x"), [("v", "<i4", 4)])
    left = [d for _, ds, _ in os.walk(tmp_path / "x") for d in ds if "-" in d]
    assert left == [] and json.dumps(R.LAYOUT)
