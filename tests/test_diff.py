"""Version diff on small tables with known faults, and the plans it should get."""

import pytest
from pyspark.sql import functions as F

from mediaframe.functions.lineage import cut_lineage, work_dir
from mediaframe.operators import diff as D
from mediaframe.sources import sinks as K
from tests import synthetic as G


@pytest.fixture(scope="module")
def versions(spark):
    ref = G.plane(spark, 2, 32, 32).withColumn("plane", F.lit(1)).select("frame", "plane", "y", "x", F.least(F.col("v"), F.lit(200)).alias("v")).cache()
    # frame 0: block (1,1) is wrong first, (1,2) and (2,1) only follow it
    def off(y0, x0, add):
        inside = F.col("y").between(y0 * 8, y0 * 8 + 7) & F.col("x").between(x0 * 8, x0 * 8 + 7)
        return F.when(inside & (F.col("frame") == 0), add).otherwise(0)

    live = ref.withColumn("v", F.col("v") + off(1, 1, 4) + off(1, 2, 9) + off(2, 1, 5))
    return live, ref


def test_origin_is_not_the_worst(spark, versions):
    d = D.align(*versions)
    tracked = d.select("frame", (F.col("y") / 8).cast("bigint").alias("brow"), (F.col("x") / 8).cast("bigint").alias("bcol")).distinct()
    tracked = tracked.withColumn("track_no", F.col("brow") * 4 + F.col("bcol")).withColumn("class", F.lit("skip"))
    o = D.origin_block(d, tracked).collect()
    assert [(r.frame, r.brow, r.bcol, r.err) for r in o] == [(0, 1, 1, 256)]
    w = D.worst_block_per_class(d, tracked, size=8).first()
    assert (w.brow, w.bcol, w.err) == (1, 2, 576)
    assert D.first_bad_block(d, tracked).first().track_no == 5


def test_worst_pixel_takes_the_first_of_equals(versions):
    r = {x.frame: x for x in D.worst_pixel(D.align(*versions)).collect()}
    assert (r[0].max_d, r[0].plane, r[0].y, r[0].x) == (9, 1, 8, 16)
    assert (r[1].max_d, r[1].y, r[1].x) == (0, 0, 0)


def test_packed_rows_give_the_same_diff(versions):
    live, ref = versions
    a, b = D.align(live, ref), D.align_packed(D.pack_rows(live), D.pack_rows(ref))
    cols = ["frame", "plane", "y", "x", "v_live", "v_ref", "d"]
    a, b = a.select(*[F.col(c).cast("int") for c in cols]), b.select(*[F.col(c).cast("int") for c in cols])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_missing_frame_is_reported(versions):
    live, ref = versions
    short = live.where("frame = 0")
    c = D.frame_counts(short, ref).first()
    assert (c.n_live, c.n_ref, c.compared, c.warn) == (1, 2, 1, True)
    assert D.missing_keys(short, ref).groupBy("missing_in").count().collect()[0][:] == ("live", 1024)


def test_bucketed_versions_join_without_a_shuffle(spark, versions):
    for v, name in zip(versions, ("px_live", "px_ref")):
        K.write_bucketed_pixels(v, name, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = D.align(spark.table("px_live"), spark.table("px_ref"))
        assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
        assert d.count() == 2048
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_report_needs_evidence(spark, versions):
    report = D.frame_report(D.align(versions[1], versions[1]))
    none = spark.createDataFrame([(False,)], "taken boolean")
    some = spark.createDataFrame([(True,)], "taken boolean")
    assert not D.with_evidence(report, none).first().ok
    assert D.with_evidence(report, some).first().ok


def test_tables_keep_their_declared_schema(spark):
    from mediaframe.schemas import MB_INFO

    path = work_dir(spark, "old")
    K.write_table(spark.createDataFrame([(1, 2, 3, 4)], "file_id bigint, decode_no bigint, mb_x int, mb_y int"), path, MB_INFO)
    got = K.read_table(spark, path, MB_INFO)
    assert got.schema.names == MB_INFO.names and got.first().qscale is None
    assert cut_lineage(got).count() == 1


def test_text_report_is_in_order(spark, versions, tmp_path):
    lines = K.frame_report_text(D.frame_report(D.align(*versions)))
    K.write_text_report(lines, str(tmp_path / "r"), ["frame"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert [t.split(":")[0].strip() for t in text.splitlines()] == ["frame  0", "frame  1"]


def test_cluster_session_must_name_a_shared_folder():
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, name, default):
            assert name == "spark.checkpoint.dir"
            return self.value

    class Session:
        class sparkContext:  # noqa: N801
            master = "yarn"

        def __init__(self, value):
            self.conf = Conf(value)

    assert work_dir(Session("hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    with pytest.raises(ValueError):
        work_dir(Session(None), "x")
