"""Files as rows with commit, and movies read by byte ranges."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import WriterCommitMessage

from mediaframe.operators import container as C
from mediaframe.sources import files as fl
from mediaframe.sources import movie as mv
from mediaframe.sources import ranged as rg
from tests.test_movie import box, track


def unit(*payloads):
    return b"".join(struct.pack(">I", len(p)) + p for p in payloads)


def big_file(path, gap):
    """A file of over 2 GB, most of it a hole: samples before and behind the hole, tables at the end."""
    early, late = [unit(b"\x67abc"), unit(b"\x65" + b"x" * 40)], [unit(b"\x61yy", b"\x01z"), unit(b"\x41")]
    with open(path, "wb") as f:
        f.write(box(b"ftyp", b"isom"))
        start = f.tell()
        f.write(struct.pack(">I4sQ", 1, b"mdat", 16 + len(b"".join(early)) + gap + len(b"".join(late))))
        first = f.tell()
        f.write(b"".join(early))
        f.seek(gap, 1)
        second = f.tell()
        f.write(b"".join(late))
        f.write(box(b"moov", track([len(s) for s in early + late], [first, second], [(1, 2)], wide_offsets=True)))
    return start, first, second


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    start, first, second = big_file(root / "big.mp4", 3 << 30)
    (root / "_skipped").write_bytes(b"x")
    boxes = rg.movie_rows(spark, str(root), "boxes").orderBy("box_id").collect()
    assert [b.type for b in boxes[:3]] == ["ftyp", "mdat", "moov"] and boxes[1].off == start and boxes[1].size > 3 << 30 and boxes[1].hdr == 16
    units = rg.movie_rows(spark, str(root), "units").orderBy("sample_idx", "nal_idx").collect()
    assert [(u.sample_idx, u.len, u.nal_type, u.bad_tail) for u in units] == [(0, 4, 7, False), (1, 41, 5, False), (2, 3, 1, False), (2, 2, 1, False), (3, 1, 1, False)]
    assert units[0].off == first + 4 and units[2].off == second + 4
    assert {u.path for u in units} == {"big.mp4"}


def test_any_range_gives_the_same_rows(spark, tmp_path, monkeypatch):
    root = tmp_path / "in"
    root.mkdir()
    for i in range(4):
        big_file(root / f"{i}.mp4", 1000 * i)
    (root / "page.html").write_bytes(b"<html></html>")
    (root / "none").write_bytes(b"")
    (root / "tail").write_bytes(box(b"moov", track([4, 9, 5], [10, 5000], [(1, 2)])))  # tables that point behind the file
    monkeypatch.setattr(rg, "OPEN", 1)
    for rows in rg.SCHEMAS:
        want = sorted(map(str, rg.movie_rows(spark, str(root), rows).collect()))
        for size in (100, 777, 1 << 20):
            df = rg.movie_rows(spark, str(root), rows, size)
            assert sorted(map(str, df.collect())) == want, (rows, size)
    assert rg.movie_rows(spark, str(root), "units", 100).rdd.getNumPartitions() > 8


def test_ranged_rows_equal_the_relational_ones(spark, tmp_path):
    """Boxes, tracks and placed samples of the byte ranges against whole contents and blocked scans."""
    data = {
        "a": box(b"ftyp", b"isom") + box(b"free", b"") + box(b"mdat", bytes(range(200))) + box(b"moov", track([5, 6, 7, 8, 9], [40, 80, 120], [(1, 1), (3, 3)]) + track([3, 3, 3], [60], [(1, 9)], video=False)),
        "late run": box(b"mdat", b"z" * 300) + box(b"moov", track([10] * 6, [20, 90, 150], [(2, 1), (3, 2)])),
        "fixed": box(b"mdat", b"q" * 300) + box(b"moov", track([0] * 4, [20, 90], [(1, 2)], const=16)) + box(b"moov", track([2], [11], [(1, 1)])),
        "cut": box(b"ftyp", b"isom") + struct.pack(">I4s", 900, b"moov") + b"abc",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "path string, content binary")
    fl.write_files(df, str(tmp_path / "in"))
    rows = lambda kind: rg.movie_rows(spark, str(tmp_path / "in"), kind)
    by = lambda d: sorted(map(str, d.collect()))
    assert by(rows("boxes")) == by(mv.boxes(df))
    assert by(rows("tracks")) == by(mv.tracks(df))
    want = C.track_samples(mv.tracks(df).where("sample_count > 0"))
    assert by(rows("samples")) == by(want.select(rows("samples").columns))
    assert rows("samples").count() == 5 + 3 + 5 + 4 + 1  # the late run table leaves room for five of six


def test_no_content_in_a_shuffle(spark, tmp_path):
    big_file(tmp_path / "a.mp4", 10)
    plan = rg.movie_rows(spark, str(tmp_path), "units").groupBy("nal_type").count()._jdf.queryExecution().toString()
    assert "payload" not in plan and "content" not in plan


def test_files_round_trip_and_overwrite(spark, tmp_path):
    root = str(tmp_path / "out")
    one = [("a/b", b"1"), ("a/b", b"1"), ("", b""), ("né", b"\x00\xff" * 1000)]
    fl.write_files(spark.createDataFrame([(n, bytearray(c)) for n, c in one], fl.ROWS).repartition(3), root)
    got = lambda: sorted((r.path, bytes(r.content)) for r in fl.read_files(spark, root).collect())
    assert got() == sorted(one)
    fl.write_files(spark.createDataFrame([("c", bytearray(b"2"))], fl.ROWS), root)
    assert got() == sorted([*one, ("c", b"2")])
    fl.write_files(spark.createDataFrame([("d", bytearray(b"3"))], fl.ROWS), root, "overwrite")
    assert got() == [("d", b"3")]
    fl.write_files(spark.createDataFrame([], fl.ROWS), root, "overwrite")
    assert got() == [] and fl.read_files(spark, str(tmp_path / "nothing")).count() == 0


def folders(root):
    return sorted(os.path.relpath(os.path.join(d, x), root) for d, ds, _ in os.walk(root) for x in ds)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "out")
    fl.write_files(spark.createDataFrame([("a", bytearray(b"1"))], fl.ROWS), root)
    before = folders(root)
    bad = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") < 35, F.lit(b"x")).otherwise(F.raise_error(F.lit("no"))).cast("binary").alias("content"))
    with pytest.raises(Exception, match="no"):
        fl.write_files(bad, root)
    assert [f for f in folders(root) if f.count("/") == 2] == [f for f in before if f.count("/") == 2]
    assert [r.path for r in fl.read_files(spark, root).collect()] == ["a"]


def test_a_retried_attempt_is_not_seen(tmp_path):
    """Two attempts of one task wrote; the driver heard of one."""
    root = str(tmp_path)
    w = fl.FileWriter(root, False)
    for attempt, content in ((0, b"old"), (1, b"new")):
        folder = tmp_path / fl.DATA / w.job / f"0-{attempt}"
        folder.mkdir(parents=True)
        (folder / "00000000").write_bytes(content)
        (folder / fl.LIST).write_text(json.dumps([["a", "00000000", 3]]))
    assert fl.committed(root) == []
    w.commit([fl.Written(f"{fl.DATA}/{w.job}/0-1"), None])
    assert fl.committed(root) == [f"{fl.DATA}/{w.job}/0-1"]
    assert not (tmp_path / fl.DATA / w.job / "0-0").exists()
    reader = fl.FileReader(root)
    assert [row for p in reader.partitions() for row in reader.read(p)] == [("a", b"new")]
    assert isinstance(fl.Written("x"), WriterCommitMessage)


def test_partitions_are_bounded():
    many = [(str(i), str(i), 1000) for i in range(10_000)]
    parts = rg.cut(iter(many), rg.RANGE, False)
    assert sum(len(p.pieces) for p in parts) == 10_000 and 30 < len(parts) < 60
    huge = rg.cut(iter([("h", "h", 10 << 30)]), rg.RANGE, False)
    assert len(huge) == 160 and all(len(p.pieces) == 1 for p in huge)
    assert len(rg.cut(iter([("h", "h", 10 << 30)]), rg.RANGE, True)) == 1


