"""Logs that grow between triggers, and the log sink under repeated and failed micro-batches."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from mediaframe.functions.lineage import work_dir
from mediaframe.sources import logs as L
from mediaframe.streaming import run as R


def grown(spark, root, base, size=L.RANGE):
    R.append_log(L.growing_log(spark, str(root), size), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out")


def test_a_growing_log_is_read_once(spark, tmp_path):
    root, base = tmp_path / "logs", str(tmp_path / "run")
    root.mkdir()
    steps = [("a", b"one\ntwo\nhal"), ("b", b"x"), ("a", b"f\n\nlast\n"), ("b", b"y\n" * 3), ("c", b"\xff\xfe\n"), ("a", b"no end")]
    for i, (name, more) in enumerate(steps):
        with open(root / name, "ab") as f:
            f.write(more)
        if i != 2:
            got = grown(spark, root, base, 4)
    rows = sorted((r.path, r.off, r.line) for r in got.collect())
    assert rows == [("a", 0, "one"), ("a", 4, "two"), ("a", 8, "half"), ("a", 13, ""), ("a", 14, "last"), ("b", 0, "xy"), ("b", 3, "y"), ("b", 5, "y"), ("c", 0, "��")]
    (root / "b").write_bytes(b"new\n")  # shorter: another file under the old name
    assert sorted(r.line for r in grown(spark, root, base, 4).where("path = 'b'").collect()) == ["new", "xy", "y", "y"]


@pytest.mark.parametrize("seed", range(4))
def test_ranges_share_out_every_line(tmp_path, seed):
    rng = random.Random(seed)
    text = "".join(rng.choices(["\n", "a", "bcd", "é", "\n\n", "long " * 20], k=300)).encode() + b"\n"
    path = tmp_path / "f"
    path.write_bytes(text)
    want, at = [], 0
    for line in text.split(b"\n")[:-1]:
        want.append((at, line.decode()))
        at += len(line) + 1
    for size in (1, 2, 7, 50, 10_000):
        reader = L.GrowingLogReader({"path": str(tmp_path), "rangeBytes": size})
        assert reader.latestOffset() == {"f": len(text)}
        got = [row[1:] for p in reader.partitions({}, {"f": len(text)}) for row in reader.read(p)]
        assert got == want, size


def test_small_reads_give_the_same_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(L, "READ", 3)
    monkeypatch.setattr(L, "TAIL", 2)
    test_ranges_share_out_every_line(tmp_path, 9)


def parts(spark, n, rows=20):
    path = work_dir(spark, "lines")
    for i in range(n):
        spark.range(i * rows, (i + 1) * rows, 1, 2).select(F.concat(F.lit("line "), "id").alias("line")).write.mode("append").parquet(f"{path}/{i}")
    return path


def stream(spark, path, **changed):
    s = R.file_stream(spark, path + "/*", spark.createDataFrame([], "line string").schema, "*.parquet", files_per_batch=2)
    return s.select(changed["line"].alias("line")) if changed else s


def lines(spark, root):
    return sorted(r.line for r in L.read_epochs(spark, root).collect())


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """The query died after the sink's commit and before Spark noted it: the batch runs again, here with other rows."""
    root, checkpoint, path = str(tmp_path / "log"), str(tmp_path / "cp"), parts(spark, 3)
    L.write_epochs(stream(spark, path), root, checkpoint).awaitTermination()
    want = sorted(f"line {i}" for i in range(60))
    assert lines(spark, root) == want
    last = max(int(n) for n in os.listdir(f"{checkpoint}/commits") if n.isdigit())
    os.remove(f"{checkpoint}/commits/{last}")
    if os.path.exists(f"{checkpoint}/commits/.{last}.crc"):
        os.remove(f"{checkpoint}/commits/.{last}.crc")
    L.write_epochs(stream(spark, path, line=F.concat(F.lit("again "), "line")), root, checkpoint).awaitTermination()
    assert lines(spark, root) == want
    folders = [d for _, ds, _ in os.walk(f"{root}/{L.DATA}") for d in ds if "-" in d]
    assert len(folders) == len([p for p in L.EpochReader(root).partitions()])


def test_a_failed_batch_is_not_seen_and_comes_again(spark, tmp_path):
    root, checkpoint, path = str(tmp_path / "log"), str(tmp_path / "cp"), parts(spark, 1)
    bad = F.when(F.col("line") == "line 17", F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("line"))
    with pytest.raises(Exception, match="killed"):
        L.write_epochs(stream(spark, path, line=bad), root, checkpoint).awaitTermination()
    assert lines(spark, root) == []
    shutil.copytree(f"{path}/0", f"{path}/more")
    L.write_epochs(stream(spark, path), root, checkpoint).awaitTermination()
    assert lines(spark, root) == sorted([f"line {i}" for i in range(20)] * 2)


def test_nothing_written(spark, tmp_path):
    assert L.read_epochs(spark, str(tmp_path / "none")).count() == 0
