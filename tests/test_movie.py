"""Container bytes built by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from mediaframe.operators import container as C
from mediaframe.sources import movie as mv
from mediaframe.sources.files import write_files
from mediaframe.sources.ranged import movie_rows
from mediaframe.sources.text import scan_bytes

SPS, PPS = bytes.fromhex("6764001facd940"), bytes.fromhex("68ebe3cb")


def box(name, body, wide=False):
    if wide:
        return struct.pack(">I4sQ", 1, name, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, name) + body


def table(*nums, fmt="I"):
    return b"".join(struct.pack(">" + fmt, n) for n in nums)


def track(samples, offsets, runs, wide_offsets=False, const=0, video=True):
    avcc = b"\x01" + SPS[1:4] + b"\xff\xe1" + table(len(SPS), fmt="H") + SPS + b"\x01" + table(len(PPS), fmt="H") + PPS
    entry = box(b"avc1" if video else b"mp4a", b"\0" * 24 + table(640, 360, fmt="H") + b"\0" * 50 + box(b"avcC", avcc))
    stbl = box(b"stsd", table(0, 1) + entry)
    stbl += box(b"stsz", table(0, const, len(samples)) + (b"" if const else table(*samples)))
    stbl += box(b"stsc", table(0, len(runs)) + b"".join(table(a, b, 1) for a, b in runs))
    stbl += box(b"co64", table(0, len(offsets)) + table(*offsets, fmt="Q")) if wide_offsets else box(b"stco", table(0, len(offsets)) + table(*offsets))
    return box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", stbl))))


def unit(kind, n):
    return table(n) + bytes([kind]) + b"x" * (n - 1)


@pytest.fixture(scope="module")
def movie_bytes():
    s = [unit(7, 3) + unit(8, 2), unit(5, 9), unit(1, 4) + table(99) + b"zz", unit(1, 6)]
    sizes = [len(x) for x in s]
    head = box(b"ftyp", b"isom\0\0\2\0")
    start = len(head) + 16
    mdat = box(b"mdat", b"".join(s), wide=True)
    offsets = [start, start + sum(sizes[:3])]
    moov = box(b"moov", track(sizes, offsets, [(1, 3), (2, 1)], wide_offsets=True) + track([5, 5], [0], [(1, 2)], const=5, video=False))
    return head + mdat + moov


def test_boxes(spark, movie_bytes):
    df = spark.createDataFrame([("a", movie_bytes), ("cut", movie_bytes[:-3]), ("html", b"<!DOCTYPE html><html>")], "path string, content binary")
    got = mv.boxes(df)
    names = [r.type for r in got.where("path = 'a'").orderBy("box_id").collect()]
    assert names[:6] == ["ftyp", "mdat", "moov", "trak", "mdia", "minf"]
    assert names.count("trak") == 2 and names.count("stsz") == 2
    mdat = got.where("path = 'a' and type = 'mdat'").first()
    assert mdat.hdr == 16 and mdat.off == 16
    # the cut file loses the box that no longer fits, nothing before it
    assert [r.type for r in got.where("path = 'cut'").orderBy("box_id").collect()] == ["ftyp", "mdat"]
    assert got.where("path = 'html'").count() == 0


def test_size_zero_runs_to_the_end():
    body = b"y" * 20
    data = struct.pack(">I4s", 0, b"mdat") + body
    assert [(b[4], b[7]) for b in mv.flatten(data)] == [("mdat", 28)]
    inside = box(b"stbl", struct.pack(">I4s", 0, b"stsz") + body)
    assert [b[4] for b in mv.flatten(inside)] == ["stbl"]


def units_of(files, root):
    """Units by way of files read in ranges, which must equal the units of their payloads."""
    write_files(files, str(root))
    got = movie_rows(files.sparkSession, str(root), "units")
    again = mv.units(movie_rows(files.sparkSession, str(root), "payloads"))
    assert sorted(got.collect(), key=str) == sorted(again.collect(), key=str)
    return got


def plain_spans(t):
    """Offsets and sizes chunk by chunk."""
    left, out = list(t["sizes"]), []
    for no, at in enumerate(t["chunk_offsets"], 1):
        per = [s for f, s in zip(t["first_chunk"], t["samples_per_chunk"]) if f <= no][-1]
        for _ in range(min(per, len(left))):
            out.append((at, left[0]))
            at += left.pop(0)
    return out


def test_tracks_samples_units(spark, tmp_path, movie_bytes):
    df = spark.createDataFrame([("a", movie_bytes)], "path string, content binary")
    t = mv.tracks(df)
    v = t.where("track_id = 1").first()
    assert (v.width, v.height, v.nal_length_size, bytes(v.sps), bytes(v.pps)) == (640, 360, 4, SPS, PPS)
    assert t.where("track_id = 2").first().sps is None
    rel = C.track_samples(t.where("track_id = 1"))
    assert [(r.off, r.size) for r in rel.orderBy("sample_idx").collect()] == plain_spans(mv.parse_tracks(movie_bytes)[0])
    got = [(r.sample_idx, r.nal_idx, r.len, r.nal_type, r.bad_tail) for r in units_of(df, tmp_path).orderBy("sample_idx", "nal_idx").collect()]
    assert got == [(0, 0, 3, 7, False), (0, 1, 2, 8, False), (1, 0, 9, 5, False), (2, 0, 4, 1, False), (2, 1, 6, None, True), (3, 0, 6, 1, False)]
    counts = C.reject_reason(C.track_counts(t))
    assert {r.track_id: r.reason for r in counts.collect()} == {1: None, 2: "no_video"}


def test_decoder_config_round_trip(spark):
    df = spark.createDataFrame([(SPS, PPS, 4)], "sps binary, pps binary, n int")
    b = bytes(df.select(C.decoder_config(F.col("sps"), F.col("pps"), F.col("n")).alias("b")).first().b)
    t = {}
    mv._decoder_config(b, 0, len(b), t)
    assert (t["sps"], t["pps"], t["nal_length_size"]) == (SPS, PPS, 4)


def test_scan_bytes_prunes_content(spark, tmp_path, movie_bytes):
    (tmp_path / "m.mp4").write_bytes(movie_bytes)
    (tmp_path / "note.txt").write_text("no")
    f = scan_bytes(spark, str(tmp_path), "*.mp4")
    assert [(r.length) for r in f.select("length").collect()] == [len(movie_bytes)]
    assert units_of(f, tmp_path / "out").count() == 6


def test_samples_beyond_the_last_chunk_are_left_out(spark):
    sizes = spark.createDataFrame([(1, i, 10) for i in range(5)], "file_id long, sample_idx long, size long")
    chunks = spark.createDataFrame([(1, 1, 100, 2), (1, 2, 200, 1)], "file_id long, chunk_no long, chunk_off long, spc long")
    got = [(r.sample_idx, r.chunk_no, r.off) for r in C.expand_samples(sizes, chunks).orderBy("sample_idx").collect()]
    assert got == [(0, 1, 100), (1, 1, 110), (2, 2, 200)]


def test_files_reach_a_worker_in_small_batches(spark):
    """Batches end by bytes as well as by rows, so a worker's memory does not grow with the rows of its partition."""
    import pandas as pd

    files = spark.range(0, 600, 1, 1).selectExpr("cast(id AS string) AS path", "unhex(repeat('00', 30000)) AS content")

    def sizes(batches):
        for df in batches:
            yield pd.DataFrame({"n": [df["content"].map(len).sum()]})

    assert mv.boxes(files).count() == 600
    got = [r.n for r in files.mapInPandas(sizes, "n long").collect()]
    assert sum(got) == 600 * 30_000 and max(got) <= 8 << 20
