"""Media file bytes to box, track, sample and unit rows.

Bytes have to be walked in order, so each file is parsed inside one Arrow batch; files run in
parallel and the content never leaves the task that read it. A file is at most 2 GB, which is what a
binary row can hold.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mediaframe.functions.batches import small_batches
from mediaframe.schemas import BOX, NAL, TRACK

CONTAINERS = ("moov", "trak", "mdia", "minf", "stbl")
MAX_DEPTH = 64


def iter_boxes(buf: bytes, pos: int, end: int, in_table: bool = False) -> Iterator[tuple[str, int, int, int]]:
    """(type, offset, header bytes, size) of the boxes in [pos, end); stops at the first one that does not fit."""
    while pos + 8 <= end:
        size, name = struct.unpack_from(">I4s", buf, pos)
        head = 8
        if size == 1:
            if pos + 16 > end:
                return
            size = struct.unpack_from(">Q", buf, pos + 8)[0]
            head = 16
        elif size == 0:
            if in_table:
                return
            size = end - pos
        if size < head or pos + size > end:
            return
        yield name.decode("latin-1"), pos, head, size
        pos += size


def flatten(buf: bytes) -> list[tuple]:
    """Pre-order list (box_id, parent_id, depth, parent_type, type, off, hdr, size, track_id)."""
    out: list[tuple] = []
    tracks = 0

    def descend(pos: int, end: int, parent: int | None, depth: int, ptype: str | None, track: int) -> None:
        nonlocal tracks
        for name, off, head, size in iter_boxes(buf, pos, end, ptype == "stbl"):
            if name == "trak":
                tracks += 1
                track_here = tracks
            else:
                track_here = track
            me = len(out)
            out.append((me, parent, depth, ptype, name, off, head, size, track_here))
            if name in CONTAINERS and depth < MAX_DEPTH:  # deeper nesting is no media file
                descend(off + head, off + size, me, depth + 1, name, track_here)

    descend(0, len(buf), None, 0, None, 0)
    return out


def _numbers(buf: bytes, at: int, end: int, count: int, kind: str) -> np.ndarray:
    """Big-endian table entries; never past the end of the box."""
    width = np.dtype(kind).itemsize
    fits = max(0, (end - at) // width)
    return np.frombuffer(buf, dtype=kind, count=min(count, fits), offset=at).astype("int64") if fits and count else np.zeros(0, "int64")


def _first_blob(buf: bytes, at: int, end: int, count: int) -> tuple[bytes | None, int]:
    """First length-16 blob of a list and the position after the list."""
    first = None
    for i in range(count):
        if at + 2 > end:
            break
        n = struct.unpack_from(">H", buf, at)[0]
        at += 2
        if at + n > end:
            break
        if i == 0:
            first = buf[at : at + n]
        at += n
    return first, at


def _decoder_config(buf: bytes, at: int, end: int, track: dict) -> None:
    if end - at < 7:
        return
    track["nal_length_size"] = (buf[at + 4] & 3) + 1
    track["sps"], at = _first_blob(buf, at + 6, end, buf[at + 5] & 31)
    if at < end:
        track["pps"], _ = _first_blob(buf, at + 1, end, buf[at])


def _sample_entry(buf: bytes, at: int, end: int, track: dict) -> None:
    """First entry of the description table; only one video coding is known."""
    if at + 8 > end:
        return
    size, name = struct.unpack_from(">I4s", buf, at)
    if name != b"avc1" or at + size > end:
        return
    stop = at + size
    if at + 40 <= stop:
        track["width"], track["height"] = struct.unpack_from(">HH", buf, at + 32)
    for inner, off, head, length in iter_boxes(buf, at + 86, stop, True):
        if inner == "avcC":
            _decoder_config(buf, off + head, off + length, track)
            track["video"] = True


def parse_tracks(buf: bytes) -> list[dict]:
    """One dict per track; a later table of the same kind replaces an earlier one."""
    tracks: dict[int, dict] = {}
    for _, _, _, ptype, name, off, head, size, tid in flatten(buf):
        if ptype != "stbl":
            continue
        t = tracks.setdefault(tid, {"track_id": tid})
        at, end = off + head, off + size
        if name == "stsd":
            _sample_entry(buf, at + 8, end, t)
        elif name == "stsz" and at + 12 <= end:
            const, count = struct.unpack_from(">II", buf, at + 4)
            t["const_size"], t["sample_count"] = const, count
            t["sizes"] = None if const else _numbers(buf, at + 12, end, count, ">u4")
        elif name in ("stco", "co64") and at + 8 <= end:
            t["chunk_offsets"] = _numbers(buf, at + 8, end, struct.unpack_from(">I", buf, at + 4)[0], ">u4" if name == "stco" else ">u8")
        elif name == "stsc" and at + 8 <= end:
            rows = _numbers(buf, at + 8, end, 3 * struct.unpack_from(">I", buf, at + 4)[0], ">u4")
            rows = rows[: len(rows) // 3 * 3].reshape(-1, 3)
            t["first_chunk"], t["samples_per_chunk"] = rows[:, 0], rows[:, 1]
    return [t for t in tracks.values()]


def split_units(buf: bytes, off: int, size: int, prefix: int) -> list[tuple]:
    """(index, payload offset, length, type, bad_tail) of the length-prefixed units of one sample."""
    out, at, end = [], off, off + size
    while end - at > prefix:
        n = int.from_bytes(buf[at : at + prefix], "big")
        if n == 0 or n > end - at - prefix:
            break
        out.append((len(out), at + prefix, n, buf[at + prefix] & 31, False))
        at += prefix + n
    if at < end:
        out.append((len(out), at, end - at, None, True))
    return out


def _rows(schema: T.StructType, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.name for f in schema.fields], dtype=object)


def _parsed(files: DataFrame, schema: T.StructType, parse) -> DataFrame:
    """Rows that ``parse(content)`` finds in every file, one frame per batch of files."""

    def run(batches):
        for pdf in batches:
            yield _rows(schema, [(path, *row) for path, content in zip(pdf["path"], pdf["content"]) for row in parse(content)])

    return small_batches(files.select("path", "content")).mapInPandas(run, schema)


def boxes(files: DataFrame) -> DataFrame:
    """Box rows of every file (path, content)."""
    return _parsed(files, BOX, lambda content: [b[:-1] for b in flatten(content)])


def tracks(files: DataFrame) -> DataFrame:
    """Track rows of every file; list columns hold the sample tables."""
    names = [f.name for f in TRACK.fields[1:]]
    return _parsed(files, TRACK, lambda content: [[t.get(n) for n in names] for t in parse_tracks(content)])


def units(payloads: DataFrame) -> DataFrame:
    """Length-prefixed units of every payload (path, track_id, sample_idx, off, nal_length_size, payload), at file offsets."""
    cols = ["path", "track_id", "sample_idx", "off", "nal_length_size", "payload"]

    def run(batches):
        for pdf in batches:
            rows = []
            for path, track, i, off, prefix, payload in zip(*(pdf[c] for c in cols)):
                rows += [(path, track, i, k, off + at, n, kind, bad) for k, at, n, kind, bad in split_units(payload, 0, len(payload), prefix)]
            yield _rows(NAL, rows)

    return small_batches(payloads.select(*cols)).mapInPandas(run, NAL)
