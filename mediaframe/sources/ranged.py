"""Movie files read by byte ranges: ``movie``.

    spark.read.format("movie").option("rows", "units").load(root)

A file is cut into ranges of ``rangeBytes`` bytes, whatever its size; small files share a partition. A task reads the sixteen bytes of each top-level box
header, the ``moov`` box, and of the media data only the samples that begin in its range, in reads of at most ``READ`` bytes. Neither content nor
sample tables pass a shuffle: each range places its file's samples from the tables itself, and keeps its own.

``rows`` is boxes, tracks, samples, payloads or units; the columns are those of ``movie.boxes``, ``movie.tracks``, ``container.track_samples``, ``container.payloads``
and ``movie.units``. root is a folder of files, or what ``files.write_files`` has written; path is the file's place below it.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from mediaframe.schemas import BOX, NAL, TRACK
from mediaframe.sources import files as fl
from mediaframe.sources.movie import CONTAINERS, flatten, parse_tracks, split_units

FORMAT = "movie"
RANGE = 64 << 20
#: what opening one more file counts as, when small ones are put together
OPEN = 256 << 10
READ = 8 << 20
GAP = 64 << 10
BATCH = 20_000
BATCH_BYTES = 16 << 20

_INT, _LONG = T.IntegerType(), T.LongType()
_SAMPLE = T.StructType().add("path", T.StringType()).add("track_id", _INT).add("sample_idx", _LONG)
SAMPLE = T.StructType([*_SAMPLE.fields]).add("chunk_no", _LONG).add("off", _LONG).add("size", _LONG)
PAYLOAD = T.StructType([*_SAMPLE.fields]).add("off", _LONG).add("nal_length_size", _INT).add("payload", T.BinaryType())
SCHEMAS = {"boxes": BOX, "tracks": TRACK, "samples": SAMPLE, "payloads": PAYLOAD, "units": NAL}

Read = Callable[[int, int], bytes]


def top_boxes(read: Read, length: int) -> Iterator[tuple[str, int, int, int]]:
    """(type, offset, header bytes, size) of the outermost boxes, from their headers alone."""
    pos = 0
    while pos + 8 <= length:
        head = read(pos, min(16, length - pos))
        size, name = struct.unpack_from(">I4s", head)
        used = 8
        if size == 1:
            if len(head) < 16:
                return
            size, used = struct.unpack_from(">Q", head, 8)[0], 16
        elif size == 0:
            size = length - pos
        if size < used or pos + size > length:
            return
        yield name.decode("latin-1"), pos, used, size
        pos += size


def outline(read: Read, length: int) -> tuple[list[tuple], list[dict]]:
    """Boxes, in order and with their numbers, and tracks of a file; of its outermost boxes only containers are read whole."""
    boxes: list[tuple] = []
    tracks: list[dict] = []
    seen = 0
    for name, off, head, size in top_boxes(read, length):
        if name not in CONTAINERS:
            boxes.append((len(boxes), None, 0, None, name, off, head, size))
            continue
        content, first = read(off, size), len(boxes)
        inner = flatten(content)
        for number, parent, depth, ptype, kind, at, h, n, _ in inner:
            boxes.append((first + number, None if parent is None else first + parent, depth, ptype, kind, off + at, h, n))
        for t in parse_tracks(content):
            tracks.append({**t, "track_id": t["track_id"] + seen})
        seen += sum(b[4] == "trak" for b in inner)
    return boxes, tracks


def placed(t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """sample_idx, chunk_no, off, size of a track's samples that fall into a chunk."""
    none = np.zeros(0, "int64")
    chunks, first, spc = (t.get(n) if t.get(n) is not None else none for n in ("chunk_offsets", "first_chunk", "samples_per_chunk"))
    sizes = t.get("sizes")
    count = len(sizes) if sizes is not None else int(t.get("sample_count") or 0)
    if not len(chunks) or not len(first) or not count:
        return none, none, none, none
    order = np.argsort(first, kind="stable")
    run = np.searchsorted(first[order], np.arange(1, len(chunks) + 1), side="right") - 1
    per_chunk = np.where(run < 0, spc[-1], spc[order][np.maximum(run, 0)])
    ends = np.minimum(np.cumsum(np.minimum(per_chunk, count)), count)
    starts = np.r_[0, ends[:-1]]
    chunk = np.repeat(np.arange(len(chunks)), ends - starts)
    size = sizes[: len(chunk)] if sizes is not None else np.full(len(chunk), t["const_size"], "int64")
    before = np.cumsum(size) - size
    off = chunks[chunk] + before - before[starts[chunk]]
    return np.arange(len(chunk)), chunk + 1, off, size


def sample_bytes(read: Read, offs: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) of each sample, in file order; neighbours are read together."""
    order = np.argsort(offs, kind="stable")
    i = 0
    while i < len(order):
        start = int(offs[order[i]])
        end, j = start + int(sizes[order[i]]), i + 1
        while j < len(order):
            a, n = int(offs[order[j]]), int(sizes[order[j]])
            if a > end + GAP or max(end, a + n) - start > READ:
                break
            end, j = max(end, a + n), j + 1
        held = read(start, end - start)
        for k in order[i:j].tolist():
            at = int(offs[k]) - start
            yield k, held[at : at + int(sizes[k])]
        i = j


@dataclass
class Ranges(InputPartition):
    """(name, place below root, length, start, stop) of pieces of files."""

    pieces: list


def cut(found: Iterator[tuple[str, str, int]], size: int, whole: bool) -> list[Ranges]:
    """Partitions of about ``size`` bytes; ``whole``: only headers are read, so a file is one piece of the weight of its opening."""
    out, held, weight = [], [], 0
    for name, at, length in found:
        for start in range(0, 1 if whole else max(length, 1), size):
            stop = length if whole else min(start + size, length)
            cost = OPEN + (0 if whole else stop - start)
            if held and weight + cost > size:
                out.append(Ranges(held))
                held, weight = [], 0
            # the last range takes what begins at the end of the file and later: nothing, unless tables lie
            held.append((name, at, length, start, stop))
            weight += cost
    return [*out, Ranges(held)] if held else out


class MovieReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.root, self.rows = options["path"], options.get("rows", "tracks")
        self.size = int(options.get("rangebytes", options.get("rangeBytes", RANGE)))
        self.schema = schema

    def found(self) -> Iterator[tuple[str, str, int]]:
        system, base = fl.opened(self.root)
        folders = fl.committed(self.root)
        if folders or any(i.base_name == fl.MANIFESTS for i in fl.listed(system, base)):
            for folder in folders:
                yield from map(tuple, fl.task_files(system, base, folder))
            return
        for info in sorted(fl.listed(system, base, recursive=True), key=lambda i: i.path):
            if info.is_file and not info.base_name.startswith(("_", ".")):
                yield info.path[len(base) + 1 :], info.path[len(base) + 1 :], info.size

    def partitions(self) -> list[InputPartition]:
        return cut(self.found(), self.size, self.rows in ("boxes", "tracks")) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        system, base = fl.opened(self.root)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        held, weight = [], 0
        for name, at, length, start, stop in partition.pieces:
            with system.open_input_file(f"{base}/{at}") as f:

                def read(pos: int, n: int, f=f) -> bytes:
                    f.seek(pos)
                    return f.read(n)

                for row in self.rows_of(name, read, length, start, stop):
                    held.append(row)
                    weight += len(row[-1]) if self.rows == "payloads" else 0
                    if len(held) >= BATCH or weight >= BATCH_BYTES:
                        yield batch(held)
                        held, weight = [], 0
        if held:
            yield batch(held)

    def rows_of(self, name: str, read: Read, length: int, start: int, stop: int) -> Iterator[tuple]:
        boxes, tracks = outline(read, length)
        if self.rows == "boxes":
            yield from ((name, *b) for b in boxes)
            return
        if self.rows == "tracks":
            columns = [c.name for c in TRACK.fields[1:]]
            yield from ((name, *(t.get(c) for c in columns)) for t in tracks)
            return
        for t in tracks:
            idx, chunk, off, size = placed(t)
            mine = (off >= start) & (off < stop)
            if self.rows == "samples":
                # a table may point behind the file; its last range lists those
                mine |= (off >= length) & (stop >= length)
                yield from ((name, t["track_id"], *row) for row in zip(idx[mine].tolist(), chunk[mine].tolist(), off[mine].tolist(), size[mine].tolist(), strict=True))
                continue
            if t.get("sps") is None:
                continue
            mine &= off + size <= length
            idx, off, size, prefix = idx[mine], off[mine], size[mine], t["nal_length_size"]
            for k, payload in sample_bytes(read, off, size):
                sample, at = int(idx[k]), int(off[k])
                if self.rows == "payloads":
                    yield name, t["track_id"], sample, at, prefix, payload
                else:
                    for i, place, n, kind, bad in split_units(payload, 0, len(payload), prefix):
                        yield name, t["track_id"], sample, i, at + place, n, kind, bad


class Movie(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return SCHEMAS[self.options.get("rows", "tracks")]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MovieReader(self.options, schema)


def movie_rows(spark: SparkSession, root: str, rows: str, range_bytes: int = RANGE) -> DataFrame:
    """Rows (boxes, tracks, samples, payloads or units) of all movie files below root."""
    spark.dataSource.register(Movie)
    return spark.read.format(FORMAT).option("rows", rows).option("rangeBytes", range_bytes).load(root)
