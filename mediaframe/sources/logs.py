"""Logs that grow, as a stream, and a log sink that commits by epoch.

``growing_log`` follows the text files below a folder. Its offset is the byte position reached in each file, always behind a line's end, so a line is read
once it is whole and only once, however often the file has grown between triggers; a file that has become shorter is taken for a new one. Stretches are cut
into byte ranges of ``rangeBytes``; a line belongs to the range in which it begins.

    spark.readStream.format("growing_log").load(root)           -> path, off, line

``epoch_log`` writes lines. Tasks write to folders of their own attempt; the commit of a micro-batch puts their names under its batch number, which must not exist
yet: a batch that is run again after a crash, with whatever rows, changes nothing, and what was never committed is never read.

    df.select("line").writeStream.format("epoch_log").option("checkpointLocation", ...).start(root)
    spark.read.format("epoch_log").load(root)                   -> batch, line
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from mediaframe.sources.files import DATA, MANIFESTS, Written, listed, opened, read_json, write_json

RANGE = 32 << 20
TAIL = 64 << 10
READ = 1 << 20
LINES = "lines"


@dataclass
class Stretch(InputPartition):
    """Lines that begin at start or behind it and before stop; the file is read no further than end."""

    name: str
    start: int
    stop: int
    first: bool
    end: int


def last_line_end(f, size: int, at_least: int) -> int:
    """Position behind the last line break in [at_least, size), or at_least."""
    stop = size
    while stop > at_least:
        start = max(at_least, stop - TAIL)
        f.seek(start)
        found = f.read(stop - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        stop = start
    return at_least


def lines_of(f, s: Stretch) -> Iterator[tuple[int, str]]:
    """(position, text without its line break) of a stretch's lines, read in pieces of READ bytes."""
    at = s.start if s.first else s.start - 1
    f.seek(at)
    held, done = b"", at
    skip = not s.first  # up to and with the break of a line that began earlier; it may stand right before the stretch
    while done < s.stop or held:
        piece = f.read(min(READ, s.end - done - len(held)))
        held += piece
        parts = held.split(b"\n")
        for line in parts[:-1]:
            if skip:
                skip = False
            elif done >= s.stop:
                return
            else:
                yield done, line.decode("utf-8", "replace")
            done += len(line) + 1
        held = parts[-1]
        if not piece or (done >= s.stop and not skip):
            return


class GrowingLogReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.size = options["path"], int(options.get("rangeBytes", RANGE))
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, base = opened(self.root)
        out = {}
        for info in listed(system, base, recursive=True):
            if not info.is_file or info.base_name.startswith(("_", ".")):
                continue
            name, size = info.path[len(base) + 1 :], info.size
            seen, end = self.known.get(name, [0, 0])
            if size != seen:  # only what has changed is opened
                with system.open_input_file(info.path) as f:
                    end = last_line_end(f, size, end if size > seen else 0)
                self.known[name] = [size, end]
            out[name] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, stop in sorted(end.items()):
            a = start.get(name, 0)
            a = 0 if a > stop else a
            for at in range(a, stop, self.size):
                out.append(Stretch(name, at, min(at + self.size, stop), at == a, stop))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        system, base = opened(self.root)
        with system.open_input_file(f"{base}/{partition.name}") as f:
            for at, line in lines_of(f, partition):
                yield partition.name, at, line


class GrowingLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return "path string, off long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingLogReader(self.options)


class EpochWriter(DataSourceStreamWriter):
    def __init__(self, root: str):
        self.root, self.run = root, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, base = opened(self.root)
        task = TaskContext.get()
        folder = f"{DATA}/{self.run}/{uuid.uuid4().hex}-{task.partitionId()}"
        system.create_dir(f"{base}/{folder}", recursive=True)
        try:
            with system.open_output_stream(f"{base}/{folder}/{LINES}") as f:
                for row in iterator:
                    f.write(("" if row["line"] is None else row["line"]).encode() + b"\n")
        except BaseException:
            system.delete_dir(f"{base}/{folder}")
            raise
        return Written(folder)

    def commit(self, messages: list, batchId: int) -> None:
        system, base = opened(self.root)
        mine = [m.folder for m in messages if m is not None]
        at = f"{base}/{MANIFESTS}/{batchId:012d}.json"
        system.create_dir(f"{base}/{MANIFESTS}", recursive=True)
        if system.get_file_info(at).type == pafs.FileType.NotFound:
            write_json(system, at, mine)
        else:
            kept = set(read_json(system, at))
            drop(system, base, [m for m in mine if m not in kept])

    def abort(self, messages: list, batchId: int) -> None:
        system, base = opened(self.root)
        drop(system, base, [m.folder for m in messages if m is not None])


def drop(system: pafs.FileSystem, base: str, folders: list[str]) -> None:
    for folder in folders:
        if system.get_file_info(f"{base}/{folder}").type == pafs.FileType.Directory:
            system.delete_dir(f"{base}/{folder}")


@dataclass
class Batch(InputPartition):
    batch: int
    folder: str


class EpochReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        system, base = opened(self.root)
        found = sorted((i for i in listed(system, f"{base}/{MANIFESTS}") if i.path.endswith(".json")), key=lambda i: i.base_name)
        out = [Batch(int(i.base_name.removesuffix(".json")), folder) for i in found for folder in read_json(system, i.path)]
        return out or [Batch(-1, "")]

    def read(self, partition: Batch) -> Iterator[tuple]:
        if not partition.folder:
            return
        system, base = opened(self.root)
        path = f"{base}/{partition.folder}/{LINES}"
        size = system.get_file_info(path).size
        with system.open_input_file(path) as f:
            for _, line in lines_of(f, Stretch("", 0, size, True, size)):
                yield partition.batch, line


class EpochLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epoch_log"

    def schema(self) -> str:
        return "batch long, line string"

    def reader(self, schema) -> DataSourceReader:
        return EpochReader(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return EpochWriter(self.options["path"])


def growing_log(spark: SparkSession, root: str, range_bytes: int = RANGE) -> DataFrame:
    """Stream of (path, off, line) of the text files below root, as they grow."""
    spark.dataSource.register(GrowingLog)
    return spark.readStream.format("growing_log").option("rangeBytes", range_bytes).load(root)


def write_epochs(lines: DataFrame, root: str, checkpoint: str):
    """Start the stream (line) into the epoch log below root, up to what is there now."""
    lines.sparkSession.dataSource.register(EpochLog)
    w = lines.select("line").writeStream.format("epoch_log").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return w.start(root)


def read_epochs(spark: SparkSession, root: str) -> DataFrame:
    """batch, line of the committed micro-batches."""
    spark.dataSource.register(EpochLog)
    return spark.read.format("epoch_log").load(root)
