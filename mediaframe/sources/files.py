"""Whole files as rows, written in two phases: ``file_rows``.

    df.select("path", "content").write.format("file_rows").mode("append").save(root)
    spark.read.format("file_rows").load(root)

Every attempt of a task writes below a folder of its own and lists its files there; the driver then commits by one small manifest that names the
folders of the attempts that count, one a task. Readers see committed folders alone, so a retried or speculative task, a failed job and a job
still running show nothing; commit and abort remove what does not count. Rows are written one at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from mediaframe.functions.batches import small_batches

FORMAT = "file_rows"
ROWS = "path string, content binary"
MANIFESTS, DATA, LIST = "_manifests", "_data", "_files"


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a location."""
    system, path = pafs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def listed(system: pafs.FileSystem, path: str, recursive: bool = False) -> list[pafs.FileInfo]:
    return system.get_file_info(pafs.FileSelector(path, recursive=recursive, allow_not_found=True))


def read_json(system: pafs.FileSystem, path: str):
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


def write_json(system: pafs.FileSystem, path: str, value) -> None:
    """Under another name first, so that no reader meets half a file."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as f:
        f.write(json.dumps(value).encode())
    system.move(part, path)


def committed(root: str) -> list[str]:
    """Folders of the task attempts that count, relative to root."""
    system, base = opened(root)
    names = sorted(i.path for i in listed(system, f"{base}/{MANIFESTS}") if i.path.endswith(".json"))
    return [d for n in names for d in read_json(system, n)]


def task_files(system: pafs.FileSystem, base: str, folder: str) -> list[list]:
    """[name, place relative to root, length] of the files one task wrote."""
    return [[name, f"{folder}/{at}", size] for name, at, size in read_json(system, f"{base}/{folder}/{LIST}")]


@dataclass
class Folder(InputPartition):
    folder: str


@dataclass
class Written(WriterCommitMessage):
    folder: str


class FileReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [Folder(f) for f in committed(self.root)] or [Folder("")]

    def read(self, partition: Folder) -> Iterator[tuple]:
        if not partition.folder:
            return
        system, base = opened(self.root)
        for name, at, _ in task_files(system, base, partition.folder):
            with system.open_input_file(f"{base}/{at}") as f:
                yield name, f.read()


class FileWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, base = opened(self.root)
        task = TaskContext.get()
        folder = f"{DATA}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(f"{base}/{folder}", recursive=True)
        try:
            done = []
            for row in iterator:
                at = f"{len(done):08d}"
                with system.open_output_stream(f"{base}/{folder}/{at}") as f:
                    f.write(bytes(row["content"] or b""))
                done.append([row["path"], at, len(row["content"] or b"")])
            write_json(system, f"{base}/{folder}/{LIST}", done)
        except BaseException:
            system.delete_dir(f"{base}/{folder}")
            raise
        return Written(folder)

    def commit(self, messages: list) -> None:
        system, base = opened(self.root)
        kept = [m.folder for m in messages if m is not None]
        for info in listed(system, f"{base}/{DATA}/{self.job}"):
            if info.path[len(base) + 1 :] not in kept:
                system.delete_dir(info.path)
        old = [i.path for i in listed(system, f"{base}/{MANIFESTS}")] if self.overwrite else []
        gone = committed(self.root) if self.overwrite else []
        system.create_dir(f"{base}/{MANIFESTS}", recursive=True)
        write_json(system, f"{base}/{MANIFESTS}/{self.job}.json", kept)
        for path in old:
            system.delete_file(path)
        for folder in gone:
            system.delete_dir(f"{base}/{folder}")

    def abort(self, messages: list) -> None:
        system, base = opened(self.root)
        if system.get_file_info(f"{base}/{DATA}/{self.job}").type == pafs.FileType.Directory:
            system.delete_dir(f"{base}/{DATA}/{self.job}")


class FileRows(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return FileReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, root: str, mode: str = "append") -> None:
    """Rows (path, content) as files below root; names are any strings and need not be unique."""
    rows.sparkSession.dataSource.register(FileRows)
    small_batches(rows.select("path", "content")).write.format(FORMAT).mode(mode).save(root)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of the files committed below root."""
    spark.dataSource.register(FileRows)
    return spark.read.format(FORMAT).load(root)
