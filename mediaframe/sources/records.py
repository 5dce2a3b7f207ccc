"""Tables as fixed-width binary records: ``records``.

    write_records(df, root, LAYOUT, keys=["frame", "block"])
    read_records(spark, root, ["frame", "v"]).where("frame = 7")

A layout lists (column, numpy type, values a row); a record holds a bit per column that says whether it is null, then the columns one after the other, so that the
place of every value is known. Files begin with their layout and are committed like ``files.write_files``. For every ``group`` records the least and greatest keys are noted in a list
beside the file, and for the whole file in the manifest.

Reading takes the columns that the schema asks for from their places and decodes no others. Comparisons of key columns with constants are pushed down
(``spark.sql.python.filterPushdown.enabled``, or the option ``between``): the driver skips files by the manifest, a task skips groups by the list, and Spark
still checks every row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from mediaframe.sources.files import DATA, MANIFESTS, FileWriter, listed, opened, read_json, write_json

FORMAT = "records"
GROUP = 4096
RECORDS, ZONES, LAYOUT = "records", "_zones", "_layout"
Layout = Sequence[tuple[str, str, int]]


def record_type(layout: Layout) -> np.dtype:
    mask = -(-len(layout) // 8)
    fields, at = {"__null": ((np.uint8, (mask,)), 0)}, mask
    for name, kind, n in layout:
        fields[name] = ((np.dtype(kind), (n,)) if n > 1 else np.dtype(kind), at)
        at += np.dtype(kind).itemsize * n
    return np.dtype({"names": list(fields), "formats": [f for f, _ in fields.values()], "offsets": [o for _, o in fields.values()], "itemsize": at})


def spark_type(kind: str, n: int) -> T.DataType:
    one = {"i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
    t = one[np.dtype(kind).str[1:]]
    return T.ArrayType(t) if n > 1 else t


def packed(batch: pa.RecordBatch, layout: Layout) -> np.ndarray:
    """Records of a batch."""
    out = np.zeros(batch.num_rows, record_type(layout))
    for i, (name, kind, n) in enumerate(layout):
        c = batch.column(batch.schema.get_field_index(name))
        null = c.is_null().to_numpy(zero_copy_only=False)
        out["__null"][:, i // 8] |= null.astype(np.uint8) << (i % 8)
        if n == 1:
            out[name] = c.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            continue
        whole = c.filter(pa.array(~null))
        if any(len(x) != n for x in whole):
            raise ValueError(f"{name} needs {n} values a row")
        out[name][~null] = np.array(whole.flatten().to_numpy(zero_copy_only=False)).astype(kind).reshape(-1, n)
    return out


def unpacked(rec: np.ndarray, layout: Layout, columns: list[str], schema: pa.Schema) -> pa.RecordBatch:
    place = {name: (i, n) for i, (name, _, n) in enumerate(layout)}
    arrays = []
    for name, field in zip(columns, schema, strict=True):
        i, n = place[name]
        null = (rec["__null"][:, i // 8] >> (i % 8) & 1).astype(bool)
        v = np.ascontiguousarray(rec[name])
        if n == 1:
            arrays.append(pa.array(v, mask=null).cast(field.type))
        else:
            values = pa.array(v.ravel()).cast(field.type.value_type)
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(rec) * n + 1, n), pa.int32()), values, mask=pa.array(null)).cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def bounds(rec: np.ndarray, layout: Layout, keys: Sequence[str]) -> dict[str, list | None]:
    """Least and greatest value of each key, None where all are null."""
    order = [name for name, _, _ in layout]
    out = {}
    for k in keys:
        i = order.index(k)
        v = rec[k][(rec["__null"][:, i // 8] >> (i % 8) & 1) == 0]
        out[k] = [v.min().item(), v.max().item()] if len(v) else None
    return out


@dataclass
class Recorded(WriterCommitMessage):
    folder: str
    count: int
    keys: dict


class RecordWriter(DataSourceArrowWriter, FileWriter):
    def __init__(self, options, overwrite: bool):
        FileWriter.__init__(self, options["path"], overwrite)
        self.layout = [tuple(x) for x in json.loads(options["layout"])]
        self.keys, self.group = json.loads(options.get("keys", "[]")), int(options.get("group", GROUP))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, base = opened(self.root)
        task = TaskContext.get()
        folder = f"{DATA}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(f"{base}/{folder}", recursive=True)
        try:
            zones, count, held = [], 0, np.zeros(0, record_type(self.layout))
            with system.open_output_stream(f"{base}/{folder}/{RECORDS}") as f:

                def put(rec):
                    f.write(rec.tobytes())
                    zones.append([count, len(rec), bounds(rec, self.layout, self.keys)])

                for batch in iterator:
                    held = np.concatenate([held, packed(batch, self.layout)])
                    while len(held) >= self.group:
                        put(held[: self.group])
                        count, held = count + self.group, held[self.group :]
                if len(held):
                    put(held)
                    count += len(held)
            write_json(system, f"{base}/{folder}/{ZONES}", zones)
            write_json(system, f"{base}/{folder}/{LAYOUT}", self.layout)
        except BaseException:
            system.delete_dir(f"{base}/{folder}")
            raise
        spans = {k: [z[2][k] for z in zones if z[2][k]] for k in self.keys}
        return Recorded(folder, count, {k: [min(a for a, _ in s), max(b for _, b in s)] if s else None for k, s in spans.items()})

    def commit(self, messages: list) -> None:
        super().commit(messages)
        system, base = opened(self.root)
        # the keys of each file, beside the manifest that counts
        write_json(system, f"{base}/{MANIFESTS}/{self.job}.keys", {m.folder: [m.count, m.keys] for m in messages if m is not None})


def limits(f) -> tuple[str, float, float] | None:
    """(column, least, greatest) that a filter allows at most; None where it says nothing of the kind."""
    name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
    if name is None:
        return None
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    if isinstance(f, (EqualTo, EqualNullSafe)) and number(f.value):
        return name, f.value, f.value
    if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and number(f.value):
        return name, f.value, np.inf
    if isinstance(f, (LessThan, LessThanOrEqual)) and number(f.value):
        return name, -np.inf, f.value
    if isinstance(f, In) and f.value and all(map(number, f.value)):
        return name, min(f.value), max(f.value)
    return None


@dataclass
class RecordFile(InputPartition):
    folder: str


class RecordReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.root, self.schema = options["path"], schema
        self.wanted: dict[str, tuple[float, float]] = {}
        for name, lo, hi in json.loads(options.get("between", "[]")):
            self.narrow(name, lo, hi)

    def narrow(self, name: str, lo: float, hi: float) -> None:
        a, b = self.wanted.get(name, (-np.inf, np.inf))
        self.wanted[name] = max(a, lo), min(b, hi)

    def possible(self, keys: dict) -> bool:
        """May records within these key bounds pass?"""
        for name, (lo, hi) in self.wanted.items():
            if name in keys and (keys[name] is None or keys[name][0] > hi or keys[name][1] < lo):
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        system, base = opened(self.root)
        out = []
        for info in sorted(listed(system, f"{base}/{MANIFESTS}"), key=lambda i: i.path):
            if info.path.endswith(".json"):
                keys = read_json(system, info.path.removesuffix(".json") + ".keys")
                out += [RecordFile(f) for f in read_json(system, info.path) if keys[f][0] and self.possible(keys[f][1])]
        return out or [RecordFile("")]

    def read(self, partition: RecordFile) -> Iterator[pa.RecordBatch]:
        if not partition.folder:
            return
        system, base = opened(self.root)
        folder = f"{base}/{partition.folder}"
        layout = [tuple(x) for x in read_json(system, f"{folder}/{LAYOUT}")]
        kind, columns, arrow = record_type(layout), self.schema.names, to_arrow_schema(self.schema)
        with system.open_input_file(f"{folder}/{RECORDS}") as f:
            for start, count, keys in read_json(system, f"{folder}/{ZONES}"):
                if self.possible(keys):
                    f.seek(start * kind.itemsize)
                    yield unpacked(np.frombuffer(f.read(count * kind.itemsize), kind), layout, columns, arrow)


class PushingReader(RecordReader):
    """For sessions that push filters down; Spark refuses such a reader in others."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            found = limits(f)
            if found:
                self.narrow(*found)
            yield f  # groups are skipped whole: Spark still looks at each row


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        """All columns, from the layout of the first file."""
        system, base = opened(self.options["path"])
        folders = [f for i in listed(system, f"{base}/{MANIFESTS}") if i.path.endswith(".json") for f in read_json(system, i.path)]
        layout = read_json(system, f"{base}/{folders[0]}/{LAYOUT}") if folders else []
        return T.StructType([T.StructField(name, spark_type(kind, n)) for name, kind, n in layout])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        kind = PushingReader if self.options.get("push") == "true" else RecordReader
        return kind(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool):
        return RecordWriter(self.options, overwrite)


def write_records(df: DataFrame, root: str, layout: Layout, keys: Sequence[str] = (), mode: str = "append", group: int = GROUP) -> None:
    """df's columns of the layout as records. Rows are range-partitioned and sorted by the keys, so that files and groups hold narrow ranges of them."""
    df.sparkSession.dataSource.register(Records)
    rows = df.select(*[name for name, _, _ in layout])
    if keys:
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    w = rows.write.format(FORMAT).option("layout", json.dumps(list(layout))).option("keys", json.dumps(list(keys))).option("group", group)
    w.mode(mode).save(root)


def read_records(spark: SparkSession, root: str, columns: Sequence[str] | None = None, between: Sequence[tuple[str, float, float]] = ()) -> DataFrame:
    """The records below root, ``columns`` of them alone; ``between`` skips files and groups that hold nothing of (column, least, greatest)."""
    spark.dataSource.register(Records)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(FORMAT).option("between", json.dumps(list(between))).option("push", push)
    if columns is not None:
        have = {f.name: f for f in reader.load(root).schema.fields}
        reader = reader.schema(T.StructType([have[c] for c in columns]))
    return reader.load(root)
