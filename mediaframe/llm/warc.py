"""WARC records in ZIP-packaged archives, written and read by byte ranges.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdx``
(offset, length and page of each record). The reader finds the central directory from the end of the file, ZIP64 records
included, locates both members' bytes, reads the index, and then reads single records by their ranges; nothing is extracted and no
member is read whole but the index.

Records with equal payloads of ``revisit_bytes`` or more are stored once: the one with the largest page_id is the response, the
others revisit it. Payload groups meet by digest with partial aggregation; the join back deals hot digests to several parts.

Files go to and are read from the shared folder through its own file system. A task writes under a name of its own and hands on the
name, so a retried task leaves no half file in the result; the list of archives is a written table. An archive closes at
``archive_bytes``, which bounds a task's memory.

Defined cases: null html is an empty payload; null url is an empty URI, control characters in it are percent-encoded; pages with the same
payload and the same largest page_id are all responses; a null page_id is smaller than any other; no pages give no archives and no
rows; a damaged archive raises ValueError. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaframe.functions.lineage import work_dir
from mediaframe.functions.skew import spread_join
from mediaframe.llm.common import column, small_batches, stored

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 16 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# ---------------------------------------------------------------- WARC


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None) -> bytes:
    """A response, or with payload None a revisit of ``refers_to``."""
    uri = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if payload is None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = headers(head)
    block = rest[: int(warc["content-length"])]
    if len(block) < int(warc["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http), payload


# ---------------------------------------------------------------- ZIP

_END, _END64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_U16, _U32 = 0xFFFF, 0xFFFFFFFF

ReadAt = Callable[[int, int], bytes]  # (offset, length)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    crc: int
    packed: int
    size: int
    header: int


def zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP file of stored members with ZIP64 records throughout."""
    out, central, offset = [], [], 0
    for name, data in members:
        n, crc = name.encode(), zlib.crc32(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        local = struct.pack("<4s5H3I2H", _LOCAL, 45, 0x800, 0, 0, 33, crc, _U32, _U32, len(n), len(extra)) + n + extra
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), offset)
        central.append(struct.pack("<4s6H3I5H2I", _CENTRAL, 45, 45, 0x800, 0, 0, 33, crc, _U32, _U32, len(n), len(extra), 0, 0, 0, 0, _U32) + n + extra)
        out += [local, data]
        offset += len(local) + len(data)
    table = b"".join(central)
    end64 = struct.pack("<4sQ2H2I4Q", _END64, 44, 45, 45, 0, 0, len(central), len(central), len(table), offset)
    locator = struct.pack("<4sIQI", _LOCATOR, 0, offset + len(table), 1)
    end = struct.pack("<4s4H2IH", _END, 0, 0, _U16, _U16, _U32, _U32, 0)
    return b"".join([*out, table, end64, locator, end])


def _exactly(read: ReadAt, offset: int, length: int, mark: bytes = b"") -> bytes:
    raw = read(offset, length) if offset >= 0 else b""
    if len(raw) < length or not raw.startswith(mark):
        raise ValueError("damaged ZIP archive")
    return raw


def directory(read: ReadAt, size: int) -> list[Member]:
    """Central directory of a ZIP or ZIP64 file, from reads of its end and of the directory."""
    tail_at = max(0, size - 22 - _U16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(_END)
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)  # the mark also may stand in the comment
    if at < 0:
        raise ValueError("no ZIP end record")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == _U16 or length == _U32 or start == _U32:
        place = struct.unpack("<4sIQI", _exactly(read, tail_at + at - 20, 20, _LOCATOR))[2]
        count, length, start = struct.unpack_from("<QQQ", _exactly(read, place, 56, _END64), 32)
    table, pos, out = _exactly(read, start, length), 0, []
    for _ in range(count):
        if table[pos : pos + 4] != _CENTRAL or len(table) < pos + 46:
            raise ValueError("damaged ZIP directory")
        flags, method = struct.unpack_from("<HH", table, pos + 8)
        crc, packed, whole, n, x, c = struct.unpack_from("<IIIHHH", table, pos + 16)
        header = struct.unpack_from("<I", table, pos + 42)[0]
        name = table[pos + 46 : pos + 46 + n]
        extra, e = table[pos + 46 + n : pos + 46 + n + x], 0
        while e + 4 <= len(extra):
            kind, k = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # the 64-bit values stand in this order, each only where the short field is full
                wide = [v[0] for v in struct.iter_unpack("<Q", extra[e + 4 : e + 4 + k // 8 * 8])]
                whole = wide.pop(0) if whole == _U32 and wide else whole
                packed = wide.pop(0) if packed == _U32 and wide else packed
                header = wide.pop(0) if header == _U32 and wide else header
            e += 4 + k
        out.append(Member(name.decode("utf-8" if flags & 0x800 else "cp437", "replace"), method, flags, crc, packed, whole, header))
        pos += 46 + n + x + c
    return out


def stored_at(read: ReadAt, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method or member.flags & 1:
        raise ValueError(f"{member.name} is compressed or encrypted; only stored members can be read by ranges")
    n, x = struct.unpack_from("<HH", _exactly(read, member.header, 30, _LOCAL), 26)
    return member.header + 30 + n + x


def index_entries(read: ReadAt, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of each record of an archive."""
    members = {m.name: m for m in directory(read, size)}
    if DATA not in members or INDEX not in members:
        raise ValueError("the archive has no records or no index")
    base, index = stored_at(read, members[DATA]), members[INDEX]
    raw = _exactly(read, stored_at(read, index), index.size)
    if zlib.crc32(raw) != index.crc:
        raise ValueError("the index does not match its checksum")
    for line in raw.splitlines():
        offset, length = line.split(b" ")[:2]
        if int(offset) + int(length) > members[DATA].size:
            raise ValueError("the index points past the records")
        yield base + int(offset), int(length)


# ---------------------------------------------------------------- Spark


def placed(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, length and, for copies of a larger payload, rep: the largest page_id of the copies."""
    p = pages.select(column(page_id).cast("bigint").alias("page_id"), column(url).alias("url"), F.coalesce(column(html), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("bigint")})
    copies = p.where(F.col("length") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("rep"), F.count("*").alias("n"))
    copies = copies.where("n > 1").select("digest", "rep")
    return spread_join(p, copies, "digest", "page_id", "left")


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Write all pages; returns the table path, bytes, records (one row per archive)."""
    folder = folder or work_dir(pages.sparkSession, "warc")

    def write(batches):
        place, root = fs.FileSystem.from_uri(folder)
        place.create_dir(root, recursive=True)
        task = TaskContext.get()
        packed: list[bytes] = []
        lines: list[str] = []
        size = number = 0

        def close():
            nonlocal packed, lines, size, number
            name = f"{task.partitionId()}-{task.attemptNumber()}-{number}-{uuid.uuid4().hex}.wacz"
            raw = zip_bytes([(DATA, b"".join(packed)), (INDEX, "\n".join(lines).encode())])
            with place.open_output_stream(f"{root}/{name}") as f:
                f.write(raw)
            row = pd.DataFrame({"path": [name], "bytes": [len(raw)], "records": [len(lines)]})
            packed, lines, size, number = [], [], 0, number + 1
            return row

        for batch in batches:
            for page, url, payload, digest, length, rep in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "length", "rep")), strict=True):
                copy = rep is not None and page != rep
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = z.compress(record(page, url, None if copy else payload, digest, length, rep)) + z.flush()
                lines.append(f"{size} {len(raw)} {page}")
                packed.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pandas(close(), preserve_index=False)
        if lines:
            yield pa.RecordBatch.from_pandas(close(), preserve_index=False)

    listed = placed(small_batches(pages), **columns).mapInArrow(write, "path string, bytes long, records long")
    return stored(listed.withColumn("folder", F.lit(folder)), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url; revisits tell of the full payload."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def one(raw: bytes) -> tuple:
        warc, http, payload = parsed(zlib.decompress(raw, 31))
        page, digest = _page(warc["warc-record-id"]), warc["warc-payload-digest"].removeprefix("sha1:")
        if warc["warc-type"] == "revisit":
            return page, warc["warc-target-uri"], int(http["content-length"]), digest, "revisit", _page(warc["warc-refers-to"])
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"page {page}: the payload does not match its digest")
        return page, warc["warc-target-uri"], len(payload), digest, "response", None

    def read(batches):
        for df in batches:
            for folder, name in zip(df["folder"], df["path"], strict=True):
                place, root = fs.FileSystem.from_uri(folder)
                with place.open_input_file(f"{root}/{name}") as f:
                    at = lambda offset, length, f=f: f.read_at(length, offset)
                    rows = []
                    for offset, length in index_entries(at, f.size()):
                        rows.append(one(_exactly(at, offset, length)))
                        if len(rows) == 10_000:
                            yield _frame(rows, names)
                            rows = []
                    yield _frame(rows, names)

    n = max(1, min(archives.count(), 10_000))
    return archives.repartition(n, "path").mapInPandas(read, schema)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=names)
    return df.astype({"page_id": "Int64", "refers_to": "Int64"})


def report(pages: DataFrame, **options) -> DataFrame:
    """Per page, read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_archives(write_archives(pages, **options)).drop("url")
