"""WARC records inside ZIP archives: writing them, and reading single records by byte range.

Each task packs its records into one archive: a member of gzipped WARC records and an index member
with a line a record. Members are stored without ZIP compression, so a record's place in the archive
is known and it is read by range, without extracting the member. The reader parses the end record,
its ZIP64 counterpart, the central directory with ZIP64 extra fields, and the local headers.

Of records with equal payloads of ``least`` bytes or more, the one with the smallest id is written
as a response; others become revisit records that name it and have no payload. Archives are
written under a name of the task attempt into the shared folder, so a task that runs again writes
files of its own; only files that the written table names are read.

Defined results: null payloads count as empty; a null URL is written as an empty target; smaller
payloads are all responses; pages without an id are responses that no record refers to; rows that repeat an id with an equal payload are all responses if that
id is the smallest; extra columns are ignored; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.sources.scratch import checkpointed, scratch_dir

LEAST = 100
#: Payload bytes an archive aims at.
ARCHIVE_BYTES = 24 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_END, _END64, _LOCATOR, _CENTRAL, _LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


def _crlf(*lines: str) -> bytes:
    return "".join(f"{x}\r\n" for x in lines).encode()


def warc_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload."""
    kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{f'none-{uuid.uuid4().hex}' if page_id is None else page_id}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: text/html",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _crlf(*head, f"Content-Length: {len(body)}", "") + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    headers.setdefault("WARC-Target-URI", "")
    return headers, rest[: int(headers["Content-Length"])]


class ZipWriter:
    """Stored members written one after another to a stream, with ZIP64 fields where asked or needed."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """A member of a size not known yet: its sizes follow it in a descriptor."""
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(struct.pack("<IHHHHHIIIHH", _LOCAL, 45, 0x0808, 0, 0, 0x5821, 0, _MAX32, _MAX32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> int:
        """Appends to the member; the place in the archive where the data begins."""
        place, member = self.at, self.members[-1]
        member[2], member[3] = zlib.crc32(data, member[2]), member[3] + len(data)
        self._write(data)
        return place

    def end(self) -> None:
        _, _, crc, size = self.members[-1]
        self._write(struct.pack("<IIQQ", 0x08074B50, crc, size, size))

    def close(self) -> None:
        start = self.at
        for raw, place, crc, size in self.members:
            big = self.zip64 or max(size, place) >= _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, place) if big else b""
            sizes = (_MAX32, _MAX32) if big else (size, size)
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 0x0808, 0, 0, 0x5821, crc, *sizes, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if big else place) + raw + extra)
        size, n, end = self.at - start, len(self.members), self.at
        big = self.zip64 or max(size, start) >= _MAX32 or n >= _MAX16
        if big:
            self._write(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<IIQI", _LOCATOR, 0, end, 1))
        count, wide = (_MAX16, (_MAX32, _MAX32)) if big else (n, (size, start))
        self._write(struct.pack("<IHHHHIIH", _END, 0, 0, count, count, *wide, 0))


@dataclass(frozen=True)
class Member:
    name: str
    start: int
    size: int


class ZipReader:
    """Reads ranges of an archive through ``read(place, size)``."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size

    def members(self) -> dict[str, Member]:
        """Stored members by name, with the place of their data."""
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(struct.pack("<I", _END))
        if at < 0:
            raise ValueError("no end of a ZIP directory")
        _, _, _, _, n, size, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
        if n == _MAX16 or _MAX32 in (size, start):
            sign, _, place, _ = struct.unpack("<IIQI", self.read(tail_at + at - 20, 20))
            if sign != _LOCATOR:
                raise ValueError("no locator of the ZIP64 directory")
            sign, _, _, _, _, _, _, n, size, start = struct.unpack("<IQHHIIQQQQ", self.read(place, 56))
            if sign != _END64:
                raise ValueError("no ZIP64 directory")
        out, data, at = {}, self.read(start, size), 0
        for _ in range(n):
            f = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
            if f[0] != _CENTRAL:
                raise ValueError("broken ZIP directory")
            method, packed, full, names, extras, comment, place = f[4], f[8], f[9], f[10], f[11], f[12], f[16]
            name = data[at + 46 : at + 46 + names].decode()
            wide = self._wide(data[at + 46 + names : at + 46 + names + extras], [full, packed, place])
            if method:
                raise ValueError(f"{name} is compressed: its records can't be read by range")
            out[name] = self._member(name, wide[2], wide[1])
            at += 46 + names + extras + comment
        return out

    @staticmethod
    def _wide(extra: bytes, values: list[int]) -> list[int]:
        """Values of which those of 32 bits that are all ones are in the ZIP64 extra field."""
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                rest = extra[at + 4 : at + 4 + size]
                wide = iter(struct.unpack(f"<{len(rest) // 8}Q", rest[: len(rest) // 8 * 8]))
                return [next(wide) if v == _MAX32 else v for v in values]
            at += 4 + size
        return values

    def _member(self, name: str, place: int, size: int) -> Member:
        head = struct.unpack("<IHHHHHIIIHH", self.read(place, 30))
        if head[0] != _LOCAL:
            raise ValueError(f"no local header of {name}")
        return Member(name, place + 30 + head[9] + head[10], size)


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages with the digest of their payload and, for revisits, the page that they refer to.

    Smallest ids are found by a pre-aggregated grouping; only digests that repeat are joined back.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    repeats = rows.select("page_id", "digest").join(first.where("first < last"), "digest").where("page_id > first").select("page_id", "digest", "first").distinct()
    return rows.join(repeats.withColumnRenamed("first", "refers_to"), ["page_id", "digest"], "left")


WRITTEN = "path string, size long, records long"


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows of ``roles`` as archives; one row each: path, size, records."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        out = None
        for batch in batches:
            names = ("page_id", "url", "payload", "digest", "refers_to")
            for page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if out is None:
                    path = f"{base}/pages-{task.stageId()}-{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.wacz"
                    out = store.open_output_stream(path)
                    made, index, held = ZipWriter(out), io.BytesIO(), 0
                    made.begin(DATA)
                record = gzip.compress(warc_record(page, url, payload, digest, refers), 1, mtime=0)
                place = made.write(record) - made.members[0][1]
                index.write((json.dumps({"id": page, "offset": place, "length": len(record)}) + "\n").encode())
                held += 1
                if made.at >= ARCHIVE_BYTES:
                    yield finish(made, index, out, store, path, held)
                    out = None
        if out is not None:
            yield finish(made, index, out, store, path, held)

    def finish(made, index, out, store, path, held) -> pa.RecordBatch:
        made.end()
        made.begin(INDEX)
        made.write(index.getvalue())
        made.end()
        made.close()
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([made.at]), pa.array([held])], names=["path", "size", "records"])

    return rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(pack, WRITTEN)


RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Records of the archives that a table names, each read by its own range."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                with store.open_input_file(path) as f:
                    reader = ZipReader(lambda at, n, f=f: f.read_at(n, at), size)
                    members = reader.members()
                    data, index = members[DATA], members[INDEX]
                    local = struct.unpack("<IHHHHHIIIHH", reader.read(0, 30))
                    shift = data.start - 30 - local[9] - local[10]
                    lines = reader.read(index.start, index.size).decode().splitlines()
                    rows: list[tuple] = []
                    for line in lines:
                        at = json.loads(line)
                        rows.append(parsed(gzip.decompress(reader.read(shift + at["offset"], at["length"]))))
                        if len(rows) >= 500:
                            yield table(rows)
                            rows = []
                    if rows:
                        yield table(rows)

    def parsed(data: bytes) -> tuple:
        head, payload = parse_record(data)

        def number(field: str) -> int | None:
            said = head[field].strip("<>").rsplit(":", 1)[1] if field in head else "none"
            return None if said.startswith("none") else int(said)

        kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "response" and sha256(payload).hexdigest() != said:
            raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
        return number("WARC-Record-ID"), head["WARC-Target-URI"], kind, said, int(head["X-Payload-Length"]), number("WARC-Refers-To"), payload

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in RECORDS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.mapInArrow(unpack, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> tuple[DataFrame, str]:
    """Writes all pages; the table of archives, and the folder that holds them."""
    spark = pages.sparkSession
    folder = folder or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = f"file://{folder}" if not folder.startswith("file:") else folder.replace("file:", "file://", 1)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return checkpointed(write_archives(roles(pages, least), folder)), folder


def report(pages: DataFrame) -> DataFrame:
    """Per page, read back from the archives: payload size and digest, and the record's type."""
    written, folder = archive(pages)
    n = max(1, written.count())
    rows = read_archives(written.repartition(n), folder)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def report_sql(least: int = LEAST) -> str:
    """DuckDB SQL for ``report``."""
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {least} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {least} AND page_id > first THEN first END AS refers_to FROM f"""
