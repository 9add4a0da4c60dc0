"""WARC records in ZIP-packaged archives: written per partition, read by ranges without extraction.

An archive is a ZIP file with two stored (method 0) members: ``archive/data.warc.gz``, one gzip member per
record, and ``indexes/index.cdxj``, one line per record with its offset and length in the first. The
reader parses the end record, the ZIP64 locator and the central directory, finds where a stored member
begins, reads the index by range and then each record by range. It takes any object with
``read_at(offset, length)`` and a size.

``save_archives`` writes files to a folder that all executors share and returns a table of them;
``read_files`` opens files by range: one task per archive reads directory and index and names runs of
records of at most ``RUN_BYTES``, which are dealt to all tasks, so a large archive is read by many.
File names carry the attempt that wrote them: files of lost attempts are in no table and are never read.
Folders are opened by Arrow (local or mounted, S3, GCS, HDFS). ``write_archives`` and ``read_archives`` do
the same with archives as rows ``(path, content)``, as the ``binaryFile`` source gives them from a store that
only Spark reads.

Cases: a null payload is an empty one; a null id is written as such, comes back as null and stands
below all others; rows that repeat the largest id of a payload are all responses; an empty table
gives no archives and an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.session import write_table

RECORDS = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
# A partition starts a new archive at this size; an archive is one row and one task's read.
ARCHIVE_BYTES = 8 << 20
# Records that one row names for a task to read: bytes and number at most, a larger record alone.
RUN_BYTES = 8 << 20
RUN_RECORDS = 10_000
# Bytes of records dealt to one partition of the reading stage, and of an index read at once.
_PARTITION_BYTES = 64 << 20
_INDEX_BYTES = 1 << 20
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = (b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4")
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF
_ID_URN = "urn:weekloom:page:"


class Content:
    """Range reads on bytes that are already there."""

    def __init__(self, data):
        self.view = memoryview(data)
        self.size = len(self.view)

    def read_at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"range {offset}+{length} lies outside {self.size} bytes")
        return bytes(self.view[offset : offset + length])


class SeekableFile:
    """Range reads on an open file."""

    def __init__(self, file):
        self.file = file
        self.size = file.seek(0, 2)

    def read_at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"range {offset}+{length} lies outside {self.size} bytes")
        self.file.seek(offset)
        return self.file.read(length)


class StoredFile:
    """Range reads on a file of a shared store; ``bytes_read`` counts them."""

    def __init__(self, path: str):
        store, at = located(path)
        self.file = store.open_input_file(at)
        self.size = self.file.size()
        self.bytes_read = 0

    def read_at(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"range {offset}+{length} lies outside {self.size} bytes")
        self.bytes_read += length
        return self.file.read_at(length, offset)

    def __enter__(self) -> StoredFile:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, and the path there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    if "://" in path:
        return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return pafs.LocalFileSystem(), path


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header_offset: int


def _end_of_directory(source) -> tuple[int, int, int]:
    """Entries, size and offset of the central directory."""
    tail_at = max(0, source.size - 22 - _FULL16)
    tail = source.read_at(tail_at, source.size - tail_at)
    at = tail.rfind(_END)
    # The signature may also stand in the comment: the record must end where the file ends.
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if _FULL16 != entries and _FULL32 not in (size, offset):
        return entries, size, offset
    locator = source.read_at(tail_at + at - 20, 20)
    if locator[:4] != _LOCATOR64:
        raise ValueError("ZIP64 locator missing")
    record = source.read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
    if record[:4] != _END64:
        raise ValueError("ZIP64 end record missing")
    return struct.unpack_from("<QQQ", record, 32)


def members(source) -> dict[str, Member]:
    """The central directory, ZIP64 fields resolved."""
    entries, size, offset = _end_of_directory(source)
    directory = source.read_at(offset, size)
    found, at = {}, 0
    for _ in range(entries):
        if directory[at : at + 4] != _ENTRY:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        stored, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        wide = _zip64_field(extra)
        # The field has only the values that do not fit, in this order.
        full, wide = _wide(full, wide)
        stored, wide = _wide(stored, wide)
        header, wide = _wide(header, wide)
        found[name] = Member(name, method, full, stored, header)
        at += 46 + n_name + n_extra + n_comment
    return found


def _zip64_field(extra: bytes) -> bytes:
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            return extra[at + 4 : at + 4 + size]
        at += 4 + size
    return b""


def _wide(value: int, field: bytes) -> tuple[int, bytes]:
    if value != _FULL32 or len(field) < 8:
        return value, field
    return struct.unpack_from("<Q", field)[0], field[8:]


def data_offset(source, member: Member) -> int:
    """Where a stored member's bytes begin; names and extras of the local header may differ."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed: only stored members can be read by ranges")
    header = source.read_at(member.header_offset, 30)
    if header[:4] != _LOCAL:
        raise ValueError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", header, 26)
    return member.header_offset + 30 + n_name + n_extra


def read_index(source, listed: dict[str, Member]) -> Iterator[dict]:
    """The entries of the index, some of whose bytes are held at a time."""
    member = listed[INDEX]
    begin, left = data_offset(source, member), b""
    for at in range(0, member.size, _INDEX_BYTES):
        *lines, left = (left + source.read_at(begin + at, min(_INDEX_BYTES, member.size - at))).split(b"\n")
        yield from (json.loads(line[line.index(b"{") :]) for line in lines if line.strip())
    if left.strip():
        yield json.loads(left[left.index(b"{") :])


def read_record(source, begin: int, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and the body of the record at a range of the stored member."""
    record = zlib.decompress(source.read_at(begin + offset, length), 31)
    head, _, block = record.partition(b"\r\n\r\n")
    headers = _headers(head)
    block = block[: int(headers["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return headers, _headers(http), body


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def warc_record(page_id, uri: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: ``response`` with its payload, or ``revisit`` with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    clean_uri = " ".join(uri.split())
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID_URN}{'null' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean_uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "WARC-Date: 1970-01-01T00:00:00Z",
    ]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <{_ID_URN}{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def zip_stored(files: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; with ``zip64`` or where a value does not fit, with ZIP64 fields."""
    out, directory = bytearray(), bytearray()
    for name, data in files:
        raw, at = name.encode(), len(out)
        wide = zip64 or max(at, len(data)) >= _FULL32
        size = _FULL32 if wide else len(data)
        crc = zlib.crc32(data)
        local = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        central = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        need = 45 if wide else 20
        # Version, flags (UTF-8 names), method 0, time and date of 1980-01-01.
        out += struct.pack("<4sHHHHHIIIHH", _LOCAL, need, 0x800, 0, 0, 33, crc, size, size, len(raw), len(local))
        out += raw + local + data
        directory += struct.pack(
            "<4sHHHHHHIIIHHHHHII", _ENTRY, need, need, 0x800, 0, 0, 33, crc, size, size, len(raw), len(central),
            0, 0, 0, 0, _FULL32 if wide else at,
        )
        directory += raw + central
    at, n = len(out), len(files)
    out += directory
    wide = zip64 or at + len(directory) >= _FULL32 or n >= _FULL16
    if wide:
        end = len(out)
        out += struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, len(directory), at)
        out += struct.pack("<4sIQI", _LOCATOR64, 0, end, 1)
    n, size, at = (_FULL16, _FULL32, _FULL32) if wide else (n, len(directory), at)
    out += struct.pack("<4sHHHHIIH", _END, 0, 0, n, n, size, at, 0)
    return bytes(out)


def _base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """``pages`` with ``_refers_to``: the response's id for revisits, null for responses.

    Payloads are matched by SHA-1 and length. The winner of a payload is found by a combined
    aggregate; the join back is one adaptive execution may split where a payload is very common.
    """
    payload = F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8")
    keyed = pages.withColumn("_digest", F.sha1(payload)).withColumn("_n", F.octet_length(payload))
    best = keyed.where(F.col("_n") >= least_bytes).groupBy("_digest", "_n").agg(F.max(id_col).alias("_best"))
    joined = keyed.join(best, ["_digest", "_n"], "left")
    own = F.col("_best").isNull() | F.col(id_col).eqNullSafe(F.col("_best"))
    return joined.withColumn("_refers_to", F.when(~own, F.col("_best"))).drop("_digest", "_n", "_best")


def _marked(pages: DataFrame, id_col: str, uri_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    marked = mark_revisits(pages.select(id_col, uri_col, payload_col), id_col, payload_col, least_bytes)
    return marked.select(
        F.col(id_col).alias("_id"), F.col(uri_col).alias("_uri"), F.col(payload_col).alias("_payload"), "_refers_to"
    )


def _packed(batches: Iterator[pa.RecordBatch], archive_bytes: int) -> Iterator[tuple[str, bytes, int]]:
    """(name, bytes, records) of the archives of a partition."""
    number, data, index = 0, bytearray(), []

    def archive() -> tuple[str, bytes, int]:
        name = f"part-{TaskContext.get().partitionId():06d}-{number:04d}.wacz"
        return name, zip_stored([(RECORDS, bytes(data)), (INDEX, "\n".join(index).encode())]), len(index)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("_id", "_uri", "_payload", "_refers_to"))
        for page_id, uri, payload, refers_to in zip(*columns):
            body = (payload or "").encode()
            digest = _base32_sha1(body)
            record = _gzip(warc_record(page_id, uri or "", body, digest, refers_to))
            entry = {"offset": str(len(data)), "length": str(len(record)), "digest": digest}
            index.append(f"{digest} 19700101000000 {json.dumps(entry)}")
            data += record
            if len(data) >= archive_bytes:
                yield archive()
                number, data, index = number + 1, bytearray(), []
    if index:
        yield archive()


def write_archives(
    pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0
) -> DataFrame:
    """``(path, content)``: ZIP archives with a WARC record for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, content, _ in _packed(batches, ARCHIVE_BYTES):
            yield pa.record_batch({"path": pa.array([name]), "content": pa.array([content], pa.binary())})

    return _marked(pages, id_col, uri_col, payload_col, least_bytes).mapInArrow(run, "path string, content binary")


def save_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """``(path, n_bytes, n_records)`` of archive files written to ``folder``, with a record for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = located(folder)
        attempt = TaskContext.get().taskAttemptId()
        store.create_dir(at, recursive=True)
        for name, content, n in _packed(batches, archive_bytes):
            name = name.replace(".wacz", f"-{attempt}.wacz")
            with store.open_output_stream(f"{at}/{name}") as out:
                out.write(content)
            row = {"path": [f"{folder}/{name}"], "n_bytes": [len(content)], "n_records": [n]}
            yield pa.record_batch(row)

    rows = _marked(pages, id_col, uri_col, payload_col, least_bytes)
    # The table names the files of those attempts only whose rows Spark committed.
    return write_table(rows.mapInArrow(run, "path string, n_bytes long, n_records long"), "archive-files")


def _page_id(urn: str | None) -> str | None:
    if urn is None:
        return None
    text = urn.strip("<>").removeprefix(_ID_URN)
    return None if text == "null" else text


_KINDS = [("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64())]
_KINDS += [("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]
_RECORD = pa.schema([*_KINDS, ("payload", pa.binary())])
_RECORD_DDL = (
    "page_id string, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to string, payload binary"
)


def _row(source, begin: int, offset: int, length: int, payloads: bool) -> dict:
    warc, http, body = read_record(source, begin, offset, length)
    response = warc["warc-type"] == "response"
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    if response and _base32_sha1(body) != digest:
        raise ValueError(f"payload of {warc['warc-record-id']} does not have its digest")
    return {
        "page_id": _page_id(warc["warc-record-id"]),
        "url": warc["warc-target-uri"],
        "payload_bytes": len(body) if response else int(http["content-length"]),
        "payload_digest": digest,
        "record_type": warc["warc-type"],
        "refers_to": _page_id(warc.get("warc-refers-to")),
        "payload": body if response and payloads else None,
    }


def _in_batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some ``RUN_BYTES`` of payloads, however well they were packed."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["payload"] or b"")
        if size >= RUN_BYTES or len(held) >= RUN_RECORDS:
            yield pa.RecordBatch.from_pylist(held, _RECORD)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, _RECORD)


def runs_of(source, run_bytes: int = RUN_BYTES) -> Iterator[tuple[int, list[int], list[int]]]:
    """(begin of the record member, offsets, lengths) of runs of records, as the index lists them."""
    listed = members(source)
    begin = data_offset(source, listed[RECORDS])
    offsets, lengths, size = [], [], 0
    for entry in read_index(source, listed):
        length = int(entry["length"])
        if offsets and (size + length > run_bytes or len(offsets) >= RUN_RECORDS):
            yield begin, offsets, lengths
            offsets, lengths, size = [], [], 0
        offsets.append(int(entry["offset"]))
        lengths.append(length)
        size += length
    if offsets:
        yield begin, offsets, lengths


def _typed(records: DataFrame, id_type: str) -> DataFrame:
    return records.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def read_files(files: DataFrame, id_type: str = "long", payloads: bool = True, run_bytes: int = RUN_BYTES) -> DataFrame:
    """A row per record of the archive files named in ``path``, as ``read_archives`` gives them.

    Of a file only the end, the directory, the index and the ranges of its records are read.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with StoredFile(path) as source:
                    for begin, offsets, lengths in runs_of(source, run_bytes):
                        run = {"path": [path], "begin": [begin], "offsets": [offsets], "lengths": [lengths]}
                        yield pa.record_batch(run)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                with StoredFile(run["path"]) as source:
                    ranges = zip(run["offsets"], run["lengths"])
                    yield from _in_batches(_row(source, run["begin"], *at, payloads) for at in ranges)

    named = files.where(F.col("path").isNotNull()).select("path")
    cores = named.sparkSession.sparkContext.defaultParallelism
    # Tables of names are small files that Spark reads in one task: names and runs are dealt by number.
    runs = named.repartition(cores).mapInArrow(index, "path string, begin long, offsets array<long>, lengths array<long>")
    runs = write_table(runs, "record-runs")
    total = runs.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0]
    spread = runs.repartition(max(cores, math.ceil((total or 0) / _PARTITION_BYTES)))
    return _typed(spread.mapInArrow(read, _RECORD_DDL), id_type)


def read_archives(archives: DataFrame, id_type: str = "long", payloads: bool = True) -> DataFrame:
    """A row per record of archives ``(path, content)``.

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``; the payload of a
    revisit is null, its length and digest are those its record states; without ``payloads`` it is null
    everywhere, although every payload is read and checked. A response whose payload does not
    have the stated digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                source = Content(content.as_buffer())
                for begin, offsets, lengths in runs_of(source):
                    yield from _in_batches(_row(source, begin, *at, payloads) for at in zip(offsets, lengths))

    return _typed(archives.select("content").mapInArrow(run, _RECORD_DDL), id_type)
