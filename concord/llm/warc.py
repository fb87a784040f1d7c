"""WARC archives as a Spark data source, and a sink that writes them.

Reading (``spark.read.format("warc").load(folder)``): files are packed into partitions of about
``split_bytes``. Predicates on header columns are pushed down: a record's headers are parsed first, and
unless the record is wanted its payload is neither inflated to the end nor copied. ``payload`` (option: all,
none, or comma-separated record types) says whose payloads are decoded; others are null.

Members written here carry their length in the gzip extra field ``sl``, so a reader steps over them; members
without it are inflated to find the next one. Plain files are stepped over by Content-Length. A file is read
by one task and written by one, so its size is the partition's: repartition before writing if need be.

Defined cases: a null payload is an empty one; a null URI has no header and reads back as null; control
characters and blanks in URIs are percent-encoded; an empty folder gives no rows; a truncated last record raises, also where it is stepped over; headers have any length.
"""

from __future__ import annotations

import io
import re
import struct
import urllib.parse
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from concord.llm.store import materialize, small_batches

SCHEMA = (
    "file string, offset long, record_id string, record_type string, target_uri string, warc_date string, refers_to string, "
    "payload_digest string, http_length long, payload binary"
)
# columns that the headers alone decide
HEADER_COLUMNS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}
CHUNK = 1 << 20
HEAD = 1 << 12
HEAD_STEP = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, local or remote, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def record(kind: str, record_id: str, uri: str | None, date: str, digest: str, payload: bytes, length: int, refers_to: str | None) -> bytes:
    """The bytes of a response or revisit record. A revisit keeps the payload's digest and length but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if uri is not None:
        lines.insert(3, "WARC-Target-URI: " + urllib.parse.quote(uri, safe="".join(map(chr, range(0x21, 0x7F)))))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(body: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` holds its compressed and its full length."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(body) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + b"\x00" * 4 + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8)
    return head + struct.pack("<II", len(head) + 8 + len(packed) + 8, len(body) & 0xFFFFFFFF) + packed + struct.pack("<II", zlib.crc32(body), len(body) & 0xFFFFFFFF)


def write(records: DataFrame, folder: str) -> DataFrame:
    """One archive per partition of ``records``; (file, records) of those written.

    ``records``: record_id, record_type, target_uri, warc_date, refers_to, payload_digest, payload_length, payload.
    A file gets its name when complete, from the partition's number, so a task that is run again replaces it.
    """
    small_batches(records)
    columns = ["record_id", "record_type", "target_uri", "warc_date", "refers_to", "payload_digest", "payload_length", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{context.partitionId():06d}.warc.gz"
        draft, n, out = f"{base}/.{context.taskAttemptId()}.draft", 0, None
        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                rid, kind, uri, date, refers, digest, length, payload = (v.as_py() for v in row)
                out = out or store.open_output_stream(draft)
                out.write(member(record(kind, rid, uri, date, digest, payload or b"", length, refers)))
                n += 1
        if out is not None:
            out.close()
            store.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "records"])

    return materialize(records.select(*columns).mapInArrow(run, "file string, records long"))


class _Stream:
    """A file read forward in chunks, with a buffer to look ahead."""

    def __init__(self, source):
        self.source, self.buffer, self.start = source, b"", 0
        self.size = source.seek(0, io.SEEK_END)
        source.seek(0)

    def peek(self, n: int) -> bytes:
        while len(self.buffer) < n:
            more = self.source.read(max(CHUNK, n - len(self.buffer)))
            if not more:
                break
            self.buffer += more
        return self.buffer[:n]

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.source.seek(min(self.start + n, self.size))
            self.buffer = b""
        self.start += n


def _headers(head: bytes) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and where the block begins."""
    end = head.find(b"\r\n\r\n")
    if end < 0 or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    last = None
    for line in head[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        fields[last] = value.strip()
    return fields, end + 4


def _head(stream: _Stream, packed: bool) -> bytes:
    """The record's beginning, up to the blank line behind its headers at least, however long they are."""
    inflater = zlib.decompressobj(31)
    text, n, pending, scanned = bytearray(), 0, b"", 0
    while True:
        if packed and pending:
            text += inflater.decompress(pending, HEAD_STEP)
        else:
            chunk = b"" if inflater.eof else stream.peek(n + max(HEAD, n))[n:]
            if not chunk:
                raise ValueError("not a WARC record") if inflater.eof else EOFError("the last record is cut off")
            n += len(chunk)
            text += inflater.decompress(chunk, HEAD_STEP) if packed else chunk
        pending = inflater.unconsumed_tail
        if not text.startswith(b"WARC/"[: len(text)]):
            raise ValueError("not a WARC record")
        if text.find(b"\r\n\r\n", max(0, scanned - 3)) >= 0:
            return bytes(text)
        scanned = len(text)


def read_records(source, wanted, decode) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """(offset, headers, block or None) of the records for which ``wanted(headers)``; blocks where ``decode(headers)``."""
    stream = _Stream(source)
    while True:
        first = stream.peek(2)
        if not first:
            return
        at = stream.start
        if first == b"\x1f\x8b":
            head = stream.peek(20)
            if len(head) < 20:
                raise EOFError("the last record is cut off")
            length = None
            if head[3] & 4 and head[12:14] == b"sl":
                length = struct.unpack("<I", head[16:20])[0]
                if at + length > stream.size:
                    raise EOFError("the last record is cut off")
            fields, begin = _headers(_head(stream, True))
            keep = wanted(fields)
            body = None
            if length is None or (keep and decode(fields)):
                inflater, parts, n = zlib.decompressobj(31), [], 0
                while not inflater.eof:
                    chunk = stream.peek(n + CHUNK)[n:] if length is None else stream.peek(length)[n:]
                    if not chunk:
                        raise EOFError("the last record is cut off")
                    parts.append(inflater.decompress(chunk))
                    n += len(chunk)
                length = n - len(inflater.unused_data)
                body = b"".join(parts)
            stream.skip(length)
        else:
            fields, begin = _headers(_head(stream, False))
            length = begin + int(fields["content-length"]) + 4
            if at + length - 4 > stream.size:
                raise EOFError("the last record is cut off")
            keep = wanted(fields)
            body = stream.peek(length) if keep and decode(fields) else None
            stream.skip(length)
        if keep:
            yield at, fields, None if body is None or not decode(fields) else body[begin : begin + int(fields["content-length"])]


def _value(column: str, fields: dict[str, str]) -> str | None:
    value = fields.get(HEADER_COLUMNS[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.strip("<>")
    return value.removeprefix("sha1:") if column == "payload_digest" else value


@dataclass
class FilePartition(InputPartition):
    files: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", 32 << 20))
        self.payload = options.get("payload", "all")
        self.tests: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_COLUMNS and isinstance(f, EqualTo):
                self.tests.append((column, frozenset([f.value])))
            elif column in HEADER_COLUMNS and isinstance(f, In):
                self.tests.append((column, frozenset(f.value)))
            elif column in HEADER_COLUMNS and isinstance(f, IsNotNull):
                self.tests.append((column, None))
            else:
                yield f

    def partitions(self):
        store, base = filesystem(self.path)
        info = store.get_file_info(base)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        groups: list[list[str]] = []
        size = self.split
        for f in sorted((f for f in files if f.is_file and re.search(r"/[^./][^/]*\.warc(\.gz)?$", f.path)), key=lambda f: f.path):
            if size + f.size > self.split:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size
        return [FilePartition(tuple(g)) for g in groups] or [FilePartition(())]

    def _wanted(self, fields: dict[str, str]) -> bool:
        return all((v := _value(c, fields)) is not None and (allowed is None or v in allowed) for c, allowed in self.tests)

    def _decode(self, fields: dict[str, str]) -> bool:
        return self.payload == "all" or fields.get("warc-type") in self.payload.split(",")

    def read(self, partition):
        store, _ = filesystem(self.path)
        for path in partition.files:
            with store.open_input_file(path) as source:
                for at, fields, block in read_records(source, self._wanted, self._decode):
                    length = payload = None
                    if block is not None:
                        http, split, rest = block.partition(b"\r\n\r\n")
                        if fields.get("content-type", "").startswith("application/http") and split:
                            found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                            length, payload = int(found[1]) if found else None, rest
                        else:
                            payload = block
                        if fields.get("warc-type") == "revisit":
                            payload = None
                    yield (path, at, *(_value(c, fields) for c in HEADER_COLUMNS), length, payload)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read(spark, folder: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(folder)
