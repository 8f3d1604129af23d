"""WARC archives: a writer, and a PySpark data source that reads them.

``write_archives`` gives every page one record in gzip members of its own, in files of about
``FILE_BYTES`` of payload. Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the
one with the largest ``page_id`` is the ``response``; the others are ``revisit`` records that
refer to it and carry no payload. A member's gzip header tells how long the member is, so that a
reader can go past it without inflating it; archives of other writers are read as well.

``spark.read.format("warc")`` (after ``register``) reads archives named in the option ``path``, a
folder, or in ``files``. It plans its partitions from the files' sizes, ``target`` bytes to each.
Filters on record type, identifiers, URL, digest and lengths are pushed down and decided on a
record's header, which is parsed first; only payloads of accepted records are inflated, and none
when the schema asked for has no ``payload``.

Defined cases: null html is an empty payload; a null url gives a record without a target; rows
with the same ``page_id`` get a record each, and those that tie for the largest id of equal
payloads are all responses; a null ``page_id`` is smaller than every other and comes back null;
an empty table gives no archives and no rows; columns other than ``page_id``, ``url`` and ``html``
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    IsNotNull, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from docloom.llm.common import NULL_ID, batch, byte_column, doc_key, map_arrow, stored
from docloom.llm.files import new_file, storage
from docloom.session import ship_package

REVISIT_BYTES = 1000
FILE_BYTES = 128 << 20

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, content_type string, "
    "content_length long, payload_digest string, payload_bytes long, refers_to string, "
    "warc_file string, warc_offset long, payload binary"
)
_ID = "urn:page:"

# --- writing ------------------------------------------------------------------------------


def _member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` holds the lengths of the member and of its content."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + len(tail)
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def _record(kind: str, page: int, url: str | None, date: str, digest: bytes, payload: bytes, size: int, refers: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_id(page)}>", f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"X-Payload-Length: {size}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=_URI_CHARS)}")
    if refers is not None:
        lines += [f"WARC-Refers-To: <{_id(refers)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URI_CHARS = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%") + "%"


def _id(page: int) -> str:
    return _ID + ("null" if page == NULL_ID else str(page))


def page_of(record_id):
    """The ``page_id`` column of a record id column."""
    return F.expr(f"try_cast(substr({record_id}, {len(_ID) + 1}) AS long)")


_FILES = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _write(folder: str, date: str, file_bytes: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no, number = TaskContext.get().partitionId(), 0
        rows = (
            (p, u, h, b, w)
            for part in batches
            for p, u, h, b, w in zip(*(part.column(c).to_pylist() for c in ("page", "url", "html", "bytes", "winner")))
        )
        row = next(rows, None)
        while row is not None:
            name = f"pages-{part_no:06d}-{number:04d}.warc.gz"
            number += 1
            records = taken = 0
            with new_file(folder, name) as out:
                info = b"software: docloom\r\nformat: WARC File Format 1.1\r\n"
                head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:file:{name}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                size = out.write(member := _member(head.encode() + info + b"\r\n\r\n")) or len(member)
                while row is not None and taken < file_bytes:
                    page, url, html, n, winner = row
                    payload = html.encode()
                    repeat = winner is not None and winner != page
                    member = _member(_record(
                        "revisit" if repeat else "response", page, url, date, hashlib.sha1(payload).digest(),
                        payload, n, winner if repeat else None,
                    ))
                    out.write(member)
                    size, taken, records = size + len(member), taken + n, records + 1
                    row = next(rows, None)
            yield batch(_FILES, [name], [records], [size])

    return job


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> list[tuple[str, int]]:
    """Writes a record per page to a new ``folder``; returns the files' names and sizes, one entry
    per file."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(
        doc_key("page_id").alias("page"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("long").alias("bytes"), F.sha1(html).alias("digest"),
    )
    # narrow rows, and of them only payloads that repeat: usually few, so that Spark may hand them
    # to every task; when they are many the join shuffles
    winners = own.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes")
    winners = winners.agg(F.max("page").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = own.join(stored(winners, "revisits"), ["digest", "bytes"], "left")
    kept = marked.select("page", "url", "html", "bytes", "winner")
    files = map_arrow(kept, _write(folder, date, file_bytes), "name string, records long, bytes long")
    return sorted((r["name"], r["bytes"]) for r in files.collect())


# --- reading ------------------------------------------------------------------------------


class _Stream:
    """Gzip members of a file, from an offset on; a plain archive reads as one long member."""

    def __init__(self, source, size: int, offset: int):
        self.source, self.size, self.at = source, size, offset

    def record(self, want) -> tuple[dict, int, bytes | None] | None:
        """The next record's header, offset, and what ``want(header)`` asks for: its block, or
        None to go past it. None at the end."""
        if self.at >= self.size:
            return None
        start = self.at
        self.source.seek(start)
        head = self.source.read(1 << 16)
        if head[:2] != b"\x1f\x8b":
            return self._plain(start, head, want)
        length = self._member_length(head)
        inflate, raw, out = zlib.decompressobj(31), head if length is None else head[:length], b""
        taken = len(raw)
        while b"\r\n\r\n" not in out:  # the header first
            out += inflate.decompress(raw, 4096)
            raw = inflate.unconsumed_tail
            if inflate.eof:
                break
            if not raw:
                raw = self.source.read(1 << 16 if length is None else min(1 << 16, length - taken))
                taken += len(raw)
                if not raw:
                    break
        header = _header(out.split(b"\r\n\r\n", 1)[0])
        wanted = want(header)
        if length is None or wanted:
            parts = [out]
            while not inflate.eof:
                if not raw:
                    raw = self.source.read(1 << 20 if length is None else min(1 << 20, length - taken))
                    taken += len(raw)
                    if not raw:
                        break
                data = inflate.decompress(raw)
                raw = inflate.unconsumed_tail
                if wanted:
                    parts.append(data)
            out = b"".join(parts)
            if length is None:
                length = taken - len(inflate.unused_data)
        self.at = start + length
        block = None
        if wanted:
            begin = out.index(b"\r\n\r\n") + 4
            block = out[begin : begin + int(header.get("content-length", 0))]
        return header, start, block

    def _plain(self, start: int, head: bytes, want):
        while b"\r\n\r\n" not in head:
            more = self.source.read(1 << 16)
            if not more:
                break
            head += more
        header = _header(head.split(b"\r\n\r\n", 1)[0])
        if not header:
            self.at = self.size
            return None
        begin = start + head.index(b"\r\n\r\n") + 4
        length = int(header.get("content-length", 0))
        self.at = begin + length + 4
        block = None
        if want(header):
            self.source.seek(begin)
            block = self.source.read(length)
        return header, start, block

    @staticmethod
    def _member_length(head: bytes) -> int | None:
        if len(head) < 24 or not head[3] & 4:
            return None
        extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
        while len(extra) >= 4:
            n = struct.unpack_from("<H", extra, 2)[0]
            if extra[:2] == b"sl" and n == 8:
                return struct.unpack_from("<I", extra, 4)[0] or None
            extra = extra[4 + n :]
        return None


def _header(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return {}
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _hex_digest(value: str | None) -> str | None:
    if not value:
        return None
    value = value.partition(":")[2] or value
    try:
        return base64.b32decode(value).hex() if len(value) == 32 else value.lower()
    except ValueError:
        return value


def _long(value: str | None) -> int | None:
    return int(value) if value is not None and value.isdigit() else None


def _columns(header: dict[str, str], file: str, offset: int) -> dict:
    plain = lambda v: v.strip("<>") if v else None
    return {
        "record_id": plain(header.get("warc-record-id")), "record_type": header.get("warc-type"),
        "target_uri": header.get("warc-target-uri"), "date": header.get("warc-date"),
        "content_type": header.get("content-type"), "content_length": _long(header.get("content-length")),
        "payload_digest": _hex_digest(header.get("warc-payload-digest")),
        "payload_bytes": _long(header.get("x-payload-length")),
        "refers_to": plain(header.get("warc-refers-to")), "warc_file": file, "warc_offset": offset,
    }


def payload_of(header: dict[str, str], block: bytes) -> bytes:
    """A block without its HTTP header."""
    if "application/http" in header.get("content-type", "") and block.startswith(b"HTTP/"):
        return block.partition(b"\r\n\r\n")[2]
    return block


#: Columns that a header tells, on which filters are decided before a payload is inflated.
_TOLD = frozenset("record_id record_type target_uri date content_type content_length payload_digest payload_bytes refers_to".split())
_TESTS = {
    EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, In: lambda v, x: v in x,
}


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.folder = options["path"]
        self.target = int(options.get("target", 128 << 20))
        self.listed = json.loads(options["files"]) if "files" in options else None
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            path = getattr(f, "attribute", ())  # a negated or unknown filter stays with Spark
            name = path[0] if len(path) == 1 else None
            kind = type(f)
            if name in _TOLD and (kind in _TESTS or kind is IsNotNull):
                self.tests.append((name, kind.__name__, None if kind is IsNotNull else f.value))
            else:
                yield f

    def partitions(self):
        if self.listed is None:
            where, path = storage(self.folder)
            found = where.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
            files = [(x.path[len(path) :].lstrip("/"), x.size) for x in found if x.is_file and ".warc" in x.base_name and not x.base_name.startswith("_")]
        else:
            files = [tuple(x) for x in self.listed]
        out, held, n = [], [], 0
        for name, size in sorted(files):
            if held and n + size > self.target:
                out.append(Files(held))
                held, n = [], 0
            held.append((name, size))
            n += size
        return out + ([Files(held)] if held else [Files([])])

    def read(self, partition):
        by_name = {k.__name__: v for k, v in _TESTS.items()}
        payload = "payload" in self.names

        def accepts(row: dict) -> bool:
            for name, kind, value in self.tests:
                v = row[name]
                if v is None or kind != "IsNotNull" and not by_name[kind](v, value):
                    return False
            return True

        where, path = storage(self.folder)
        for name, size in partition.files:
            with where.open_input_file(f"{path}/{name}") as source:
                stream = _Stream(source, size, 0)
                while True:
                    got = stream.record(lambda h: payload and accepts(_columns(h, name, 0)))
                    if got is None:
                        break
                    header, offset, block = got
                    row = _columns(header, name, offset)
                    if accepts(row):
                        row["payload"] = payload_of(header, block) if block is not None else None
                        yield tuple(row[n] for n in self.names)


class WarcSource(DataSource):
    """``spark.read.format("warc")``; options: ``path``, ``files`` (JSON list of name and size),
    ``target`` (bytes per partition). The read schema may name any of the columns."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_archives(spark: SparkSession, folder: str, files: list[tuple[str, int]] | None = None, columns: str = SCHEMA) -> DataFrame:
    register(spark)
    reader = spark.read.format("warc").schema(columns)
    if files is not None:
        reader = reader.option("files", json.dumps(files))
    return reader.load(folder)
