"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions from the list of files (files are packed up to ``split_bytes``), takes
equality, IN and prefix predicates on the record type and on headers before anything else, inflates
a record only as far as its headers, and goes on to the payload of the records that pass, and only if
the ``payload`` option asks for it (``read``; ``verify`` checks digests and returns none; ``skip``).
Compressed records carry their length in the gzip header (the ``sl`` field), so the rest is a seek;
records of other writers, without that field, are inflated through without being kept.

Writing gives each task its own files under hidden names, which the driver renames when all
tasks are done, so a lost executor or a repeated task leaves nothing half-written in sight.  Files
are opened through ``pyarrow.fs``, which serves the same stores on every machine.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = ("record_id string, record_type string, target_uri string, payload_digest string, refers_to string, "
          "payload_length long, payload binary")
ARROW = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to")]
                  + [("payload_length", pa.int64()), ("payload", pa.binary())])
# fixed values: header names of the format, by column
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
           "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"
FIRST_READ = 4096
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(record_type: str, record_id: str, uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """One record; a revisit keeps the length and digest of the payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {one_line(uri)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if record_type == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def member(data: bytes, level: int) -> bytes:
    """A gzip member whose header tells its compressed and plain lengths."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    lengths = struct.pack("<2sHII", b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(lengths)) + lengths + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class Packed:
    """Records of a gzip file, one member each."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at = file, file.size(), 0

    def head(self) -> dict[str, str] | None:
        if self.at >= self.size:
            return None
        self.file.seek(self.at)
        start = self.file.read(FIRST_READ)
        self.length = None
        if start[3] & 4:
            extra = start[12: 12 + struct.unpack_from("<H", start, 10)[0]]
            if extra[:2] == b"sl" and len(extra) >= 12 and 0 < struct.unpack_from("<I", extra, 4)[0]:
                self.length = struct.unpack_from("<I", extra, 4)[0]
        self.inflate, self.data, self.rest = zlib.decompressobj(31), bytearray(), start
        while END not in self.data and not self.inflate.eof:
            self._more(FIRST_READ)
        head, _, tail = bytes(self.data).partition(END)
        self.data = bytearray(tail)
        return parsed(head)

    def _more(self, most: int) -> None:
        if not self.rest:
            self.rest = self.file.read(1 << 16)
            if not self.rest:
                raise ValueError("a record is cut short")
        self.data += self.inflate.decompress(self.rest, most)
        self.rest = b"" if self.inflate.eof else self.inflate.unconsumed_tail

    def block(self, length: int) -> bytes:
        while not self.inflate.eof:
            self._more(1 << 20)
        self.at = self.file.tell() - len(self.inflate.unused_data)
        return bytes(self.data[:length])

    def skip(self, length: int) -> None:
        if self.length:
            self.at += self.length
            return
        while not self.inflate.eof:
            self.data.clear()
            self._more(1 << 20)
        self.at = self.file.tell() - len(self.inflate.unused_data)


class Plain:
    """Records of an uncompressed file."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at = file, file.size(), 0

    def head(self) -> dict[str, str] | None:
        if self.at >= self.size:
            return None
        self.file.seek(self.at)
        data = self.file.read(FIRST_READ)
        while END not in data:
            more = self.file.read(FIRST_READ)
            if not more:
                raise ValueError("a record is cut short")
            data += more
        self.begin = self.at + data.index(END) + len(END)
        return parsed(data[: data.index(END)])

    def block(self, length: int) -> bytes:
        self.file.seek(self.begin)
        self.skip(length)
        return self.file.read(length)

    def skip(self, length: int) -> None:
        self.at = self.begin + length + len(END)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "read")
        if self.payload not in ("read", "verify", "skip"):
            raise ValueError(f"payload is read, verify or skip, not {self.payload}")
        self.split_bytes = int(options.get("split_bytes", 16 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, place = opened(self.path)
        found = sorted((i.path, i.size) for i in store.get_file_info(fs.FileSelector(place, allow_not_found=True))
                       if i.type == fs.FileType.File and i.base_name[0] not in "._"
                       and i.base_name.endswith((".warc", ".warc.gz")))
        bins, room = [[]], self.split_bytes
        for path, size in found:
            if bins[-1] and size > room:
                bins.append([])
                room = self.split_bytes
            bins[-1].append(path)
            room -= size
        return [Files(tuple(b)) for b in bins]

    def passes(self, row: dict) -> bool:
        return all(row[n] is not None and (row[n] in v if how == "in" else row[n].startswith(v))
                   for n, how, v in self.tests)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                records = Packed(file) if path.endswith(".gz") else Plain(file)
                while (headers := records.head()) is not None:
                    length = int(headers.get("content-length", 0))
                    row = {c: headers.get(h) for c, h in HEADERS.items()}
                    for c in ("record_id", "refers_to"):
                        row[c] = row[c].strip("<>") if row[c] else None
                    if row["payload_digest"]:
                        row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
                    if not self.passes(row):
                        records.skip(length)
                        continue
                    revisit = row["record_type"] == "revisit"
                    if self.payload == "skip" and not revisit:
                        records.skip(length)
                        row |= {"payload_length": None, "payload": None}
                    else:
                        row |= self.payload_of(records.block(length), headers, row, revisit)
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def payload_of(self, block: bytes, headers: dict[str, str], row: dict, revisit: bool) -> dict:
        body, length = block, None
        if headers.get("content-type", "").startswith("application/http"):
            head, _, body = block.partition(END)
            length = parsed(head).get("content-length")
        if revisit:
            return {"payload_length": int(length) if length else None, "payload": None}
        if self.payload == "verify" and row["payload_digest"] not in (None, digest(body)):
            raise ValueError(f"the payload of {row['record_id']} does not have the digest of its header")
        return {"payload_length": len(body), "payload": body if self.payload == "read" else None}


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_id, record_type, target_uri, refers_to and payload (text or binary)."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.level = int(options.get("level", 1))
        self.packed = options.get("compression", "gzip") == "gzip"
        self.roll_bytes = int(options.get("roll_bytes", 64 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, place = opened(self.path)
        store.create_dir(place, recursive=True)
        names, out = [], None
        for batch in iterator:
            columns = [batch.column(n) for n in ("record_id", "record_type", "target_uri", "refers_to", "payload")]
            for i in range(batch.num_rows):
                record_id, kind, uri, refers_to, payload = (c[i].as_py() for c in columns)
                payload = payload.encode() if isinstance(payload, str) else payload or b""
                data = record(kind, record_id, uri, refers_to, payload)
                if out is None:
                    names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                    out, used = store.open_output_stream(f"{place}/.{names[-1]}", compression=None), 0
                data = member(data, self.level) if self.packed else data
                out.write(data)
                used += len(data)
                if used >= self.roll_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, place = opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{place}/.{name}", f"{place}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, place = opened(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{place}/.{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
