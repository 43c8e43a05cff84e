"""WARC archives as a Spark data source, and payload deduplication by revisit records.

Reading (``spark.read.format("warc").load(folder)``).  The driver lists files and plans one partition per file.
Filters on record type and header columns are taken over by the reader: a record's headers are parsed first and a
record that fails is skipped without decoding its block.  Plain files are skipped by Content-Length.  Members of
compressed files that carry the format's skip lengths (gzip extra field ``sl``; all that are written here) are
skipped by seeking; others are inflated to their end.  ``option("payload", "false")`` skips every block.

Writing (``df.write.format("warc")``).  Tasks write files under names of their own attempt; the commit writes a
manifest of those that count, and a folder with a manifest is read by it, so lost attempts are never read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage,
)

from trellis.llm.files import open_folder
from trellis.llm.shipping import ship
from trellis.session import stage, staging_root

#: Bytes after which a new file is begun, and bytes of a record read to find its headers.
FILE_BYTES, HEAD_BYTES = 128 << 20, 16 << 10
LEVEL = 1
MANIFEST = "manifest.json"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Column of each pushed header.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
ARROW = pa.schema([*((name, pa.string()) for name in HEADERS), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


# ---- records ----------------------------------------------------------------------------------

def _field(name: str, value) -> str:
    clean = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value))
    return f"{name}: {clean}\r\n"


def record(row: dict, date: str) -> bytes:
    """One record.  A revisit has the HTTP headers of the full payload, but no payload."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http if row["record_type"] == "revisit" else http + payload
    head = "WARC/1.1\r\n" + _field("WARC-Type", row["record_type"]) + _field("WARC-Record-ID", f"<{row['record_id']}>") + _field("WARC-Date", date)
    if row["target_uri"] is not None:
        head += _field("WARC-Target-URI", row["target_uri"])
    if row["payload_digest"] is not None:
        head += _field("WARC-Payload-Digest", f"sha1:{row['payload_digest']}")
    if row["record_type"] == "revisit":
        head += _field("WARC-Refers-To", f"<{row['refers_to']}>") + _field("WARC-Profile", REVISIT_PROFILE)
    head += _field("Content-Type", "application/http; msgtype=response") + _field("Content-Length", len(block))
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with its skip lengths."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    head = struct.pack("<4BI2BH", 31, 139, 8, 4, 0, 0, 255, len(extra))
    return head + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(data: bytes) -> tuple[dict[str, str], int] | None:
    """Headers by lower-case name and where the block begins; None if they are not complete."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (line.partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}, end + 4


def _columns(headers: dict[str, str]) -> dict:
    row = {column: headers.get(name) for column, name in HEADERS.items()}
    for name in ("record_id", "refers_to"):
        row[name] = row[name] and row[name].strip("<>")
    row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
    return row


def _payload(block: bytes) -> tuple[int, bytes]:
    """Length that the HTTP headers state, and what follows them."""
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return len(block), block
    body = block[end + 4 :]
    for line in block[:end].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value), body
    return len(body), body


class Archive:
    """Records of one file, plain or compressed, in order."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def records(self, wanted, blocks: bool) -> Iterator[dict]:
        """Columns of the records that ``wanted`` accepts; their payload only if ``blocks``."""
        at = 0
        while at < self.size:
            start = self.file.read_at(2, at)
            at, found = (self._member if start == b"\x1f\x8b" else self._plain)(at, wanted, blocks)
            if found is not None:
                yield found

    def _row(self, headers: dict, block: bytes, blocks: bool) -> dict:
        row = _columns(headers)
        row["payload_bytes"], body = _payload(block)
        row["payload"] = body if blocks and row["record_type"] != "revisit" else None
        return row

    def _plain(self, at: int, wanted, blocks: bool):
        size = HEAD_BYTES
        while (parsed := parse_headers(self.file.read_at(size, at))) is None:
            if at + size >= self.size:
                raise ValueError("a record's headers do not end")
            size *= 2
        headers, begin = parsed
        length = int(headers["content-length"])
        end = at + begin + length + 4
        if not wanted(_columns(headers)):
            return end, None
        block = self.file.read_at(length if blocks else min(length, HEAD_BYTES), at + begin)
        return end, self._row(headers, block, blocks)

    def _member(self, at: int, wanted, blocks: bool):
        head = self.file.read_at(HEAD_BYTES, at)
        skip = None
        if head[3] & 4:
            (length,) = struct.unpack_from("<H", head, 10)
            extra = head[12 : 12 + length]
            if extra[:2] == b"sl":
                skip = struct.unpack_from("<I", extra, 4)[0] or None
        inflate, used, data, parsed, keep = zlib.decompressobj(31), 0, b"", None, True
        while True:
            chunk = self.file.read_at(HEAD_BYTES, at + used) if used else head
            if not chunk:
                raise ValueError("a compressed record does not end")
            used += len(chunk)
            data += inflate.decompress(chunk)
            if parsed is None and (parsed := parse_headers(data)) is not None:
                keep = wanted(_columns(parsed[0]))
                if skip and not keep:
                    return at + skip, None
            if parsed is not None and keep and not blocks and skip and len(data) >= parsed[1] + min(int(parsed[0]["content-length"]), 1024):
                return at + skip, self._row(parsed[0], data[parsed[1] :], False)
            if not keep:
                data = b""
            if inflate.eof:
                break
        end = at + used - len(inflate.unused_data)
        if not keep or parsed is None:
            return end, None
        headers, begin = parsed
        return end, self._row(headers, data[begin : begin + int(headers["content-length"])], blocks)


# ---- data source ------------------------------------------------------------------------------

@dataclass
class FilePartition(InputPartition):
    file: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.blocks = options["path"], options.get("payload", "true") != "false"
        self.equal: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        """Takes over equality and membership of header columns; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and name in HEADERS:
                values = {f.value}
            elif isinstance(f, In) and name in HEADERS:
                values = set(f.value)
            else:
                yield f
                continue
            old = self.equal.get(name)
            self.equal[name] = values & old if old else values
            if old and not self.equal[name]:
                self.equal[name] = {None}

    def partitions(self) -> list[InputPartition]:
        fs, base = open_folder(self.folder)
        if fs.get_file_info(f"{base}/{MANIFEST}").type != pyarrow.fs.FileType.NotFound:
            with fs.open_input_file(f"{base}/{MANIFEST}") as f:
                names = json.loads(f.read())
        else:
            names = sorted(i.base_name for i in fs.get_file_info(pyarrow.fs.FileSelector(base)) if i.base_name.endswith((".warc", ".warc.gz")))
        return [FilePartition(name) for name in names]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        tests = [(name, values) for name, values in self.equal.items() if values]
        fs, base = open_folder(self.folder)
        rows, size = [], 0
        with fs.open_input_file(f"{base}/{partition.file}") as file:
            for row in Archive(file).records(lambda r: all(r[name] in values and r[name] is not None for name, values in tests), self.blocks):
                rows.append(row)
                size += len(row["payload"] or b"") + 200
                if size >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.date = options["path"], options.get("date", "2024-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = open_folder(self.folder)
        fs.create_dir(base, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                data = member(record(row, self.date))
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, base = open_folder(self.folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps(sorted(name for m in messages if m for name in m.files)).encode())

    def abort(self, messages: list) -> None:
        fs, base = open_folder(self.folder)
        for name in (name for m in messages if m for name in m.files):
            fs.delete_file(f"{base}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# ---- pages to archives and back -----------------------------------------------------------------

def write_pages(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 1000) -> None:
    """One record per row below ``folder``; equal payloads of at least ``min_bytes`` are stored once, with the largest id.

    Null payloads are empty.  Rows that repeat an id are written as often as they stand; those without an id are
    responses and never referred to.  Other columns are ignored; an empty table gives an archive without files.
    The digests of all payloads combine before they are shuffled, and payloads themselves move once, by page.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    picked = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("target_uri"), payload.alias("payload"),
        F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    digests = stage(picked.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest"))
    owners = digests.groupBy("payload_digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = digests.join(owners, "payload_digest").where("page_id < owner").select("page_id", "payload_digest", "owner").distinct()
    joined = picked.join(revisits, ["page_id", "payload_digest"], "left")
    uri = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    revisit = F.col("owner").isNotNull()
    records = joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), uri("page_id").alias("record_id"), "target_uri",
        F.when(revisit, uri("owner")).alias("refers_to"), "payload_digest", "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").save(folder)


def read_pages(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record.

    Responses are measured on the payloads read; revisits state the length and digest of theirs.
    """
    register(spark)
    number = lambda c: F.nullif(F.regexp_replace(c, "^urn:page:", ""), F.lit("")).cast(id_type)
    return spark.read.format("warc").load(folder).select(
        number(F.col("record_id")).alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"),
        "record_type", number(F.col("refers_to")).alias("refers_to"),
    )


def archive_folder(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/warc-{uuid.uuid4().hex}"
