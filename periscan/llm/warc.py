"""WARC archives as a Python data source, and web pages stored with revisit records.

Records are compressed one by one, as the format advises, with the lengths of
the member in gzip's extra field ``sl``. A reader can so decode the headers of a
record, decide, and go on to the next without decoding a payload it does not want.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from periscan.session import few, materialize, shared_path

MANIFEST = "_manifest.json"
#: Bytes after which a writer begins another file, of a read, of the headers decoded first, and of packed data unpacked at a time.
ROLL_BYTES, READ_BYTES, HEAD_BYTES, PACKED_BYTES = 256 << 20, 1 << 20, 4096, 1 << 16
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Revisits (about 100 bytes each) that are broadcast at most, so that no payload is shuffled.
MOST_REVISITS = 1_000_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns of a record, by the header that each is read from.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "payload_length": "warc-payload-length",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_length string, refers_to string, content_type string, payload binary, path string, offset long"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with its own and its content's length in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = struct.pack("<H2sHII", 12, b"sl", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(headers: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {_line(v)}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _line(value: str) -> str:
    return " ".join(value.split())


def _head(data: bytes) -> tuple[dict[str, str], int] | None:
    """The headers at the start of ``data`` and where the block begins; None if they do not end in it."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    first, *lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def http_block(payload: bytes | None, length: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    return head + (payload or b"")


@dataclass
class WarcFile(InputPartition):
    path: str
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.want_payload = options.get("payload", "true").lower() == "true"
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over =, IN and prefix tests of header columns; they are applied before a payload is decoded."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.wanted.append((name, "in", tuple(f.value)))
            else:
                self.wanted.append((name, "prefix", (f.value,)))

    def partitions(self) -> list[WarcFile]:
        """One for each file: those of the manifest, or else all WARC files of the folder (or the one named)."""
        system, where = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(where).type == fs.FileType.File:
            return [WarcFile(self.path, system.get_file_info(where).size)]
        if system.get_file_info(f"{where}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{where}/{MANIFEST}") as f:
                return [WarcFile(f"{self.path}/{name}", size) for name, size in json.loads(f.read())]
        found = [x for x in system.get_file_info(fs.FileSelector(where)) if x.path.endswith((".warc", ".warc.gz"))]
        return [WarcFile(f"{self.path}/{x.base_name}", x.size) for x in sorted(found, key=lambda x: x.path)]

    def _keeps(self, headers: dict[str, str]) -> bool:
        for name, kind, values in self.wanted:
            got = headers.get(HEADERS[name])
            if got is None or not (got in values if kind == "in" else got.startswith(values[0])):
                return False
        return True

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        system, where = fs.FileSystem.from_uri(partition.path)
        rows: list[tuple] = []
        held = 0
        with system.open_input_file(where) as f:
            for offset, headers, payload in _records(f, partition.size, partition.path.endswith(".gz"), self._keeps, self.want_payload):
                rows.append((*(headers.get(h) for h in HEADERS.values()), payload, partition.path, offset))
                held += len(payload or b"") + 256
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * len(HEADERS) + [pa.binary(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*HEADERS, "payload", "path", "offset"])


class _Window:
    """A moving window over a file, so that small records do not cost a read each."""

    def __init__(self, f, size: int):
        self.f, self.size, self.at, self.data = f, size, 0, b""

    def get(self, offset: int, n: int) -> bytes:
        if offset < self.at or offset + n > self.at + len(self.data):
            self.at, self.data = offset, self.f.read_at(max(0, min(max(n, READ_BYTES), self.size - offset)), offset)
        return self.data[offset - self.at : offset - self.at + n]


def _records(f, size: int, packed: bool, keeps, want_payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    """Offset, headers and payload of each record that ``keeps`` its headers. Records of one gzip member share its offset."""
    window, at = _Window(f, size), 0
    while at < size:
        if not packed:
            text = _Plain(window, at)
            yield from _read_record(text, at, keeps, want_payload)
            at = text.place
            continue
        length, inner = _member_lengths(window, at)
        text = _Inflated(window, at, size)
        while not text.at_end():
            began = text.place
            head = _read_head(text, at)
            total = text.place - began + int(head["content-length"]) + 4
            if length and began == 0 and total == inner and not (want_payload and keeps(head)):
                if keeps(head):  # the member's only record, and its payload is not wanted: it stays packed
                    yield at, head, None
                break
            yield from _read_block(text, at, head, keeps, want_payload)
        at = at + length if length else text.end_of_member()


class _Plain:
    """Bytes of a file from a place on."""

    def __init__(self, window: _Window, place: int):
        self.window, self.place = window, place

    def peek(self, n: int) -> bytes:
        return self.window.get(self.place, min(n, self.window.size - self.place))

    def skip(self, n: int) -> None:
        self.place += n

    def at_end(self) -> bool:
        return self.place >= self.window.size


class _Inflated:
    """The content of a gzip member, unpacked as far as it is asked for; what has been passed is dropped."""

    def __init__(self, window: _Window, at: int, size: int):
        self.window, self.at, self.size = window, at, size
        self.packer, self.held, self.place = zlib.decompressobj(31), b"", 0

    def peek(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n and not self.packer.eof and (self.packer.unconsumed_tail or self.at < self.size):
            data = self.packer.unconsumed_tail
            if not data:
                data = self.window.get(self.at, min(PACKED_BYTES, self.size - self.at))
                if not data:
                    raise ValueError("a file is shorter than it was listed")
                self.at += len(data)
            parts.append(self.packer.decompress(data, max(n - have, 1 << 12)))
            have += len(parts[-1])
        self.held = b"".join(parts) if len(parts) > 1 else self.held
        return self.held[:n]

    def skip(self, n: int) -> None:
        self.place += n
        while n:
            if not self.peek(min(n, READ_BYTES)):
                raise ValueError("a record is cut short")
            gone = min(n, len(self.held))
            self.held, n = self.held[gone:], n - gone

    def at_end(self) -> bool:
        return not self.peek(1)

    def end_of_member(self) -> int:
        """Where the next member begins."""
        while not self.packer.eof and self.peek(READ_BYTES):
            self.held = b""
        if not self.packer.eof:
            raise ValueError("a member is cut short")
        return self.at - len(self.packer.unused_data)


def _read_head(text: _Plain | _Inflated, at: int) -> dict[str, str]:
    """The headers of the record that comes next, as few bytes as hold them; the block comes after."""
    n = HEAD_BYTES
    while (head := _head(data := text.peek(n))) is None:
        if len(data) < n:
            raise ValueError(f"record at {at} has no end of headers")
        n *= 4
    text.skip(head[1])
    return head[0]


def _read_block(text: _Plain | _Inflated, at: int, head: dict[str, str], keeps, want_payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    n, kept = int(head["content-length"]), keeps(head)
    payload = None
    if kept and want_payload:
        block = text.peek(n)
        if len(block) < n:
            raise ValueError(f"record at {at} is cut short")
        payload = _payload(head, block)
    text.skip(n)
    text.skip(len(text.peek(4)))  # the blank lines after a record
    if kept:
        yield at, head, payload


def _read_record(text: _Plain, at: int, keeps, want_payload: bool) -> Iterator[tuple[int, dict[str, str], bytes | None]]:
    yield from _read_block(text, at, _read_head(text, at), keeps, want_payload)


def _member_lengths(window: _Window, at: int) -> tuple[int, int]:
    """The lengths of a member and of its content, as its extra field has them; zeros if it doesn't."""
    head = window.get(at, min(24, window.size - at))
    if head[:4] == b"\x1f\x8b\x08\x04" and len(head) == 24:
        _, name, n, total, inner = struct.unpack_from("<H2sHII", head, 10)
        if name == b"sl" and n == 8:
            return total, inner
    return 0, 0


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP headers of a block, if it has them."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Writes a record for each row: record_type, record_id, target_uri, date, payload_digest, payload_length, refers_to, content_type, payload.

    Other columns are left out. Each attempt of a task writes files of its own; the
    manifest that the commit leaves names those that count.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.level = int(options.get("level", "6"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, where = fs.FileSystem.from_uri(self.path)
        system.create_dir(where, recursive=True)
        files, out, name, n = [], None, "", 0
        for batch in iterator:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                row = {c: x[k].as_py() for c, x in columns.items()}
                if out is None or n > ROLL_BYTES:
                    if out:
                        out.close()
                        files.append((name, n))
                    name, n = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{where}/{name}", compression=None)
                    n += out.write(member(record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row.get("date"), "Content-Type": "application/warc-fields"}, b"format: WARC file version 1.1\r\n"), self.level))
                payload, length = row.get("payload"), int(row.get("payload_length") or 0)
                revisit = row["record_type"] == "revisit"
                http = (row.get("content_type") or "").startswith("application/http")
                headers = {
                    "WARC-Type": row["record_type"],
                    "WARC-Record-ID": row["record_id"],
                    "WARC-Target-URI": row.get("target_uri"),
                    "WARC-Date": row.get("date"),
                    "WARC-Payload-Digest": row.get("payload_digest"),
                    "WARC-Payload-Length": str(length),
                    "WARC-Profile": REVISIT_PROFILE if revisit else None,
                    "WARC-Refers-To": row.get("refers_to"),
                    "Content-Type": row.get("content_type"),
                }
                block = http_block(None if revisit else payload, length) if http else (payload or b"")
                n += out.write(member(record(headers, block), self.level))
        if out:
            out.close()
            files.append((name, n))
        return Written(files)

    def commit(self, messages: list) -> None:
        system, where = fs.FileSystem.from_uri(self.path)
        system.create_dir(where, recursive=True)
        with system.open_output_stream(f"{where}/{MANIFEST}") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())

    def abort(self, messages: list) -> None:
        """Files of a failed write are in no manifest; nothing reads them."""


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("warc")`` and ``df.write.format("warc")`` known. Options: path, payload (false: leave it undecoded), level."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", least: int = REVISIT_BYTES) -> str:
    """Write a record for every row of ``pages`` (page_id, url, html) and return the archive's path.

    Of rows with equal payloads of ``least`` bytes or more, that with the largest
    page_id is a response and the others revisit it. Null html is an empty
    payload. Rows with a null id are responses, and are never referred to.
    """
    register(pages.sparkSession)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), "url", body.alias("payload")).withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("long")})
    shared = rows.where((F.col("length") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.min("page_id").alias("other")).where("first <> other").drop("other")
    # Ids and digests only: which pages revisit which.
    revisits = rows.where("length >= %d" % least).select("page_id", "digest").join(shared, "digest").where("page_id <> first").select("page_id", "digest", "first").distinct()
    revisits = few(materialize(revisits, "revisits"), MOST_REVISITS)
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    told = rows.join(revisits, ["page_id", "digest"], "left")
    revisit = F.col("first").isNotNull()
    records = told.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.col("length").alias("payload_length"),
        urn(F.col("first")).alias("refers_to"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    path = shared_path(pages.sparkSession, "warc")
    records.write.format("warc").mode("append").option("path", path).save()
    return path


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """Per page of an archive: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of responses are those of the payloads read back, and a
    payload that differs from its headers is an error; a revisit has no payload, so its headers count.
    """
    read = spark.read.format("warc").option("path", path).load().where(F.col("record_type").isin("response", "revisit"))

    def number(c: str):
        return F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")

    told = F.struct(F.col("payload_length").cast("long").alias("n"), F.regexp_replace("payload_digest", "^sha1:", "").alias("digest"))
    got = F.struct(F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest"))
    checked = read.withColumns({"told": told, "got": got}).withColumn(
        "seen", F.when(F.col("record_type") == "revisit", F.col("told")).when(F.col("got") == F.col("told"), F.col("got")).otherwise(F.raise_error(F.concat(F.lit("a payload differs from its headers: "), "record_id")))
    )
    return checked.select(number("record_id").alias("page_id"), F.col("seen.n").alias("payload_bytes"), F.col("seen.digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
