"""Token ids in binary files: length-delimited records, and flat files without an index.

Both are written by tasks into the shared folder. Each attempt of a task writes
files of its own, and only the files named in the rows that Spark commits are
ever read, so retried or doubled tasks do no harm.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periscan.llm.arrow import free, map_texts, slices, small_batches
from periscan.llm.tokenize import encoder
from periscan.session import materialize, shared_path, shuffle_partitions

#: A record is: length of the data (8 bytes), masked checksum of those 8 bytes (4), data, masked checksum of the data (4).
HEAD, TAIL = 12, 4
#: Data: flags (1 byte, bit 0: id is null), document id (8 bytes), bytes per token id (1 byte), token ids.
DATA = "<BqB"
MASK_DELTA = 0xA282EAD8
#: Bytes that a reader holds at a time, and after which a writer begins another file.
READ_BYTES, ROLL_BYTES = 4 << 20, 256 << 20
#: A file's number is that of its range of ids, followed by so many bits for its place in the range.
FILE_BITS = 24


def masked(data: bytes) -> int:
    """CRC-32 of ``data``, rotated right by 15 bits plus a constant, so that checksums of checksums stay sound."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    n = struct.pack("<Q", len(data))
    return b"".join((n, struct.pack("<I", masked(n)), data, struct.pack("<I", masked(data))))


def unframe(held: bytes | memoryview, at: int, path: str) -> tuple[bytes, int] | None:
    """The data of the record at ``at`` and the position after it; None if ``held`` ends before that."""
    if at + HEAD > len(held):
        return None
    n, check = struct.unpack_from("<QI", held, at)
    if masked(bytes(held[at : at + 8])) != check:
        raise ValueError(f"{path}: length at {at} is damaged")
    end = at + HEAD + n + TAIL
    if end > len(held):
        return None
    data = bytes(held[at + HEAD : end - TAIL])
    if masked(data) != struct.unpack_from("<I", held, end - TAIL)[0]:
        raise ValueError(f"{path}: data at {at} are damaged")
    return data, end


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def packed_ids(texts: list[str | None], tokenizer: str, end_id: int, plain: bool = False) -> tuple[list[bytes], int]:
    """The ids of each whole text and the end id, as unsigned integers of the returned width: 16 bits if the vocabulary fits them, else 32."""
    enc = encoder(tokenizer, plain)
    end = np.array([end_id], "<u4").tobytes()
    wide = max(enc.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
    raw = (x + end for x in enc.encode(texts))
    return [x if wide else np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in raw], 4 if wide else 2


def encode_documents(texts: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Replaces ``text`` by packed ids and their width."""

    def add(texts: list) -> list[pa.Array]:
        ids, width = packed_ids(texts, tokenizer, end_id)
        return [pa.array(ids, pa.binary()), pa.array([width] * len(texts), pa.int32())]

    return map_texts(texts, "text", add, [pa.field("ids", pa.binary()), pa.field("width", pa.int32())], "ids binary, width int")


def id_ranges(docs: DataFrame, id_col: str, n: int) -> DataFrame:
    """Adds ``bucket``: ranges of ascending id of about equal counts, null ids in the first. The bounds are ``n`` - 1 numbers."""
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [(k + 1) / n for k in range(n - 1)], 10_000).alias("c")).first()["c"] if n > 1 else []
    bounds = sorted({int(c) for c in cuts or []})
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(id_col))) if bounds else F.lit(0)
    return docs.withColumn("bucket", F.coalesce(F.when(F.col(id_col).isNotNull(), at), F.lit(0)).cast("int"))


def write_records(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", n_files: int | None = None) -> DataFrame:
    """Encode whole texts and write them as framed records in ascending id order.

    Returns the offset index, a Parquet table beside the files with a row for
    each record: doc_id, file (in ascending order), path, ordinal,
    offset and length in bytes, n_tokens. A shuffled reader takes any rows of it
    and reads just those ranges (:func:`read_at`). Null ids come first; null and
    empty texts are records of the end id alone; equal ids are kept, in any order.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "records")
    buckets = n_files or shuffle_partitions(spark)
    base = id_ranges(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", buckets)
    coded = encode_documents(base, tokenizer, end_id)
    placed = coded.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, bucket, file, path, at, ordinal = None, None, 0, "", 0, 0
        system, where = store(folder)
        for batch in batches:
            rows = []
            for b, i, ids, width in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids", "width")), strict=True):
                if b != bucket or at > ROLL_BYTES:
                    if out:
                        out.close()
                    file = file + 1 if b == bucket else b << FILE_BITS
                    system.create_dir(where, recursive=True)
                    name = f"part-{file:016d}-{uuid.uuid4().hex[:12]}.rec"
                    out, bucket, path, at, ordinal = system.open_output_stream(f"{where}/{name}", compression=None), b, f"{folder}/{name}", 0, 0
                record = frame(struct.pack(DATA, i is None, i or 0, width) + ids)
                out.write(record)
                rows.append((i, file, path, ordinal, at, len(record), len(ids) // width))
                at, ordinal = at + len(record), ordinal + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), INDEX_TYPES, strict=True)] if rows else [pa.array([], t) for t in INDEX_TYPES], names=INDEX_NAMES)
        if out:
            out.close()

    return materialize(placed.mapInArrow(write, INDEX), "records-index")


INDEX = "doc_id long, file long, path string, ordinal long, offset long, length long, n_tokens long"
INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]
INDEX_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _decode(data: bytes) -> tuple[int | None, np.ndarray]:
    null, i, width = struct.unpack_from(DATA, data)
    return (None if null else i), np.frombuffer(data, f"<u{width}", offset=struct.calcsize(DATA)).astype("<u4")


def read_records(index: DataFrame) -> DataFrame:
    """Read the files named in the index from front to back, checking every record.

    Returns a row for each record: doc_id, file, start (ids before it in its
    own file), n_tokens and ids_crc32 (of the ids as little-endian 32-bit
    integers). Each file is one unit of work and held a few MB at a time.
    """
    files = index.groupBy("file", "path").agg(F.sum("length").alias("size"))
    n = shuffle_partitions(index.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist(), strict=True):
                system, where = store(path)
                start, rows, held, at = 0, [], b"", 0
                with system.open_input_stream(where) as f:
                    while True:
                        got = unframe(held, at, path)
                        if got is None:
                            more = f.read(max(READ_BYTES, len(held) - at))
                            if not more:
                                if at != len(held):
                                    raise ValueError(f"{path} ends within a record")
                                break
                            held, at = held[at:] + more, 0
                            continue
                        data, at = got
                        i, ids = _decode(data)
                        rows.append((i, number, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) >= 8192:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5, strict=True)], names=["doc_id", "file", "start", "n_tokens", "ids_crc32"])

    return files.repartitionById(n, ((F.shiftright("file", FILE_BITS) + F.col("file") % (1 << FILE_BITS)) % n).cast("int")).select("file", "path").mapInArrow(read, "doc_id long, file long, start long, n_tokens long, ids_crc32 long")


def read_at(index: DataFrame) -> DataFrame:
    """Read just the records that the given index rows name, in their order: (doc_id, ids)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, path_open = None, None
        for batch in batches:
            for part in slices(batch, "path", max_rows=256):
                rows = []
                for path, offset, length in zip(*(part.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                    if path != path_open:
                        system, where = store(path)
                        opened, path_open = system.open_input_file(where), path
                    got = unframe(opened.read_at(length, offset), 0, path)
                    if got is None:
                        raise ValueError(f"{path} ends within a record")
                    rows.append(_decode(got[0]))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tolist() for r in rows], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return index.select("path", "offset", "length").mapInArrow(read, "doc_id long, ids array<long>")


def record_digests(index: DataFrame) -> DataFrame:
    """Per record: doc_id, start (ids of all records before it, over all files), n_tokens, ids_crc32."""
    # One row for each file: their number is that of the write's partitions, so the unpartitioned window and the broadcast stay small.
    per_file = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = per_file.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return read_records(index).join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def write_flat(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write flat token files: nothing but ids, each document followed by the end-of-document id. Added tokens in texts count as ordinary text, so that the end id is a separator only.

    Returns which document went where: doc_id, path, ordinal, width (bytes per id).
    """
    folder = shared_path(docs.sparkSession, "flat")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = store(folder)
        out, path, ordinal = None, "", 0
        for batch in batches:
            for part in slices(batch, "text"):
                if out is None:
                    system.create_dir(where, recursive=True)
                    name = f"{uuid.uuid4().hex}-{os.getpid()}.bin"
                    out, path = system.open_output_stream(f"{where}/{name}", compression=None), f"{folder}/{name}"
                ids, width = packed_ids(part.column("text").to_pylist(), tokenizer, end_id, plain=True)
                for x in ids:
                    out.write(x)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([path] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64()), pa.array([width] * n, pa.int32())], names=["doc_id", "path", "ordinal", "width"])
                ordinal += n
        if out:
            out.close()
        free()

    return materialize(small_batches(texts).mapInArrow(write, "doc_id long, path string, ordinal long, width int"), "flat-map")
