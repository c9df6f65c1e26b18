"""FITS files as a Spark data source: headers first, then the asked rows and columns of one unit."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

from periscan.sources.fits import BLOCK, CARD, data_bytes, header_at, scaled, table_layout

#: Bytes of files that a task reads, about; larger files are cut into ranges of rows.
SPLIT = 64 << 20
#: Bytes of rows decoded at a time.
CHUNK = 8 << 20
#: Bytes asked for at a time while a header's end is not found.
HEADER_BYTES = 4 * BLOCK
META = ("path", "star_id", "row")
TYPES = {"D": DoubleType(), "E": FloatType(), "K": LongType(), "J": IntegerType(), "I": ShortType(), "B": ShortType(), "L": BooleanType()}


@dataclass
class Files(InputPartition):
    """(path, part, parts) of each file: its rows are cut into ``parts`` ranges."""

    cuts: list[tuple[str, int, int]]


def _header(f, at: int, size: int) -> tuple[dict, int]:
    """The header that starts at ``at``, read block by block, and where its data start."""
    data = b""
    while at + len(data) < size:
        data += f.read_at(min(HEADER_BYTES, size - at - len(data)), at + len(data))
        if any(data[k : k + 8].rstrip() == b"END" for k in range(0, len(data), CARD)):
            head, start = header_at(data, 0)
            return head, at + start
    raise ValueError("a header has no END")


def _unit(f, size: int, first: tuple[dict, int], unit: str) -> tuple[dict, int]:
    """Header and start of data of the table ``unit``; the data of the units before it are passed over."""
    head, start = first
    while str(head.get("EXTNAME", "")).upper() != unit.upper():
        at = start + data_bytes(head)
        if at + BLOCK > size:
            raise ValueError(f"no unit named {unit}")
        head, start = _header(f, at, size)
    return head, start


def _open(path: str):
    system, where = fs.FileSystem.from_uri(path)
    return system.open_input_file(where)


class FitsReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.unit = schema, options.get("unit", "LIGHTCURVE")
        self.found, self.split = _listed(options), int(options.get("split", SPLIT))
        self.keys = {k.strip().upper() for k in options.get("keys", "").split(",") if k.strip()}
        self.permissive = options.get("mode", "failfast").lower() == "permissive"
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes over comparisons of the columns in ``keys``, and of star_id and path: files that fail them are not read past their first header."""
        names = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", StringStartsWith: "prefix", IsNotNull: "known"}
        for f in filters:
            name = f.attribute[0] if type(f) in names and len(f.attribute) == 1 else ""
            if name.upper() in self.keys or name in ("star_id", "path"):
                self.wanted.append((name, names[type(f)], f.value if isinstance(f, In) else (getattr(f, "value", None),)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Small files together, up to ``split`` bytes; larger ones in parts. No file is opened here."""
        out, held, n = [], [], 0
        for path, size in self.found:
            if size > self.split:
                parts = -(-size // self.split)
                out += [Files([(path, k, parts)]) for k in range(parts)]
                continue
            if held and n + size > self.split:
                out.append(Files(held))
                held, n = [], 0
            held.append((path, 0, 1))
            n += size
        return [*out, Files(held)] if held else out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        for path, part, parts in partition.cuts if partition else []:
            try:
                yield from self._file(path, part, parts)
            except (ValueError, KeyError, OSError) as e:
                if not self.permissive:
                    raise ValueError(f"{path}: {e}") from e
                if part == 0:
                    yield self._batch(path, 1, {}, {}, 0, str(e))

    def _file(self, path: str, part: int, parts: int) -> Iterator[pa.RecordBatch]:
        with _open(path) as f:
            size = f.size()
            head, start = _header(f, 0, size)
            if not self._keeps(path, head):
                return
            names = {x.name.upper() for x in self.schema} - {"PATH", "STAR_ID", "ERROR"} - self.keys
            if not names:
                if part == 0:
                    yield self._batch(path, 1, head, {}, 0)
                return
            own, start = _unit(f, size, (head, start), self.unit)
            layout = table_layout(own)
            width, n = int(own["NAXIS1"]), int(own["NAXIS2"])
            step = max(1, CHUNK // max(1, width))
            end = n * (part + 1) // parts
            for a in range(n * part // parts, end, step):
                b = min(end, a + step)
                rows = np.frombuffer(f.read_at((b - a) * width, start + a * width), layout.dtype)
                if len(rows) < b - a:
                    raise ValueError("the file ends within its rows")
                columns = {c: scaled(rows, c, layout) for c in names & layout.scale.keys()}
                yield self._batch(path, b - a, {**head, **{k: v for k, v in own.items() if k not in head}}, columns, a)

    def _keeps(self, path: str, head: dict) -> bool:
        for name, kind, values in self.wanted:
            got = _told(path, name, head)
            if got is None:
                return False
            if kind == "in" and got not in values or kind == "prefix" and not got.startswith(values[0]):
                return False
            if kind not in ("in", "prefix", "known") and not {"=": got == values[0], ">": got > values[0], ">=": got >= values[0], "<": got < values[0], "<=": got <= values[0]}[kind]:
                return False
        return True

    def _batch(self, path: str, n: int, head: dict, columns: dict, first: int, error: str | None = None) -> pa.RecordBatch:
        arrays = []
        for field in self.schema:
            kind, name = to_arrow_type(field.dataType), field.name
            if name.upper() in columns:
                values, missing = columns[name.upper()]
                arrays.append(pa.array(values, mask=missing).cast(kind, safe=False))
            elif name == "row":
                arrays.append(pa.array(np.arange(first, first + n), kind) if error is None else pa.nulls(n, kind))
            else:
                value = error if name == "error" else _told(path, name, head)
                value = float(value) if isinstance(field.dataType, DoubleType) and isinstance(value, bool | int | float) else value
                fits = value is None or isinstance(value, {StringType: str, DoubleType: float, LongType: int, IntegerType: int, BooleanType: bool}.get(type(field.dataType), ()))
                arrays.append(pa.array([value if fits else None] * n, kind))
        return pa.RecordBatch.from_arrays(arrays, names=[x.name for x in self.schema])


def _told(path: str, name: str, head: dict) -> object:
    if name == "path":
        return path
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0] if name == "star_id" else head.get(name.upper())


def _listed(options: dict) -> list[tuple[str, int]]:
    """(path, bytes) of the named file, of a folder's files, of those that fit a pattern in the last part of the path, or of a JSON list of files in ``paths``."""
    out = []
    for path in json.loads(options["paths"]) if "paths" in options else [options["path"]]:
        path = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
        folder, _, last = path.rpartition("/")
        pattern = last if set(last) & set("*?[") else None
        system, where = fs.FileSystem.from_uri(folder if pattern else path)
        info = system.get_file_info(where)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.type == fs.FileType.File:
            out.append((path, info.size))
            continue
        base = folder if pattern else path.rstrip("/")
        inside = [x for x in system.get_file_info(fs.FileSelector(where)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        out += sorted((f"{base}/{x.base_name}", x.size) for x in inside if pattern is None or fnmatch.fnmatch(x.base_name, pattern))
    return out


class FitsDataSource(DataSource):
    """``spark.read.format("fits")``: path, star_id (the file's name without its ending), row, and the single-value columns of a binary table.

    Options: ``path`` (a file, folder or pattern) or ``paths`` (a JSON list); ``unit``, the table's
    name (LIGHTCURVE); ``keys``, keywords of the first header that are to be columns (as doubles; logicals are 0 and 1); ``split``, bytes of a
    partition; ``mode``: failfast, or permissive (a file that can't be read is one row with its path and nothing else, but for a column ``error`` if the schema has one).

    Filters on ``keys``, star_id and path are applied to the first header, before anything else of a file is read. With an own schema
    only the columns it names are decoded; with none but path, star_id and keys, a row a file comes from its first header alone. Names
    that are no columns of the table are keywords of its headers, null where missing or of another type.
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> StructType:
        """Of the first file."""
        out = StructType().add("path", "string").add("star_id", "string").add("row", "long")
        keys = [k.strip() for k in self.options.get("keys", "").split(",") if k.strip()]
        found = _listed(self.options)
        if not found:
            raise ValueError("no files, and no schema given")
        with _open(found[0][0]) as f:
            layout = table_layout(_unit(f, f.size(), _header(f, 0, f.size()), self.options.get("unit", "LIGHTCURVE"))[0])
        for name, (times, plus, null) in layout.scale.items():
            out.add(name.lower(), TYPES[layout.code[name]] if (times, plus, null) == (1, 0, None) or layout.code[name] == "L" else DoubleType())
        for k in keys:
            out.add(k, "double")
        return out

    def reader(self, schema: StructType) -> FitsReader:
        return FitsReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark hand filters to Python sources."""
    spark.dataSource.register(FitsDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
