"""FITS files as tables: light curves, one file to a task, and keywords of first headers. Larger files and other tables: :mod:`periscan.sources.fits_table`."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, CARD = 2880, 80
#: Column codes of binary tables that are read, as big-endian numpy types.
CODES = {"D": ">f8", "E": ">f4", "K": ">i8", "J": ">i4", "I": ">i2", "B": "u1", "L": "S1"}


def _value(text: str) -> object:
    """The value in a card's field: string, logical, number, or None."""
    text = text.strip()
    if text.startswith("'"):
        end = 1
        while (end := text.find("'", end)) >= 0 and text[end : end + 2] == "''":
            end += 2
        return text[1 : end if end >= 0 else None].replace("''", "'").rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F", ""):
        return None if text == "" else text == "T"
    try:
        return int(text)
    except ValueError:
        return float(text.replace("D", "E"))


def header_at(data: bytes, at: int) -> tuple[dict, int]:
    """The keywords of the header that starts at ``at``, and where its data start."""
    found: dict[str, object] = {}
    for k in range(at, len(data) - CARD + 1, CARD):
        card = data[k : k + CARD].decode("ascii", "replace")
        name = card[:8].rstrip()
        if name == "END":
            return found, at + -(-(k + CARD - at) // BLOCK) * BLOCK
        if card[8:10] == "= ":
            found.setdefault(name, _value(card[10:]))
    raise ValueError("a header has no END")


def data_bytes(head: dict) -> int:
    """Bytes from the end of a unit's header to the next unit."""
    count = 0
    if int(head.get("NAXIS") or 0):
        count = 1
        for k in range(int(head["NAXIS"])):
            count *= int(head[f"NAXIS{k + 1}"])
    size = abs(int(head.get("BITPIX") or 8)) // 8 * int(head.get("GCOUNT") or 1) * (int(head.get("PCOUNT") or 0) + count)
    return -(-size // BLOCK) * BLOCK


def units(data: bytes) -> Iterator[tuple[dict, int]]:
    """Header and start of data of each unit of a file."""
    at = 0
    while at + BLOCK <= len(data):
        head, start = header_at(data, at)
        yield head, start
        at = start + data_bytes(head)


@dataclass
class Layout:
    """A binary table's rows as a numpy type, and scale, zero and null value and code of each single-value column."""

    dtype: np.dtype
    scale: dict[str, tuple]
    code: dict[str, str]


def table_layout(head: dict) -> Layout:
    fields, scale, codes = [], {}, {}
    for k in range(1, int(head["TFIELDS"]) + 1):
        form = str(head[f"TFORM{k}"]).strip()
        digits = len(form) - len(form.lstrip("0123456789"))
        count, code = int(form[:digits] or 1), form[digits]
        name = str(head.get(f"TTYPE{k}", f"col{k}")).upper()
        single = count == 1 and code in CODES
        width = {"A": 1, "X": 0.125, "C": 8, "M": 16, "P": 8, "Q": 16}.get(code) or np.dtype(CODES[code]).itemsize
        fields.append((name, CODES[code] if single else f"V{int(-(-count * width // 1))}"))
        if single:
            scale[name] = (head.get(f"TSCAL{k}") or 1, head.get(f"TZERO{k}") or 0, head.get(f"TNULL{k}"))
            codes[name] = code
    return Layout(np.dtype(fields), scale, codes)


def scaled(rows: np.ndarray, name: str, layout: Layout) -> tuple[np.ndarray, np.ndarray | None]:
    """A column's values, and where it holds the null value of integers; numbers with a scale become doubles, logicals T and F."""
    raw, (times, plus, null) = rows[name], layout.scale[name]
    if layout.code[name] == "L":
        return raw == b"T", ~np.isin(raw, (b"T", b"F"))
    missing = raw == null if null is not None and raw.dtype.kind in "iu" else None
    values = raw.astype(raw.dtype.newbyteorder("=")) if (times, plus) == (1, 0) else raw.astype("f8") * times + plus
    return values.astype("i2") if values.dtype == np.uint8 else values, missing


def table_columns(data: bytes, unit: str, wanted: list[str]) -> dict[str, np.ndarray]:
    """The named single-value columns of the binary table ``unit`` as doubles; scaling and null integers are applied."""
    for head, start in units(data):
        if str(head.get("EXTNAME", "")).upper() == unit.upper():
            layout = table_layout(head)
            rows = np.frombuffer(data, layout.dtype, count=int(head["NAXIS2"]), offset=start)
            out = {}
            for name in wanted:
                values, missing = scaled(rows, name.upper(), layout)
                out[name] = values.astype("f8") if missing is None else np.where(missing, np.nan, values)
            return out
    raise ValueError(f"no unit named {unit}")


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def light_curves(spark: SparkSession, paths: str | list[str], unit: str = "LIGHTCURVE", centre: float = 1.0) -> DataFrame:
    """(star_id, i, time, flux, error) of every file; star_id is the file's name without its ending.

    The flux is shifted by ``centre``; values that are not finite are null. A file that can't be read is one row with an error.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                star = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    got = table_columns(content, unit, ["time", "flux"])
                    n = len(got["time"])
                    yield pd.DataFrame({"star_id": star, "i": np.arange(n), "time": got["time"], "flux": got["flux"] - centre, "error": pd.Series([None] * n, dtype=object)})
                except (ValueError, KeyError) as e:
                    yield pd.DataFrame({"star_id": [star], "i": pd.Series([None], dtype="Int64"), "time": [np.nan], "flux": [np.nan], "error": [str(e)]})

    out = _files(spark, paths).mapInPandas(read, "star_id string, i long, time double, flux double, error string")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    return out.withColumns({"time": finite("time"), "flux": finite("flux")})


def headers(spark: SparkSession, paths: str | list[str], keys: list[str]) -> DataFrame:
    """A row for each file: star_id and the numbers under ``keys`` in its first header (logicals as 0 and 1), null where missing. Nothing else of a file is read."""
    from periscan.sources.fits_table import register

    register(spark)
    schema = ", ".join(["star_id string", *(f"`{k}` double" for k in keys)])
    names = json.dumps([paths] if isinstance(paths, str) else list(paths))
    return spark.read.format("fits").schema(schema).options(paths=names, keys=",".join(keys), mode="permissive").load()
