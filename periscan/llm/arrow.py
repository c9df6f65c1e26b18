"""Small helpers for code that runs on Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


#: Rows of a batch between the JVM and a Python worker: the default of 10,000 whole texts takes too much memory on both sides.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have ``BATCH_ROWS`` rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def free() -> None:
    """Hand freed memory back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20, max_rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the named text column holds about ``max_bytes`` in each part, whatever its texts' lengths."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and (held + (n or 0) > max_bytes or k - start >= max_rows):
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n or 0
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(df: DataFrame, column: str, add: Callable[[list], list[pa.Array]], fields: list[pa.Field], schema: str) -> DataFrame:
    """Replace ``column`` by what ``add`` makes of its texts; the other columns pass through. ``schema``: Spark DDL of the added columns."""
    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != column]
    names = [f.name for f in df.schema.fields if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                made = add(part.column(column).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + made, names=names + [f.name for f in fields])
        free()

    return small_batches(df).mapInArrow(run, ", ".join([*keep, schema]))
