"""Vectors of whole numbers: scaling, exact products in tasks, and query sets that go to the tasks in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a block of queries that is broadcast, as doubles.
BLOCK_BYTES = 8 << 20
LONGEST = np.iinfo(np.int64).max


def scaled(vector: Column, scale: int) -> Column:
    """floor(``scale`` * x) of every component x, in double precision, as longs."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale))


def in_range(vector: Column, scale: int) -> Column:
    """The vector is there, and each component times ``scale`` is a number whose floor fits a long with room to spare (2^62)."""
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float(1 << 62), F.lit(False)))
    return vector.isNotNull() & fits


def one_per_id(rows: DataFrame, *keep: str) -> DataFrame:
    """(id, v, ``keep``) with one row for each id, the one with the least vector, then the least of ``keep``. Repeats are combined before they travel."""
    least = rows.groupBy("id").agg(F.min(F.struct("v", *keep)).alias("r"))
    return least.select("id", "r.v", *(f"r.{c}" for c in keep))


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """A list column of longs as rows of ``d``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), d)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two matrices of longs, exactly.

    float64 where no sum can reach 2^53, else int64; a product beyond a long comes back as the nearest long.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    bound = float(np.abs(a).sum(1, dtype=np.float64).max()) * float(np.abs(b).max())
    if bound < 1 << 53:
        return a.astype(np.float64) @ b.T.astype(np.float64)
    if bound < 1 << 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -LONGEST, LONGEST).astype(np.int64)


def firsts(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, group))
    held = group[order]
    return order[np.arange(len(held)) - np.searchsorted(held, held) < k]


def query_blocks(queries: DataFrame, *more: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """(vector length, rows) of a written table (id, v, ``more``) with distinct ids, one block after the other.

    A block holds about ``block_bytes`` of vectors, whatever the number of queries:
    ids are dealt by a hash, and are distinct. Lengths are told apart, as only equal ones are compared.
    """
    sizes = queries.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()  # a row for each length
    for d, n in sizes:
        parts = -(-n // max(1, block_bytes // (8 * max(1, d))))
        for part in range(parts):
            mine = (F.size("v") == d) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
            block = queries.where(mine).select("id", "v", *more).toArrow().sort_by("id")
            if block.num_rows:
                yield d, block
