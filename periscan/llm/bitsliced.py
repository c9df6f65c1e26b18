"""Exact search for the largest inner products by a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periscan.llm.integers import BLOCK_BYTES, firsts, in_range, matrix, one_per_id, products, query_blocks, scaled
from periscan.session import Scratch, shared_path

#: Rows of a block of the index, about. Bytes of slices bound it for long vectors.
BLOCK_ROWS, SLICE_BYTES = 16_384, 16 << 20
#: Low bits of every component that are left out of the sums; rows on the boundary are told apart by their whole values.
COARSE = 2
INDEX = "d int, bits int, ids binary, low binary, slices binary"
RESULT = "query_id long, rank int, vec_id long, score long"


class Slices:
    """One block: for every component and bit, a bitmap over the rows of what the value exceeds the component's least by."""

    def __init__(self, n: int, low: np.ndarray, bits: np.ndarray):
        self.n, self.low, self.bits = n, low, bits  # bits: (bit, component, 64 rows a word)
        widths = bits.any(2) * np.arange(1, len(bits) + 1)[:, None] if bits.size else np.zeros((1, len(low)), np.int64)
        #: Bits that each component needs in this block.
        self.widths = widths.max(0)
        self.alive = np.packbits(np.arange(-(-n // 64) * 64) < n, bitorder="little").view(np.uint64)
        d = bits.shape[1]
        flat = bits[COARSE:].reshape(-1, bits.shape[2])
        #: Slices of the coarse values, followed by their complements.
        self.both = np.concatenate([flat, ~flat])
        kept = np.maximum(self.widths - COARSE, 0)
        self.bit, self.of = np.nonzero(np.arange(len(flat) // max(1, d))[:, None] < kept)  # those in use
        self.place = self.bit * d + self.of
        #: The places in use of one component after the other, and where each one's start.
        self.by_component = np.argsort(self.of, kind="stable")
        self.start = np.searchsorted(self.of[self.by_component], np.arange(d + 1))

    @classmethod
    def of_rows(cls, v: np.ndarray) -> Slices:
        low = v.min(0)
        above = v - low
        width = int(above.max(initial=0)).bit_length()
        words = -(-len(v) // 64)
        bits = np.zeros((width, v.shape[1], words * 8), np.uint8)
        for b in range(width):
            packed = np.packbits(((above >> b) & 1).astype(bool), axis=0, bitorder="little")
            bits[b, :, : len(packed)] = packed.T
        return cls(len(v), low, bits.view(np.uint64))

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The whole values of some rows, read off all slices."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.repeat(self.low[None], len(at), axis=0)
        for b in range(len(self.bits)):
            out += (((self.bits[b][:, word] >> shift) & np.uint64(1)).astype(np.int64) << b).T
        return out

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the sum of the coarse values times ``q``, up to a constant that is the same for all rows.

        A weight is written with the digits -1, 0 and 1, of which no two
        neighbours differ from 0. Each digit shifts the component's slices; a -1 takes their complements
        instead, which differ from the negative by a constant. Slices of one place are added three to two
        by full adders, all groups of three at once, and carries go to the place above.
        """
        digit, component, sign = digits(q)
        # Every digit of a component meets every slice of it
        each = self.start[component + 1] - self.start[component]
        which = self.by_component[np.repeat(self.start[component] - np.cumsum(each) + each, each) + np.arange(each.sum())]
        place = np.repeat(digit, each) + self.bit[which]
        source = self.place[which] + np.repeat(sign < 0, each) * (len(self.both) // 2)
        order = np.argsort(place, kind="stable")
        place, source = place[order], source[order]
        out, carried, k = [], [], 0
        bounds = np.searchsorted(place, np.arange(place.max(initial=-1) + 2))
        while k < len(bounds) - 1 or carried:
            pile = [self.both[source[bounds[k] : bounds[k + 1]]]] if k < len(bounds) - 1 else []
            stack = np.concatenate([*pile, *carried]) if carried else pile[0]
            carried = []
            while len(stack) > 2:
                m = len(stack) // 3
                a, b, c, rest = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m], stack[3 * m :]
                x = a ^ b
                carried.append((a & b) | (x & c))
                stack = np.concatenate([x ^ c, rest]) if len(rest) else x ^ c
            if len(stack) == 2:
                carried.append((stack[0] & stack[1])[None])
                out.append(stack[0] ^ stack[1])
            else:
                out.append(stack[0] if len(stack) else np.zeros_like(self.alive))
            k += 1
        return out

    def at_least(self, slices: list[np.ndarray], k: int, slack: int) -> np.ndarray:
        """Rows whose sum is no more than ``slack`` below the k-th largest."""
        sure, tied = np.zeros_like(self.alive), self.alive
        kth = 0
        for s in reversed(slices):  # from the most significant slice downward
            with_bit = tied & s
            kth <<= 1
            if int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(with_bit).sum()) >= k:
                tied = with_bit
                kth |= 1
            else:
                sure, tied = sure | with_bit, tied & ~s
        least = kth - slack if self.n >= k else 0
        if least <= 0:
            return np.arange(self.n)
        more, equal = np.zeros_like(self.alive), self.alive
        for b in reversed(range(len(slices))):
            if least >> b & 1:
                equal = equal & slices[b]
            else:
                more, equal = more | (equal & slices[b]), equal & ~slices[b]
        return np.flatnonzero(np.unpackbits((more | equal).view(np.uint8), bitorder="little"))

    def best(self, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact products of the ``k`` rows with the largest, ties to smaller ids."""
        # What the low bits can add to or take from a sum, in units of the coarse values.
        loose = sum(abs(x) * ((1 << min(COARSE, w)) - 1) for x, w in zip(q.tolist(), self.widths.tolist(), strict=True))
        rows = self.at_least(self.sums(q), k, loose >> COARSE)
        score = products(q[None], self.rows(rows))[0].astype(np.int64)
        first = firsts(np.zeros(len(rows), np.int8), score, ids[rows], k)
        return ids[rows[first]], score[first]


def digits(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, component, sign) of the digits other than 0 of every component, no two of them in neighbouring places."""
    size, sign = np.abs(q).astype(np.uint64), np.where(q < 0, -1, 1)
    found, place = [], 0
    while size.any():
        odd = size & np.uint64(1) == 1
        up = odd & (size & np.uint64(3) == 3)  # -1 here, and 1 carried to the next place
        at = np.flatnonzero(odd)
        found.append((np.full(len(at), place), at, np.where(up[at], -1, 1) * sign[at]))
        size = (size >> np.uint64(1)) + up
        place += 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def build_index(rows: DataFrame) -> DataFrame:
    """Blocks of bit slices of a written table (id, v) with distinct ids: every row lies in one block of its length."""
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()  # a row for each length
    blocks = [(d, -(-n // max(64, min(BLOCK_ROWS, SLICE_BYTES // max(1, d))))) for d, n in sizes]
    layout = F.broadcast(rows.sparkSession.createDataFrame(blocks, "d int, blocks int"))

    def build(block: pa.Table) -> pa.Table:
        d = block.column("d")[0].as_py()
        block = block.sort_by("id")
        made = Slices.of_rows(matrix(block.column("v"), d))
        held = [block.column("id").to_numpy().tobytes(), made.low.tobytes(), made.bits.tobytes()]
        return pa.table([pa.array([d], pa.int32()), pa.array([len(made.bits)], pa.int32()), *(pa.array([x], pa.binary()) for x in held)], names=["d", "bits", "ids", "low", "slices"])

    dealt = rows.withColumn("d", F.size("v")).join(layout, "d").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    # As many files as blocks, so that as many tasks can search them.
    return dealt.repartition(max(1, sum(b for _, b in blocks)), "d", "block").groupBy("d", "block").applyInArrow(build, INDEX)


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, own = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                bits, ids, low, slices = (batch.column(c)[row] for c in ("bits", "ids", "low", "slices"))
                ids, low = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(low.as_buffer(), np.int64)
                block = Slices(len(ids), low, np.frombuffer(slices.as_buffer(), np.uint64).reshape(bits.as_py(), len(low), -(-len(ids) // 64)))
                found = [(qid, *block.best(q, ids, k + 1)) for q, qid in zip(queries, own.tolist(), strict=True)]
                asked = np.repeat(own, [len(i) for _, i, _ in found])
                other, score = (np.concatenate([f[c] for f in found]) for c in (1, 2))
                rest = np.flatnonzero(asked != other)
                best = rest[firsts(asked[rest], score[rest], other[rest], k)]
                yield pa.RecordBatch.from_arrays([pa.array(x[best]) for x in (asked, other, score)], names=["query_id", "vec_id", "score"])

    return run


def top_products(rows: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``k`` rows with the largest inner product of floor(``scale`` * x) with each query, without the query's own row; exact.

    ``queries`` says which rows ask. Returns query_id, rank (from 1), vec_id and
    score, a whole number; ties go to the smaller id; fewer ranks if there are fewer rows.

    Every row is put into a block of an index of bitmaps, one for each component and
    bit. A block of queries is broadcast, its size bounded by ``block_bytes``, and meets every block of the index: the products are
    added up by bitmap arithmetic on all but the lowest bits, the boundary of the first rows is found from the most significant
    slice downward, and rows that the lowest bits could bring over it are compared by their whole values. Nothing is left out.

    Rows with a null id or vector, or a null or non-finite component (or one
    beyond 2^62 / ``scale``) take no part. Of several rows of one id only the one with the
    least vector counts. Vectors are compared with those of their own length only; empty ones have a score of 0. A score beyond a long
    is the nearest long. Extra columns are left behind.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    told = rows.where(F.col(id_col).isNotNull() & in_range(F.col(vec_col), scale))
    typed = told.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vec_col), scale).alias("v"), queries.alias("asks"))
    kept = scratch.write(one_per_id(typed, "asks"), "rows")
    asked = scratch.write(kept.where("asks").select("id", "v"), "queries")
    index = scratch.write(build_index(kept.select("id", "v")), "index")
    scratch.drop(kept)
    path, written = shared_path(spark, "products"), False
    for d, block in query_blocks(asked, block_bytes=block_bytes):
        shared = spark.sparkContext.broadcast((matrix(block.column("v"), d), block.column("id").to_numpy()))
        found = index.where(F.col("d") == d).mapInArrow(_search(shared, k), "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.destroy()
        written = True
    scratch.drop(asked, index)
    return spark.read.schema(RESULT).parquet(path) if written else spark.createDataFrame([], RESULT)
