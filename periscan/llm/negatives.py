"""Hard negatives by blocked products of anchors and candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periscan.llm.arrow import small_batches
from periscan.llm.integers import BLOCK_BYTES, firsts, in_range, matrix, one_per_id, products, query_blocks, scaled
from periscan.session import Scratch, shared_path

#: Anchors whose products with a batch of candidates a task holds at a time.
ANCHORS = 512
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _winners(found: list[tuple], k: int) -> list[tuple]:
    """Of (group, score, id) arrays, the first ``k`` of each group, as one such triple: partial results merge in any order."""
    group, score, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    best = firsts(group, score, ids, k)
    return [(group[best], score[best], ids[best])]


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (1, 2), high: tuple[int, int] = (19, 20), scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """For each anchor and each of its positives, the best negatives whose score lies in a window below the positive's.

    ``anchors`` says which rows are. A score is the inner product of
    floor(``scale`` * x), a whole number; higher ones come first, ties by smaller id. Positives
    are an anchor's first ``positives`` other rows of its label; negatives the
    first ``negatives`` rows of other labels with ``low`` <= negative score / positive
    score <= ``high``, two fractions, in whole numbers: a positive of negative score has none, one of 0 those of 0.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A block of anchors is broadcast, its size bounded by ``block_bytes``, and
    meets all candidates where they lie, twice: first each task keeps the best
    positives of every anchor, which merge over tasks; then, their windows known, the best
    negatives. Each block is written before the next one starts.

    Rows with a null id, label or vector, or a null or non-finite component (or
    one beyond 2^62 / ``scale``) take no part. Of several rows of one id only the one
    with the least vector, then label, counts. Vectors are compared with those of their own length
    only; empty ones have a score of 0. An anchor without positives or negatives has no rows, nor has an empty table. Extra columns are left behind.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    told = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & in_range(F.col(vec_col), scale))
    typed = told.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled(F.col(vec_col), scale).alias("v"), anchors.alias("anchor"))
    kept = scratch.write(one_per_id(typed, "label", "anchor"), "rows")
    asked = scratch.write(kept.where("anchor").select("id", "v", "label"), "anchors")
    path, written = shared_path(spark, "negatives"), False
    for d, block in query_blocks(asked, "label", block_bytes=block_bytes):
        q, ids, labels = matrix(block.column("v"), d), block.column("id").to_numpy(), block.column("label").to_numpy()
        shared = spark.sparkContext.broadcast((q, ids, labels))
        against = small_batches(kept.where(F.size("v") == d).select("id", "label", "v"))
        near = scratch.write(against.mapInArrow(_positives(shared, d, positives), "anchor long, score long, id long"), "positives")
        first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
        best = near.withColumn("r", first).where(F.col("r") <= positives).toArrow()  # ``positives`` for each anchor of the block at most
        scratch.drop(near)
        if best.num_rows:
            who = np.searchsorted(ids, best.column("anchor").to_numpy())
            place, score = best.column("r").to_numpy() - 1, best.column("score").to_numpy()
            least, most = np.ones((2, len(ids), positives), np.int64) * np.array([1, 0])[:, None, None]
            positive = np.zeros((2, len(ids), positives), np.int64)
            positive[:, who, place] = best.column("id").to_numpy(), score
            # Python's integers, as a fraction of a long may pass one on the way
            least[who, place] = [-(-s * low[0] // low[1]) for s in score.tolist()]
            most[who, place] = [s * high[0] // high[1] for s in score.tolist()]
            windows = spark.sparkContext.broadcast((positive, least, most))
            found = against.mapInArrow(_negatives(shared, windows, d, negatives), "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
            rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
            found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
            windows.destroy()
            written = True
        shared.destroy()
    scratch.drop(kept, asked)
    return spark.read.schema(RESULT).parquet(path) if written else spark.createDataFrame([], RESULT)


def _positives(shared, d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qid, qlabel = shared.value
        held: list[tuple] = []
        for batch in batches:
            x, ids, labels = matrix(batch.column("v"), d), batch.column("id").to_numpy(), batch.column("label").to_numpy()
            for a in range(0, len(q), ANCHORS):
                mine = slice(a, a + ANCHORS)
                score = products(q[mine], x)
                same = (qlabel[mine, None] == labels) & (qid[mine, None] != ids)
                lowest = score.min(initial=0) - 1
                last = max(0, len(x) - k)
                limit = np.partition(np.where(same, score, lowest), last, axis=1)[:, last]
                r, c = np.nonzero(same & (score >= limit[:, None]))
                if len(r):
                    held.append((a + r, score[r, c].astype(np.int64), ids[c]))
            if held:
                held = _winners(held, k)
        for who, score, ids in held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qid[who], score, ids)], names=["anchor", "score", "id"])

    return run


def _negatives(shared, windows, d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qid, qlabel = shared.value
        (pid, pscore), least, most = windows.value
        n = least.shape[1]
        # An anchor with no window, or with empty ones only, asks for nothing.
        some = least <= most
        bottom, top = np.where(some, least, np.iinfo(np.int64).max).min(1), np.where(some, most, np.iinfo(np.int64).min).max(1)
        held: list[tuple] = []
        for batch in batches:
            x, ids, labels = matrix(batch.column("v"), d), batch.column("id").to_numpy(), batch.column("label").to_numpy()
            for a in range(0, len(q), ANCHORS):
                mine = slice(a, a + ANCHORS)
                score = products(q[mine], x)
                r, c = np.nonzero((score >= bottom[mine, None]) & (score <= top[mine, None]) & (qlabel[mine, None] != labels))
                if not len(r):
                    continue
                s, i, r = score[r, c].astype(np.int64), ids[c], a + r
                for j in range(n):
                    inside = np.flatnonzero((s >= least[r, j]) & (s <= most[r, j]))
                    best = inside[firsts(r[inside], s[inside], i[inside], k)]
                    held.append((r[best] * n + j, s[best], i[best]))
            if held:
                held = _winners(held, k)
        for group, score, ids in held:
            who, j = np.divmod(group, n)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (qid[who], pid[who, j], ids, pscore[who, j], score)], names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run
