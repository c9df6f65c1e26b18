"""Document boundaries of flat, unindexed token files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periscan.llm.idfiles import store
from periscan.session import materialize, shuffle_partitions

#: Tokens that a task searches at a time.
BLOCK_TOKENS = 1 << 18


def scan(files: DataFrame, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Find the documents of token files that hold ids and end-of-document ids only.

    ``files``: path, size (bytes), width (bytes per id). Each file is cut into
    blocks that are searched on their own; each block reports where its
    separators are. A prefix scan over the blocks of a file then gives every
    block the number of separators before it and the place of the last one, which
    is all that is needed to number its documents and to measure the one that
    began in an earlier block, however many blocks it spans.

    Returns path, ordinal (of the document in its file), start, n_tokens (with
    the separator). Ids after the last separator of a file form one more document
    without a separator (``closed`` is false). Empty files have no documents.
    """
    n = shuffle_partitions(files.sparkSession)
    blocks = (
        files.select("path", "width", (F.col("size") / F.col("width")).cast("long").alias("tokens"))
        .where("tokens > 0")
        .select("path", "width", "tokens", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / block_tokens).cast("int"))).alias("block"))
        .repartition(n, "path", "block")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, width, tokens, block in zip(*(batch.column(c).to_pylist() for c in ("path", "width", "tokens", "block")), strict=True):
                first = block * block_tokens
                size = min(block_tokens, tokens - first)
                system, where = store(path)
                with system.open_input_file(where) as f:
                    ids = np.frombuffer(f.read_at(size * width, first * width), f"<u{width}")
                ends = np.flatnonzero(ids == end_id).astype(np.int64) + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int32()), pa.array([tokens], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["path", "block", "tokens", "ends"]
                )

    # Searched once; the scan reads a few numbers for each block, and the separators themselves stay where they are.
    found = materialize(blocks.mapInArrow(search, "path string, block int, tokens long, ends array<long>"), "separators")
    order = Window.partitionBy("path").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    last_end = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    counts = found.select("path", "block", "tokens", F.size("ends").alias("n"), last_end.alias("last_end"))
    stitched = counts.select(
        "path",
        "block",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("docs_before"),
        (F.coalesce(F.last("last_end", ignorenulls=True).over(earlier), F.lit(-1)) + 1).alias("begun"),
        F.lead("block").over(order).isNull().alias("is_last"),
    )
    whole = found.join(stitched, ["path", "block"])
    rest = F.when(F.col("is_last") & (F.coalesce(last_end, F.col("begun") - 1) + 1 < F.col("tokens")), F.array(F.col("tokens") - 1)).otherwise(F.array().cast("array<long>"))
    docs = whole.select("path", "docs_before", "begun", "ends", F.posexplode(F.concat("ends", rest)).alias("k", "end"))
    start = F.when(F.col("k") > 0, F.get("ends", F.col("k") - 1) + 1).otherwise(F.col("begun"))
    return docs.select("path", (F.col("docs_before") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("end") - start + 1).alias("n_tokens"), (F.col("k") < F.size("ends")).alias("closed"))


def flat_files(spark, folder: str, width: int) -> DataFrame:
    """path, size and width of the token files in a folder, listed by Spark without reading them."""
    return spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size"), F.lit(width).alias("width"))


def document_token_counts(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write ``docs`` as flat token files, scan them, and name the document of each boundary.

    Returns doc_id, start (in its file), n_tokens (with the separator).
    Null and empty texts are a separator alone. Repeated ids keep a row each.
    """
    from periscan.llm.idfiles import write_flat

    placed = write_flat(docs, tokenizer, end_id)
    # The number and the sizes of the files come from the folder, not from what was put in.
    folder = placed.select("path", "width").limit(1).first()
    if folder is None:
        return placed.select("doc_id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    files = flat_files(docs.sparkSession, folder["path"].rpartition("/")[0], folder["width"])
    # A retried task may have left files that were never committed.
    committed = placed.where("ordinal = 0").select(F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("as_written"))
    files = files.withColumn("name", F.substring_index("path", "/", -1)).join(committed, "name").select(F.col("as_written").alias("path"), "size", "width")
    return scan(files, end_id, block_tokens).join(placed, ["path", "ordinal"]).select("doc_id", "start", "n_tokens")
