"""A uniform shuffle into shards of exact sizes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periscan.session import materialize

#: Rows that are put in order by one task at a time.
BLOCK_ROWS = 1 << 16
MIN_BLOCKS = 64
#: Levels of the tree of draws between two writes, to keep plans short.
LEVELS_PER_WRITE = 6


def _uniform(seed: int, *cols: str) -> str:
    """SQL for a number from 0 to below 1 that only depends on ``cols``, so that a repeated task draws the same."""
    return f"(shiftrightunsigned(xxhash64({', '.join([str(seed), *cols])}), 11) / 9007199254740992D)"


def _draws(seed: int, shards: int) -> str:
    """SQL for how many of ``n_left`` rows drawn without replacement from the counts in ``cap`` come from each shard.

    One hypergeometric draw after the other, each by inversion: the weights
    are summed from a point 12 standard deviations below the mean to one as far
    above (beyond, double precision sees no weight), then searched for a uniform
    number.
    """
    step = "(p.g - k) * (p.n - k) / cast((k + 1) * (p.b - p.n + k + 1) as double)"
    spread = "sqrt(p.n * (p.g / cast(greatest(p.g + p.b, 1) as double)) * (p.b / cast(greatest(p.g + p.b, 1) as double)) * (p.g + p.b - p.n) / greatest(p.g + p.b - 1, 1))"
    mean = "(p.n * (p.g / cast(greatest(p.g + p.b, 1) as double)))"
    given = f"array(named_struct('g', cap[s], 'b', a.rest - cap[s], 'n', a.n, 'u', {_uniform(seed, 'level', 'node', 's')}))"
    bounds = (
        f"transform({given}, p -> named_struct('g', p.g, 'b', p.b, 'n', p.n, 'u', p.u,"
        f" 'lo', greatest(0L, p.n - p.b, cast(floor({mean} - 12 * {spread}) as bigint) - 12L), 'hi', least(p.n, p.g, cast(ceil({mean} + 12 * {spread}) as bigint) + 12L)))"
    )
    summed = (
        f"transform({bounds}, p -> named_struct('g', p.g, 'b', p.b, 'n', p.n, 'u', p.u, 'lo', p.lo, 'hi', p.hi,"
        f" 'total', aggregate(sequence(p.lo, p.hi), named_struct('w', 1D, 'sum', 0D), (c, k) -> named_struct('w', c.w * {step}, 'sum', c.sum + c.w)).sum))"
    )
    picked = (
        f"transform({summed}, p -> aggregate(sequence(p.lo, p.hi), named_struct('w', 1D, 'left', p.u * p.total, 'x', p.lo),"
        f" (c, k) -> if(c.left < 0, c, named_struct('w', c.w * {step}, 'left', c.left - c.w, 'x', k))).x)"
    )
    return (
        f"aggregate(sequence(0, {shards - 2}), named_struct('n', n_left, 'rest', n, 'x', cast(array() as array<bigint>)),"
        f" (a, s) -> element_at(transform({picked}, x -> named_struct('n', a.n - x, 'rest', a.rest - cap[s], 'x', concat(a.x, array(x)))), 1), a -> concat(a.x, array(a.n)))"
    )


def communication_matrix(counts: DataFrame, levels: int, shards: int, seed: int) -> DataFrame:
    """(block, cap): how many rows of each block go to each shard, in a uniform shuffle into shards whose sizes differ by one at most.

    ``counts``: (block, n) for blocks 0 to 2**levels - 1; missing blocks are
    empty. The matrix is drawn down a binary tree: of the rows of a node, which
    shards take how many is known, and the share of its left half is a
    multivariate hypergeometric draw. All nodes of a level draw at once.
    """
    spark = counts.sparkSession
    top = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    sizes = F.array(*[(F.col("n") / shards).cast("long") + (F.col("n") % shards > s).cast("long") for s in range(shards)])
    nodes = top.select(F.lit(0).cast("long").alias("node"), F.col("n").cast("long"), sizes.alias("cap"))
    for level in range(levels):
        width = levels - level - 1
        left = counts.groupBy(F.shiftright("block", width).alias("child")).agg(F.sum("n").alias("n_left")).where("child % 2 = 0")
        joined = nodes.join(left, F.col("child") == 2 * F.col("node"), "left").select("node", "n", "cap", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.lit(level).alias("level"))
        drawn = joined.withColumn("taken", F.expr(_draws(seed, shards)) if shards > 1 else F.array("n_left"))
        halves = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("n_left").alias("n"), F.col("taken").alias("cap")),
            F.struct((2 * F.col("node") + 1).alias("node"), (F.col("n") - F.col("n_left")).alias("n"), F.zip_with("cap", "taken", lambda c, t: c - t).alias("cap")),
        )
        nodes = drawn.select(F.inline(halves)).where("n > 0")
        if (level + 1) % LEVELS_PER_WRITE == 0 and level + 1 < levels:
            nodes = materialize(nodes, "matrix")
    return materialize(nodes.select(F.col("node").alias("block"), "cap"), "matrix") if levels else nodes.select(F.col("node").alias("block"), "cap")


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard) to all rows: every arrangement with these shard sizes is as likely.

    Sizes differ by one at most. Rows are dealt to blocks by a hash of the columns
    ``by`` (all if None); the number of rows of each block for each shard is drawn
    as an exact matrix; each block is put in random order and cut by its row of
    the matrix; rows go to their shards; and there they are put in random order
    again. A shard is ordered in as many parts as keep one task's rows bounded, and
    offsets of the parts make its slots gapless.

    All is drawn from hashes of the rows and ``seed``: a repeated task gives the
    same, and equal rows are interchangeable. Nulls are values like others.
    Columns named shard or slot are replaced. Select what you need first: all
    columns travel twice, and lie on disk twice at most.
    """
    df = df.drop("shard", "slot")
    by = by or df.columns
    n = df.count()
    levels = (max(MIN_BLOCKS, -(-n // BLOCK_ROWS)) - 1).bit_length()
    blocks = 1 << levels
    dealt = df.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(blocks)))
    counts = materialize(dealt.groupBy(F.col("__block").alias("block")).agg(F.count("*").alias("n")), "counts")
    matrix = communication_matrix(counts, levels, shards, seed)
    local = Window.partitionBy("__block").orderBy(F.xxhash64(F.lit(seed + 1), *by), *by)
    placed = dealt.withColumn("__at", F.row_number().over(local) - 1).join(matrix.withColumnRenamed("block", "__block"), "__block")
    upto = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("cap", 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    parts = max(8, blocks // shards)
    sent = placed.withColumn("shard", F.size(F.filter(upto, lambda c: c <= F.col("__at")))).withColumn("__part", F.pmod(F.xxhash64(F.lit(seed + 2), *by), F.lit(parts))).drop("__block", "__at", "cap")
    sent = materialize(sent, "sent", tidy=True)  # else the first shuffle lies beside the second
    sizes = sent.groupBy("shard", "__part").agg(F.count("*").alias("n"))
    # A row for each part of a shard, not for each row of the data.
    offsets = sizes.select("shard", "__part", (F.sum("n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("n")).alias("__before"))
    inner = Window.partitionBy("shard", "__part").orderBy(F.xxhash64(F.lit(seed + 3), *by), *by)
    ordered = sent.withColumn("__at", F.row_number().over(inner) - 1)
    return ordered.join(offsets, ["shard", "__part"]).withColumn("slot", F.col("__before") + F.col("__at")).select(*df.columns, "shard", "slot")
