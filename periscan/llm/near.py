"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periscan.llm.arrow import free, slices, small_batches
from periscan.llm.components import connected_components
from periscan.llm.shingles import band_keys, set_key, shingle_sets, super_minhash
from periscan.session import Scratch, few

#: At a similarity of 0.8, 24 bands of 4 values miss a pair with a chance of about 3 in a million.
BANDS, ROWS = 24, 4
#: A link needs SHARE[0] / SHARE[1] or more.
SHARE = (80, 100)
BATCH_BYTES = 2 << 20
#: Longs of the bitmap kept for each set.
BITMAP = 16


def signatures(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                sets = shingle_sets(part.column("text").to_pylist(), width)
                keys = band_keys(super_minhash(sets, bands * rows), rows).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) for s in sets], pa.binary()),
                        pa.array([k if len(s) else [] for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands"],
                )
        free()

    return small_batches(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles, bits) of (node, set_key, text), where the text has the set of that key; bits: by the parity of the number of shingles with each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                found = [(n, s.view(np.int64)) for n, key, s in zip(part.column("node").to_pylist(), part.column("set_key").to_pylist(), shingle_sets(part.column("text").to_pylist(), width), strict=True) if set_key(s) == key]
                bits = [np.packbits(np.bincount(s & (64 * BITMAP - 1), minlength=64 * BITMAP) & 1).view(np.int64) for _, s in found]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["node", "shingles", "bits"])
        free()

    return small_batches(texts).mapInArrow(run, "node long, shingles array<long>, bits array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, share: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Of distinct, written pairs (u, v), those whose full sets are similar enough. Only sets that are in pairs travel."""
    nodes = scratch.write(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "paired")
    some = sets.join(few(nodes), "node", "left_semi")
    a = some.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    b = some.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    links = scratch.write(pairs.join(a, "u").join(b, "v").where(share[1] * both >= share[0] * (F.size("su") + F.size("sv") - both)).select("u", "v"), "links")
    scratch.drop(nodes, pairs)
    return links


def _may_link(n, o, share: tuple[int, int]):
    """Sets of such sizes can be similar enough at all."""
    return share[1] * F.least(n, o) >= share[0] * F.greatest(n, o)


def _may_link_bits(share: tuple[int, int]):
    """The bitmaps of u and v leave room for a similarity of ``share``.

    Each differing bit stands for an element of one set only, so the intersection
    is at most (nu + nv - differing) / 2: an exact bound, without the sets.
    """
    differing = " + ".join(f"bit_count(b{k}u ^ b{k}v)" for k in range(BITMAP))
    return F.expr(f"({differing}) * {share[0] + share[1]} <= (nu + nv) * {share[1] - share[0]}")


def near_duplicates(
    docs: DataFrame, width: int = 5, share: tuple[int, int] = SHARE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of word shingle sets of ``share`` or more.

    Returns a row for each input row: doc_id, n_shingles, component_id (the
    smallest id reachable over links) and kept (doc_id = component_id).

    Rows with equal sets are one node from the start, however many they are.
    Nodes that share a band are candidates. They are compared in three steps, each
    followed by union-find grouping (of two rounds the first time), so that what is already in one group is not
    compared again: every node with the pivot it shares most bands with (a band's
    pivot is its node that shares bands with most others); with its other pivots; and, in bands that still
    hold several groups, the nodes outside the largest group with all others
    that bitmaps of their sets allow. That bound is exact, and loses none.
    Every candidate pair thus ends up compared or in one group, with a number of
    comparisons that follows the number of nodes where groups are dense. All are
    confirmed on full sets.

    Null or empty texts have no set, are linked with nothing and are kept. Rows
    with a null id come back with a null component and kept false. Rows of one id
    are one document: if their sets differ, those are linked, and each is compared on its own. Extra columns are left behind.

    Texts travel only to where they are read; the sets of nodes that share a band are
    the largest table. Tables are dropped as soon as nothing needs them.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.write(signatures(base, width, bands, rows), "signatures")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    # Numbers given once, when the table is written.
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    exploded = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.count("*").alias("held")).where("held > 1")
    held = scratch.write(exploded.join(shared, "band"), "bands")
    # The text that others were made from shares bands with most of them, so it makes the best pivot.
    central = held.groupBy("node").agg(F.sum("held").alias("central"))
    weighed = held.join(central, "node")
    lead = F.struct("central", F.xxhash64("node", "band"), "node")
    heads_of_bands = weighed.groupBy("band").agg(F.max_by(F.struct("node", "n"), lead).alias("p"), F.max("central").alias("pivot_central")).select("band", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), "pivot_central")
    members = scratch.write(held.join(heads_of_bands, "band").drop("held"), "members")
    scratch.drop(held)

    seen = scratch.write(members.select("node").distinct().join(classes.select("node", "least", "set_key"), "node"), "seen")
    sources = base.join(few(seen), F.col("doc_id") == F.col("least")).select("node", "set_key", "text")
    sets = scratch.write(full_sets(sources, width).dropDuplicates(["node"]), "sets")
    scratch.drop(seen)

    pivots = scratch.write(
        members.where((F.col("node") != F.col("pivot")) & _may_link(F.col("n"), F.col("pivot_n"), share)).groupBy("node", "pivot").agg(F.count("*").alias("common"), F.max("pivot_central").alias("pivot_central")), "pivots"
    )
    best = scratch.write(pivots.groupBy("node").agg(F.max_by("pivot", F.struct("common", "pivot_central", "pivot")).alias("pivot")), "best")
    first = _verified(scratch.write(best.select(F.col("node").alias("u"), F.col("pivot").alias("v")), "pairs"), sets, share, scratch)
    groups = scratch.write(connected_components(first, 2, settle=False), "groups")

    def grouped(df: DataFrame, node: str, into: str) -> DataFrame:
        return df.join(groups.select(F.col("node").alias(node), F.col("component").alias(into)), node, "left").withColumn(into, F.coalesce(into, node))

    apart = grouped(grouped(pivots.select("node", "pivot"), "node", "g"), "pivot", "h").where("g <> h").join(best, ["node", "pivot"], "left_anti")
    more = _verified(scratch.write(apart.select(F.col("node").alias("u"), F.col("pivot").alias("v")), "pairs"), sets, share, scratch)
    scratch.drop(pivots, best, groups)
    links = first.unionByName(more)
    groups = scratch.write(connected_components(links), "groups")  # settled: a node still outside its group would meet all of it

    placed = grouped(members.select("band", "node", "n", "pivot"), "node", "g")
    parts = placed.groupBy("band", "g").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("band").agg(F.count("*").alias("parts"), F.max_by("g", F.struct("size", "g")).alias("main")).where("parts > 1").select("band", "main")
    open_nodes = placed.join(mixed, "band")
    # Plain columns: array access would make the join's condition too long to be compiled.
    words = [F.get("bits", F.lit(k)).alias(f"b{k}") for k in range(BITMAP)]
    open_nodes = scratch.write(open_nodes.join(sets.select("node", *words), "node"), "open")
    scratch.drop(members, groups)

    def side(x: str, *more: str) -> list:
        return ["band", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("g").alias(f"g{x}"), *(F.col(f"b{k}").alias(f"b{k}{x}") for k in range(BITMAP)), *more]

    left, right = open_nodes.where("g <> main").select(*side("u")), open_nodes.select(*side("v", "pivot", "main"))
    fresh = (
        left.join(right, "band")
        # both outside the largest group: once; the pivot's own comparisons are done
        .where((F.col("gu") != F.col("gv")) & ((F.col("gv") == F.col("main")) | (F.col("u") < F.col("v"))) & (F.col("u") != F.col("pivot")) & (F.col("v") != F.col("pivot")))
        .where(_may_link(F.col("nu"), F.col("nv"), share))
        .where(_may_link_bits(share))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    last = _verified(scratch.write(fresh, "pairs"), sets, share, scratch)
    scratch.drop(open_nodes, sets)
    # An id whose rows have several sets joins their nodes.
    manifold = filled.groupBy("doc_id").agg(F.min("set_key").alias("one"), F.max("set_key").alias("other")).where("one <> other").select("doc_id", "one")
    rows_of = filled.join(manifold, "doc_id").where("set_key <> one").select("one", "set_key").distinct()
    node_of = classes.select("set_key", "node")
    same_id = rows_of.join(node_of.withColumnRenamed("node", "u"), "set_key").join(node_of.select(F.col("set_key").alias("one"), F.col("node").alias("v")), "one").select("u", "v")
    groups = scratch.write(connected_components(links.unionByName(last).unionByName(same_id)), "groups")

    named = classes.select("set_key", "node", "least").join(groups, "node", "left")
    smallest = named.where("component is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    named = scratch.write(named.join(smallest, "component", "left").select("set_key", F.coalesce("smallest", "least").alias("component_id")), "named")
    scratch.drop(first, more, last, groups, classes)
    out = signed.join(named, "set_key", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
