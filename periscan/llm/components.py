"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periscan.session import Scratch


def connected_components(links: DataFrame, max_rounds: int = 60, settle: bool = True) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v): the smallest node reachable.

    Alternates the large-star and small-star steps until no link changes. Both
    only take minima by node and join them back, so no node's neighbours are ever
    gathered in one place; each round is written to the shared folder. With
    ``settle`` false, the groups after ``max_rounds`` are returned as they are: parts of
    components, each named by one of its nodes.
    """
    e = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    scratch = Scratch(links.sparkSession)
    e = scratch.write(e, "links")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        last, e = e, scratch.write(small.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        scratch.drop(last)
        if not settle:
            continue
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        if settle:
            raise RuntimeError("the components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
