"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periscan.session import materialize, shuffle_partitions


def group_quantiles(df: DataFrame, keys: list[str], column: str, shares: list[float], spread: int | None = None) -> DataFrame:
    """(``keys``, share, value): the quantiles of ``column`` in each group, between the two values next to the place share x (n - 1) by straight lines.

    Equal values are counted before they travel. The counts are dealt to ranges of
    (key, value), written once; sums by range tell which range holds each place, and only those ranges are numbered. So no task holds a
    group's values, however few and large the groups are. Null and not-a-number values don't count; null keys are keys.
    """
    spread = spread or shuffle_partitions(df.sparkSession)
    x = F.col(column).cast("double")
    counts = df.select(F.struct(*keys).alias("key"), x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy("key", "x").agg(F.count("*").alias("m"))
    ranged = materialize(counts.repartitionByRange(spread, "key", "x").withColumn("part", F.spark_partition_id()), "counted")
    # A row for each range of a group: as many as ranges and groups together, about.
    totals = ranged.groupBy("key", "part").agg(F.sum("m").alias("t"))
    along = Window.partitionBy("key").orderBy("part")
    bounds = totals.withColumns({"before": F.sum("t").over(along) - F.col("t"), "n": F.sum("t").over(Window.partitionBy("key"))})
    asked = bounds.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).withColumn("exact", F.col("share") * (F.col("n") - 1))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("exact").alias("at")), F.struct(F.lit(1).alias("side"), F.ceil("exact").alias("at")))).alias("s")
    wanted = asked.select("key", "part", "share", "before", "t", (F.col("exact") - F.floor("exact")).alias("over"), sides).where((F.col("s.at") >= F.col("before")) & (F.col("s.at") < F.col("before") + F.col("t")))
    wanted = materialize(wanted.select("key", "part", "share", "over", F.col("s.side").alias("side"), (F.col("s.at") - F.col("before")).alias("at")), "wanted")
    upto = F.sum("m").over(Window.partitionBy("key", "part").orderBy("x"))
    numbered = ranged.join(wanted.select("key", "part").distinct(), ["key", "part"], "left_semi").withColumn("upto", upto)
    found = numbered.join(wanted, ["key", "part"]).where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("m")))
    low, high = (F.max(F.when(F.col("side") == k, F.col("x"))) for k in (0, 1))
    out = found.groupBy("key", "share").agg(low.alias("low"), high.alias("high"), F.max("over").alias("over"))
    return out.select(*(F.col(f"key.`{k}`").alias(k) for k in keys), "share", F.when(F.col("over") == 0, F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("over")).alias("value"))
