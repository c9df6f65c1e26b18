"""Features of light curves and of groups of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periscan.operators.series import boxcar


def moments(lc: DataFrame) -> DataFrame:
    """Population deviation, skewness and excess kurtosis of the flux."""
    return lc.groupBy("star_id").agg(F.stddev_pop("flux").alias("flux_std"), F.skewness("flux").alias("flux_skewness"), F.kurtosis("flux").alias("flux_kurtosis"))


def duty_cycle(lc: DataFrame) -> DataFrame:
    """The share of the cadences between first and last that have flux."""
    return lc.groupBy("star_id").agg((F.count("flux") / (F.max("i") - F.min("i") + 1)).alias("duty_cycle"))


def von_neumann(lc: DataFrame) -> DataFrame:
    """Mean squared difference of adjacent points over the variance."""
    w = Window.partitionBy("star_id").orderBy("i")
    near = F.when(F.col("i") - F.lag("i").over(w) == 1, F.col("flux") - F.lag("flux").over(w))
    d = lc.where("flux is not null").withColumn("d", near)
    return d.groupBy("star_id").agg((F.avg(F.col("d") * F.col("d")) / F.nullif(F.var_pop("flux"), F.lit(0.0))).alias("von_neumann_eta"))


def r_var(lc: DataFrame, window: int = 4) -> DataFrame:
    """The range from the 5th to the 95th percentile of the smoothed flux."""
    p = boxcar(lc, window).groupBy("star_id").agg(F.expr("percentile(trend, array(0.05, 0.95))").alias("p"))
    return p.select("star_id", (F.get("p", F.lit(1)) - F.get("p", F.lit(0))).alias("r_var"))


def flicker(lc: DataFrame, window: int = 8) -> DataFrame:
    """The deviation of the flux from its smoothed self."""
    return boxcar(lc, window).groupBy("star_id").agg(F.stddev_pop(F.col("flux") - F.col("trend")).alias("flicker_std"))


def s_ph(lc: DataFrame, chunk: int, min_bins: int = 5) -> DataFrame:
    """The mean deviation of chunks of ``chunk`` cadences; a chunk needs a third of them, and a star ``min_bins`` whole chunks. The tail is dropped."""
    span = lc.groupBy("star_id").agg(F.min("i").alias("lo"), ((F.max("i") - F.min("i") + 1) / chunk).cast("long").alias("bins"))
    parts = lc.join(span, "star_id").withColumn("b", F.floor((F.col("i") - F.col("lo")) / chunk)).where("b < bins")
    per = parts.groupBy("star_id", "b", "bins").agg(F.stddev_pop("flux").alias("sd"), F.count("flux").alias("n")).where(F.col("n") >= max(3, chunk // 3))
    return per.groupBy("star_id").agg(F.when(F.max("bins") >= min_bins, F.avg("sd")).alias("s_ph"))


def agreement(candidates: DataFrame, rel_tol: float = 0.03) -> DataFrame:
    """For each (star_id, method, rank, p0): how many other candidates of the star, and how many other methods, lie within ``rel_tol`` of its own period."""
    other = candidates.select("star_id", F.col("method").alias("m2"), F.col("rank").alias("r2"), F.col("p0").alias("p2"))
    near = (F.abs(F.col("p2") - F.col("p0")) <= rel_tol * F.col("p0")) & ~((F.col("m2") == F.col("method")) & (F.col("r2") == F.col("rank")))
    return candidates.join(other, "star_id").groupBy("star_id", "method", "rank", "p0").agg(F.count_if(near).alias("n_agreeing_candidates"), F.count_distinct(F.when(near & (F.col("m2") != F.col("method")), F.col("m2"))).alias("n_agreeing_methods"))
