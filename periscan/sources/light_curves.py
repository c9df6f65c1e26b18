"""Light curves as long tables: star_id, i (cadence number), time (days), flux; and the summary table of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periscan.session import table

#: Microseconds since 1970 of a timestamp without zone, whatever the session's zone is.
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


def event_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One curve for each event type: the mean value of every hour that has events."""
    hour = F.floor(F.expr(MICROS.format("cast(ts as timestamp_ntz)")) / 3_600_000_000)
    cells = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("star_id"), hour.alias("hour")).agg(F.avg("value").alias("flux"))
    first = cells.agg(F.min("hour").alias("first"))
    return cells.crossJoin(F.broadcast(first)).select("star_id", (F.col("hour") - F.col("first")).cast("long").alias("i"), ((F.col("hour") - F.col("first")) / 24.0).alias("time"), "flux")


def user_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One uneven curve for each user; time in days from 2024-01-01."""
    days = (F.expr(MICROS.format("cast(ts as timestamp_ntz)")) - F.lit(1_704_067_200_000_000)) / F.lit(86_400_000_000.0)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("star_id"), "event_id", days.alias("time"), F.col("value").alias("flux"))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a batch's summary table: one row for each star (customer) and method (order priority)."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    per = o.groupBy(F.col("o_custkey").alias("star_id"), F.col("o_orderpriority").alias("method")).agg(
        F.count("*").alias("n_candidates"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("found"), F.round(F.max("o_totalprice") / 5000.0, 6).alias("activity")
    )
    return per.join(c.select(F.col("c_custkey").alias("star_id"), F.round(F.abs("c_acctbal") / 100.0, 4).alias("period")), "star_id")


def star_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for the parameters of stars (customers): period from the balance, the others from the key by plain arithmetic."""
    k = F.col("c_custkey")
    low = (k * 17 % 45).cast("double")
    return table(spark, sf_dir, "customer").select(
        k.alias("star_id"),
        F.round(F.abs("c_acctbal") / 100.0, 4).alias("period"),
        ((k * 31) % 97 / 10.0 + 0.1).alias("activity"),
        (k % 11 + 1.0).alias("cycle"),
        ((k * 7) % 13 / 10.0).alias("overlap"),
        ((k * 37) % 91).cast("double").alias("incl"),
        low.alias("minlat"),
        (low + k % 40).alias("maxlat"),
        (((k * 29) % 101 - 50) / 100.0).alias("diffrot"),
        ((k * 53) % 1000).cast("double").alias("tspot"),
        (k % 2 == 1).alias("bfly"),
    )


def planted_curve(spark: SparkSession, period: float = 3.7, n: int = 4000, step: float = 0.02, seed: int = 0) -> DataFrame:
    """A spotted star with a known period: a modulated sine with its second harmonic, and noise."""
    phase = F.col("time") * (2 * 3.141592653589793 / period)
    amplitude = 1 + 0.3 * F.sin(F.col("time") * (2 * 3.141592653589793 / 30))
    return (
        spark.range(n)
        .select(F.lit("planted").alias("star_id"), F.col("id").alias("i"), (F.col("id") * step).alias("time"))
        .withColumn("flux", 0.01 * amplitude * (F.sin(phase) + 0.4 * F.sin(2 * phase) + 0.3) + 0.0015 * F.randn(seed))
    )


def planted_stars(spark: SparkSession, sf_dir: str, n: int = 4000, step: float = 0.02) -> DataFrame:
    """A spotted star for each supplier key below 12, with a period of 1.5 to 8 days that the key gives: star_id, i, time, flux, true_period. The noise is drawn from hashes."""
    keys = table(spark, sf_dir, "supplier").where("s_suppkey < 12").select(F.concat(F.lit("planted-"), F.col("s_suppkey").cast("string")).alias("star_id"), (1.5 + (F.col("s_suppkey") * 7 % 23) * 0.29).alias("true_period"), F.col("s_suppkey").alias("key"))
    points = keys.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("i")).withColumn("time", F.col("i") * step)
    phase = F.col("time") * (2 * 3.141592653589793) / F.col("true_period")
    draw = lambda k: F.pmod(F.xxhash64("key", "i", F.lit(k)), F.lit(1_000_003)) / 1_000_003.0
    noise = (draw(1) + draw(2) + draw(3) - 1.5) * 0.003
    amplitude = 1 + 0.3 * F.sin(F.col("time") * (2 * 3.141592653589793 / 30))
    return points.select("star_id", "i", "time", (0.01 * amplitude * (F.sin(phase) + 0.4 * F.sin(2 * phase) + 0.3) + noise).alias("flux"), "true_period")
