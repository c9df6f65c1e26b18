"""Hourly means of a stream of events, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periscan.session import shared_path, table


def hourly_means(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(star_id, hour, flux, n) of (ts, event_type, value), batch or stream; a stream drops rows later than ``late``."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    per = timed.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.avg("value").alias("flux"), F.count("value").alias("n"))
    return per.select(F.col("event_type").alias("star_id"), F.col("w.start").alias("hour"), "flux", "n")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means after all files of ``events`` have gone through the stream.

    Each batch of updates is written under its own number, so that a repeated
    batch replaces itself; the last update of an hour counts.
    """
    out, state = shared_path(spark, "hours"), shared_path(spark, "hours-state")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")  # a pattern: file streams take a single file in no other form

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    hourly_means(stream).writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(out).groupBy("star_id", "hour").agg(F.max_by("flux", "batch").alias("flux"), F.max_by("n", "batch").alias("n"))
