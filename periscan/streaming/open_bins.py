"""Bins of each star's curve, kept open while rows can still come."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from periscan.session import shared_path, table

#: Bins start at this moment, in milliseconds since 1970, whatever a star's first time is: that is not known to a stream.
ORIGIN_MS = 1_704_067_200_000
RESULT = "star_id long, i long, time double, flux double, n long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: A star's open bin in the state; a null star is 0 with ``none``.
CELL = np.dtype([("none", "?"), ("star_id", "<i8"), ("sum", "<f8"), ("count", "<i8")])


class OpenBins(StatefulProcessor):
    """Sum and count of each star of a bucket in one open bin. They come out once, when the watermark passes the bin's end, and are forgotten then.

    A key is a bin and a bucket of stars, and its state one value: what a batch costs is a call or two for each key, not for each star and bin.
    """

    def __init__(self, width_ms: int):
        self.width = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getValueState("cells", "held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stars = ["none", "star_id"]
        made = [batch.groupby(stars)["flux"].agg(["sum", "count"]).reset_index() for batch in rows]
        end = ORIGIN_MS + (int(key[0]) + 1) * self.width
        if made and end > timerValues.getCurrentWatermarkInMs():
            if self.cells.exists():
                made.append(pd.DataFrame(np.frombuffer(self.cells.get()[0], CELL)))
            else:
                self.handle.registerTimer(end)
            cells = pd.concat(made).groupby(stars)[["sum", "count"]].sum().reset_index()
            self.cells.update((cells.to_records(index=False).astype(CELL).tobytes(),))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.cells.exists():
            cells = np.frombuffer(self.cells.get()[0], CELL)
            self.cells.clear()
            i, n = int(key[0]), cells["count"]
            flux = np.divide(cells["sum"], n, out=np.full(len(n), np.nan), where=n > 0)
            yield pd.DataFrame({"star_id": pd.arrays.IntegerArray(cells["star_id"].copy(), cells["none"].copy()), "i": i, "time": (i + 0.5) * self.width / 86_400_000, "flux": flux, "n": n})

    def close(self) -> None:
        pass


def stream_bins(events: DataFrame, width_ms: int, late: str, buckets: int = 64) -> DataFrame:
    """(star_id, i, time, flux, n): mean flux of bins of a stream (star_id long, ts timestamp, flux), each once it is closed; time in days of its middle.

    Rows later than ``late`` behind the latest are dropped, as are those of closed bins. Rows without flux count in no mean. Stars are dealt to
    ``buckets``, whose number must stay as it is while a stream's state lives: a bin's state holds a few dozen bytes for each star of a bucket.
    """
    star, i = F.col("star_id"), F.floor((F.unix_millis("ts") - ORIGIN_MS) / width_ms)
    timed = events.where("ts is not null").select(i.alias("i"), F.pmod(F.xxhash64(star), F.lit(buckets)).alias("bucket"), star.isNull().alias("none"), F.coalesce(star, F.lit(0)).cast("long").alias("star_id"), "ts", F.col("flux").cast("double").alias("flux"))
    return timed.withWatermark("ts", late).groupBy("i", "bucket").transformWithStateInPandas(OpenBins(width_ms), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")


def batch_bins(lc: DataFrame, width_ms: int) -> DataFrame:
    """The same bins of a table, all of them."""
    i = F.floor((F.unix_millis("ts") - ORIGIN_MS) / width_ms)
    return lc.groupBy("star_id", i.alias("i")).agg(F.avg("flux").alias("flux"), F.count("flux").alias("n")).select("star_id", "i", ((F.col("i") + 0.5) * width_ms / 86_400_000).alias("time"), "flux", "n")


def as_curves(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("star_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("flux"))


def replay_bins(spark: SparkSession, sf_dir: str, width_ms: int = 86_400_000, late: str = "2 days") -> DataFrame:
    """The bins that are closed once all files of ``events`` have gone through the stream.

    The files are taken as they are, in no order of time. So one batch takes them all: of those in later batches, rows behind the watermark would be lost.
    """
    out, state = shared_path(spark, "bins"), shared_path(spark, "bins-state")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", (1 << 31) - 1).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    spark.conf.set(key, STORE)
    try:
        stream_bins(as_curves(stream), width_ms, late).writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(RESULT).parquet(out)
