"""Bins of a stream against those of the table, with rows that come late."""

import datetime as dt
import os

from pyspark.sql import functions as F

from periscan.streaming import open_bins as B

DAY = 86_400_000


def test_replay_equals_batch(spark, sf_dir):
    got = {(r.star_id, r.i): (round(r.flux, 9), r.n, r.time) for r in B.replay_bins(spark, sf_dir).collect()}
    lc = B.as_curves(spark.read.parquet(f"{sf_dir}/events.parquet"))
    last = lc.agg(F.max(F.unix_millis("ts"))).first()[0] - 2 * DAY
    want = {(r.star_id, r.i): (round(r.flux, 9), r.n, r.time) for r in B.batch_bins(lc, DAY).collect() if B.ORIGIN_MS + (r.i + 1) * DAY <= last}
    assert want and got == want


def test_late_rows_and_open_bins(spark, tmp_path):
    at = lambda day: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=day)
    files = [
        [(1, at(0.1), 1.0), (1, at(0.9), 3.0), (2, at(0.5), None), (1, at(2.2), 10.0)],
        [(1, at(1.5), 5.0), (1, at(0.5), 99.0), (2, at(4.5), 7.0)],  # the mark stands at 1.2 days: the first is out of order but in time, the second late
        [(1, at(0.2), 1000.0), (1, at(3.8), 4.0), (2, at(6.5), 9.0)],  # the first is late: the mark stands at 3.5 days
        [(2, at(9.5), 1.0)],
    ]
    schema = "star_id long, ts timestamp, flux double"
    os.mkdir(tmp_path / "in")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/part")
        for name in os.listdir(tmp_path / "part"):
            if name.endswith(".parquet"):
                os.rename(tmp_path / "part" / name, tmp_path / "in" / f"{k}.parquet")
                os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", B.STORE)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    B.stream_bins(stream, DAY, "1 day").writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"file://{tmp_path}/out").awaitTermination()
    got = sorted((r.star_id, r.i, r.flux, r.n) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [(1, 0, 2.0, 2), (1, 1, 5.0, 1), (1, 2, 10.0, 1), (1, 3, 4.0, 1), (2, 0, None, 0), (2, 4, 7.0, 1), (2, 6, 9.0, 1)]


def test_files_in_any_order_of_time(spark, sf_dir, tmp_path):
    """More files than a batch used to take, each over the whole month: none of their rows is late."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(20).write.parquet(f"file://{tmp_path}/events.parquet")
    rows = lambda df: {(r.star_id, r.i): (round(r.flux, 9), r.n, r.time) for r in df.collect()}
    got = rows(B.replay_bins(spark, f"file://{tmp_path}"))
    assert sum(n for _, n, _ in got.values()) > 0.8 * events.count() and got == rows(B.replay_bins(spark, sf_dir))


def test_state_is_called_for_buckets_not_stars(spark, tmp_path):
    """Thousands of stars, one of them null, over batches of a table: a call for each bin and bucket, and the table's bins."""
    lc = spark.range(24_000).select(F.when(F.col("id") % 3000 != 7, F.col("id") % 3000 + (1 << 60)).alias("star_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 20).alias("ts"), F.when(F.col("id") % 11 != 0, F.col("id") % 13 / 2.0).alias("flux"))
    lc.repartitionByRange(4, "ts").write.parquet(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", B.STORE)
    stream = spark.readStream.schema(lc.schema).parquet(f"file://{tmp_path}/in")
    query = B.stream_bins(stream, DAY, "1 hour", buckets=8).writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"file://{tmp_path}/out")
    query.awaitTermination()
    rows = lambda df: {(r.star_id, r.i): (r.flux and round(r.flux, 9), r.n, r.time) for r in df.collect()}
    got = rows(spark.read.parquet(f"file://{tmp_path}/out"))
    assert got == {k: v for k, v in rows(B.batch_bins(lc, DAY)).items() if k[1] < 5} and any(star is None for star, _ in got) and len(got) == 15_000
    assert 0 < max(s["numRowsUpdated"] for p in query.recentProgress for s in p["stateOperators"]) < 500
