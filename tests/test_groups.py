"""Quantiles of groups, statistics of bins, ensembles, fitted curves, sectors and table functions against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from periscan.functions import guessers
from periscan.functions.statistics import trimmed_mean
from periscan.operators import comb, pools, quantiles, series, spectra
from periscan.operators.acf import acf
from periscan.sources import light_curves as L


def test_quantiles_of_uneven_groups(spark):
    r = np.random.default_rng(1)
    values = {("a", 1): r.normal(size=3000), ("a", None): np.repeat([1.0, 2.0, 2.5], [400, 1, 3]), (None, 2): np.array([7.0]), ("b", 1): r.integers(0, 4, 501).astype(float)}
    rows = [(*k, float(v)) for k, x in values.items() for v in x] + [("a", 1, None), ("a", 1, float("nan")), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, h int, value double").repartition(4).withColumns({"key": F.lit(1), "part": F.lit(2), "share": F.lit("x"), "m": F.lit(0)})
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    for spread in (1, 3, 16):
        got = {(x.g, x.h, x.share): x.value for x in quantiles.group_quantiles(df, ["g", "h"], "value", shares, spread).collect()}
        want = {(*k, s): np.quantile(x, s) for k, x in values.items() for s in shares}
        assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert quantiles.group_quantiles(df.limit(0), ["g"], "value", [0.5]).count() == 0


def test_no_range_holds_a_whole_group(spark, monkeypatch):
    written = {}
    old = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda df, name: written.setdefault(name, old(df, name)))
    df = spark.range(20_000).select(F.lit("one").alias("g"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("x"))
    assert quantiles.group_quantiles(df, ["g"], "x", [0.5], 8).count() == 1
    sizes = [r["count"] for r in written["counted"].groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 0.3 * 20_000
    assert written["wanted"].count() == 2


def test_trimmed_means_of_bins_with_nulls(spark):
    rows = [("s", t, v) for t, v in ((0.0, 1.0), (0.1, 100.0), (0.2, 2.0), (0.3, 3.0), (0.4, -50.0), (1.5, None), (2.2, 5.0), (3.1, 1.0))]
    lc = spark.createDataFrame(rows, "star_id string, time double, flux double")
    got = [(x.i, x.flux, x.n) for x in series.bin_curve(lc, 1.0, trimmed_mean(0.2)).orderBy("i").collect()]
    assert got == [(0, 2.0, 5), (1, None, 0), (2, 5.0, 1)]
    assert [(x.i, x.flux, x.n) for x in series.bin_curve(lc, 1.0).orderBy("i").collect()] == [(0, 11.2, 5), (1, None, 0), (2, 5.0, 1)]
    fold = pools.phase_fold(lc, spark.createDataFrame([("s", 10.0, 0.0)], "star_id string, p double, t0 double"), 2, trimmed_mean(0.3)).collect()
    assert [(x.bin, x["mean"], x.n) for x in fold] == [(0, 2.0, 7)]  # of 1, 2 and 3


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    lc = L.planted_stars(spark, sf_dir, n=2400).where("star_id in ('planted-0', 'planted-7')")
    found = acf(lc, 0.02).cache()
    return found, {x.star_id: x.true_period for x in lc.select("star_id", "true_period").distinct().collect()}


def test_ensemble_finds_periods_whose_halves_alone_are_proposed(spark, planted):
    lags, truth = planted
    pool = spark.createDataFrame([(s, p / 2) for s, p in truth.items()] + [("planted-7", 1e-3), ("unknown", 1.0)], "star_id string, p0 double")
    rows = comb.ensemble(lags, pool, 0.02).collect()
    assert {x.star_id for x in rows} == set(truth)
    for star, period in truth.items():
        own = sorted((x for x in rows if x.star_id == star), key=lambda x: x.place)
        assert [x.place for x in own] == list(range(1, len(own) + 1)) and len(own) <= own[0].n_tried <= 10
        assert min(abs(x.p / period - 1) for x in own) < 0.03
        keys = [(x.n_peaks_used < 4, not (x.frac_positive or 0) >= 0.8, x.redchi) for x in own]
        assert keys == sorted(keys)
    bounded = comb.ensemble(lags, pool, 0.02, shortest=1.0, longest=3.0).collect()
    assert bounded and all(1.0 <= x.p0 <= 3.0 for x in bounded)
    # With one period that fits badly there still is an answer.
    alone = comb.ensemble(lags, spark.createDataFrame([("planted-0", 0.3)], "star_id string, p0 double"), 0.02, factors=[1.0]).collect()
    assert len(alone) == 1 and alone[0].place == 1
    assert comb.ensemble(lags, pool.limit(0), 0.02).count() == 0


def test_fitted_curves_have_the_residuals_of_the_fit(spark, planted):
    lags, truth = planted
    fits = comb.ensemble(lags, spark.createDataFrame(list(truth.items()), "star_id string, p0 double"), 0.02, factors=[1.0, 0.5]).cache()
    curve = comb.comb_curve(fits, lags)
    rms = {(x.star_id, round(x.p0, 9), x.tooth): (x.rms, x.n) for x in curve.groupBy("star_id", "p0", "tooth").agg(F.sqrt(F.avg((F.col("acf") - F.col("model")) ** 2)).alias("rms"), F.count("*").alias("n")).collect()}
    want = {(x.star_id, round(x.p0, 9), t.n): (t.residual_rms, t.n_points) for x in fits.collect() for t in x.per_peak}
    assert want and rms.keys() == want.keys()
    assert all(rms[k][1] == n and abs(rms[k][0] - e) < 1e-9 for k, (e, n) in want.items())


def test_sectors_salvage_or_drop(spark):
    points = spark.createDataFrame([("a", s, s + 0.1 * k, float(k + 1 + s)) for s in range(5) for k in range(3)] + [("b", 0, 0.0, 0.0)], "star_id string, segment int, time double, flux double").withColumn("sector", F.lit("x"))
    stats = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("a", 2, True), ("a", 3, True), ("a", 3, True), ("b", 0, None)], "star_id string, segment int, flagged boolean")
    kept = lambda **o: sorted((x.star_id, x.sector, x.segment, round(x.flux, 9) if x.flux is not None else None) for x in pools.sector_points(points, stats, **o).collect())
    assert kept(exclude_flagged=True, normalise=False) == [("a", 1, 0, 1.0), ("a", 1, 0, 2.0), ("a", 1, 0, 3.0), *[("a", 3, 4, v) for v in (5.0, 6.0, 7.0)], ("b", 1, 0, 0.0)]
    assert kept(sectors=[3, 1, 9], normalise=False) == [*[("a", 3, 4, v) for v in (5.0, 6.0, 7.0)], ("b", 1, 0, 0.0)]
    assert len(kept()) == 16 and kept(sectors=[3]) == [("a", 3, 4, round(v / 6, 9)) for v in (5.0, 6.0, 7.0)] and kept(sectors=[1]) == [("b", 1, 0, None)]
    assert kept(sectors=[]) == []


def test_table_functions_equal_the_operators(spark, sf_dir):
    guessers.register(spark)
    L.planted_stars(spark, sf_dir, n=2400).where("star_id in ('planted-0', 'planted-7')").createOrReplaceTempView("some_curves")
    lc = spark.table("some_curves")
    rows = lambda df: sorted((x.star_id, x["rank"], round(x.p0, 9), round(x.strength, 9), x.method) for x in df.collect())
    lags = acf(lc, 0.02)
    assert rows(spark.sql("SELECT * FROM guess_acf_fft(0.02D, 4, TABLE(some_curves) PARTITION BY star_id)")) == rows(spectra.guess_acf_fft(lags, n_guesses=4))
    assert rows(spark.sql("SELECT * FROM guess_acf_fft_short(0.02D, 5, TABLE(some_curves) PARTITION BY star_id ORDER BY time)")) == rows(spectra.guess_acf_fft(lags, "acf_fft_short", oversample=8, max_period=15.0))
    assert rows(spark.sql("SELECT * FROM guess_lombscargle(1, 5, TABLE(some_curves) PARTITION BY star_id)")) == rows(spectra.guess_lombscargle(lc))
    for name, first in (("guess_acf_fft", "0.02D"), ("guess_lombscargle", "1")):
        few = f"SELECT * FROM {name}({first}, 5, TABLE(SELECT star_id, i, time, 1.0D AS flux FROM some_curves WHERE i < 20) PARTITION BY star_id)"
        assert spark.sql(few).count() == 0 and spark.sql(few.replace("i < 20", "i < 0")).count() == 0


def test_trimmed_means_need_no_python(spark):
    """Against a plain loop, with nulls, not-a-numbers and bins that the cut empties."""
    r = np.random.default_rng(3)
    rows = [("ab"[k % 2], k % 7 + 0.5, [float(x), None, float("nan")][0 if k % 5 else k % 3]) for k, x in enumerate(r.normal(size=300))] + [("c", 0.0, 1.0), ("c", 1.5, 2.0)]
    lc = spark.createDataFrame(rows, "star_id string, time double, flux double").repartition(4)
    for share in (0.0, 0.2, 0.34, 0.5):
        out = series.summarised(lc, ["star_id", "time"], trimmed_mean(share), "flux", F.count("*").alias("n"))
        assert not any(word in out._jdf.queryExecution().executedPlan().toString() for word in ("Pandas", "Python", "Join"))
        groups = {}
        for s, t, v in rows:
            groups.setdefault((s, t), []).append(v)
        for x in out.collect():
            v = sorted(y for y in groups[x.star_id, x.time] if y is not None and y == y)
            cut = int(len(v) * share)
            assert x.n == len(groups[x.star_id, x.time]) and (x.flux == pytest.approx(np.mean(v[cut : len(v) - cut]), abs=1e-12) if len(v) > 2 * cut else x.flux is None)
