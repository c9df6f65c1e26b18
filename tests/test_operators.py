"""Kernels against closed forms, edge cases, and a planted period from end to end."""

import math

import numpy as np
from pyspark.sql import functions as F

from periscan.operators import acf, benchmark, diagnostics, features, series, spectra
from periscan.sources.light_curves import planted_curve


def curve(spark, flux, star="a"):
    return spark.createDataFrame([(star, k, k * 0.5, v) for k, v in enumerate(flux)], "star_id string, i long, time double, flux double")


def test_even_window_has_one_point_more_before(spark):
    got = [r.trend for r in series.boxcar(curve(spark, [1.0, 2.0, 4.0, 8.0]), 2).orderBy("i").collect()]
    assert got == [1.0, 1.5, 3.0, 6.0]


def test_islands_need_their_width(spark):
    lc = curve(spark, [1.0, 9.0, 9.0, 1.0, 9.0, 9.0, 9.0])
    got = series.islands(lc, F.col("flux") > 5, 3).collect()
    assert [(r.start_i, r.end_i, r.width) for r in got] == [(4, 6, 3)]


def test_even_cadence_restores_a_deleted_stretch_and_takes_the_last_of_two(spark):
    lc = curve(spark, [float(k) for k in range(20)]).where("i not between 5 and 9")
    extra = spark.createDataFrame([("a", 99, 1.01, 77.0)], lc.schema)
    got = series.even_cadence(lc.unionByName(extra), 0.5).orderBy("i").collect()
    assert len(got) == 20 and [r.i for r in got if r.flux is None] == [5, 6, 7, 8, 9] and got[2].flux == 77.0


def test_interpolation_fills_inside_and_at_the_ends(spark):
    got = [r.flux for r in series.interpolate(curve(spark, [None, 1.0, None, None, 4.0, None])).orderBy("i").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_acf_of_a_sine_is_a_cosine(spark):
    lc = curve(spark, [math.sin(2 * math.pi * k / 20) for k in range(400)])
    got = {r.k: r.acf for r in acf.acf(lc, 0.5).collect()}
    assert max(got) == 133 and all(abs(v - math.cos(2 * math.pi * k / 20)) < 0.03 for k, v in got.items())


def test_acf_of_sparse_points_ignores_coverage(spark):
    lc = curve(spark, [float(k % 7) if k % 9 == 0 else None for k in range(300)])
    assert acf.acf(lc, 0.5).count() > 9


def test_lomb_scargle_peaks_at_the_period(spark):
    lc = planted_curve(spark)
    grid = spectra.grid_of(lc.select("star_id").distinct(), "0.05D", "1.0D", "0.005D")
    best = spectra.candidates(spectra.lomb_scargle(lc, grid), "lombscargle").where("rank = 1").first()
    assert abs(best.p0 - 3.7) / 3.7 < 0.05


def test_flat_top_is_one_maximum_and_ends_are_none(spark):
    s = spark.createDataFrame([("a", g, 1.0 + g, p) for g, p in enumerate([9.0, 1.0, 5.0, 5.0, 5.0, 2.0, 8.0])], "star_id string, g long, freq double, power double")
    assert [r.g for r in spectra.local_maxima(s).collect()] == [3]


def test_dispersion_is_least_at_the_true_period(spark):
    lc = planted_curve(spark)
    got = diagnostics.refine_by_dispersion(lc, lc.select("star_id").distinct().withColumn("p", F.lit(3.72))).first()
    assert abs(got.p - 3.7) < 0.02
    two = spark.createDataFrame([("planted", 3.7), ("planted", 1.85)], "star_id string, p double")
    theta = {r.p: r.theta for r in diagnostics.phase_dispersion(lc, two).collect()}
    assert theta[3.7] < theta[1.85]


def test_bands_exclude_their_lowest_edge(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.1, 50.0, 51.0)], "x double").select(benchmark.band_of(F.col("x")).alias("b")).collect()
    assert [r.b for r in rows] == [None, 0, 1, 3, 4]


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "x double")
    assert sorted(r.r for r in benchmark.average_rank(df, "x", "r").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_truth_that_is_missing_matches_nothing(spark):
    df = spark.createDataFrame([("a", "m", 1, 3.0, None), ("b", "m", 1, 3.0, 3.2)], "star_id string, method string, rank int, p0 double, true_period double")
    got = {r.star_id: (r.found_true_period, r.rank_of_true_period) for r in benchmark.rank_of_true(df).collect()}
    assert got == {"a": (False, None), "b": (True, 1)}


def test_results_do_not_depend_on_partitions(spark):
    lc = planted_curve(spark, n=500)
    one = features.moments(lc.repartition(1)).first()
    many = features.moments(lc.repartition(7)).first()
    assert abs(one.flux_std - many.flux_std) < 1e-12


def test_refinement_makes_no_rows_of_trials(spark):
    """Against a plain loop, for stars that begin and end within a batch, with null fluxes and times; no table of trials is made or sent to the driver."""
    rng = np.random.default_rng(5)
    rows = [(s, float(t), None if k % 17 == 3 else float(np.sin(2 * np.pi * t / (2.9 + 0.01 * s)) + 0.1 * e)) for s in range(7) for k, (t, e) in enumerate(zip(np.sort(rng.uniform(0, 60, 15 + 9 * s)), rng.normal(size=99), strict=False))]
    rows.append((4, None, 0.3))
    lc = spark.createDataFrame(rows, "star_id long, time double, flux double")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "11")
    try:
        out = diagnostics.refine_by_dispersion(lc, lc.select("star_id").distinct().withColumn("p", F.lit(2.9)))
        got = {r.star_id: (round(r.p, 9), round(r.theta, 8)) for r in out.collect()}
    finally:
        spark.conf.set(key, before)
    want = {}
    for s in range(7):
        mine = [(t, f) for star, t, f in rows if star == s]
        t0, var = min(t for t, _ in mine if t is not None), np.var([f for _, f in mine if f is not None], ddof=1)
        for j in range(201):
            p, bins = 2.9 * (0.98 + 0.04 * j / 200), {}
            for t, f in mine:
                bins.setdefault(9 if t is None else min(int(((t - t0) / p) % 1 * 10), 9), []).append(f)
            bins = [b for b in bins.values() if len(b) >= 2]
            within = sum((len(b) - 1) * np.var(v, ddof=1) for b in bins if len(v := [f for f in b if f is not None]) >= 2)
            if len(mine) >= 20:
                want[s] = min(want.get(s, (9, 9)), (round(within / ((len(mine) - len(bins)) * var), 9), p))
    assert got == {s: (round(p, 9), round(theta, 8)) for s, (theta, p) in want.items()} and len(got) == 6
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
