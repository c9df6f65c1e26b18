"""The fast periodogram against direct sums."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from periscan.functions.sums import sine_power, tops, wave_sums
from periscan.operators import spectra


@pytest.mark.parametrize(("points", "n"), [(1, 1), (3, 5), (200, 64), (501, 333), (40_000, 70)])
def test_sums_of_waves_equal_direct_sums(points, n):
    r = np.random.default_rng(points)
    t, c = r.uniform(-50, 200, points), r.normal(size=(2, points))
    for first, step in ((0.0, 0.003), (0.7, 0.01), (-3.0, 0.11), (5.0, 2.0)):
        got = wave_sums(t, c, first, step, n)
        want = c @ np.exp(-2j * np.pi * t[:, None] * (first + step * np.arange(n)))
        assert np.abs(got - want).max() < 1e-10 * np.abs(c).sum(1).max()


def test_tops_of_plateaus_and_ends():
    assert tops(np.array([3.0, 1, 2, 2, 2, 1, 5, 5, 4, 4, 6])).tolist() == [3, 6]
    assert tops(np.array([1.0])).tolist() == tops(np.array([2.0, 2.0])).tolist() == tops(np.array([1.0, 2.0, 3.0])).tolist() == []


def curves(spark, stars):
    return spark.createDataFrame([(s, float(a), None if b is None else float(b)) for s, (t, y) in stars.items() for a, b in zip(t, y, strict=True)], "star_id string, time double, flux double")


def hard_stars():
    r = np.random.default_rng(1)
    t = np.sort(r.uniform(0, 40, 150))
    return {
        "uneven": (t, np.sin(t) + 0.2 * r.normal(size=150)),
        "even": (np.arange(64) * 0.5, r.normal(size=64)),
        "constant": (np.arange(30.0), np.ones(30)),
        "few": (np.arange(9.0), r.normal(size=9)),
        "repeated times": (np.repeat(np.arange(20.0), 2), r.normal(size=40)),
        "one time": (np.ones(20), r.normal(size=20)),
        "with gaps": (np.arange(60) * 0.25, [None if k % 7 == 0 else float(v) for k, v in enumerate(r.normal(size=60))]),
        "not numbers": (np.arange(12.0), [float("nan")] * 12),
    }


@pytest.mark.parametrize("part", [1 << 17, 16])
def test_own_grid_equals_direct_sums(spark, monkeypatch, part):
    monkeypatch.setattr(spectra, "GRID_POINTS", part)
    lc = curves(spark, hard_stars()).withColumns({"g": F.lit(1), "power": F.lit(2.0)})  # clashing names
    points = spectra.finite_points(lc)
    for options in ({}, {"samples_per_peak": 4, "max_period": 15.0}):
        want = {(r.star_id, r.g): r for r in spectra.lomb_scargle(points, spectra.own_grid(lc, **options)).collect()}
        got = {(r.star_id, r.g): r for r in spectra.periodogram(lc, **options).collect()}
        assert got.keys() == want.keys() and {s for s, _ in got} == {"uneven", "even", "constant", "with gaps"}
        for k, r in got.items():
            assert abs(r.freq - want[k].freq) < 1e-12
            if r.power is not None:
                assert abs(r.power - want[k].power) < 1e-6
        assert all(r.power is None for (s, _), r in got.items() if s == "constant") and sum(r.power is None for (s, _), r in got.items() if s != "constant") <= 1
        # Candidates are those of the whole spectrum, however it was cut.
        spectrum = spectra.periodogram(lc, **options).where("power is not null")
        most = spectrum.groupBy("star_id").agg(F.max("power").alias("most"))
        slow = spectra.candidates(spectrum, "lombscargle").join(most, "star_id").withColumn("strength", F.col("strength") * F.col("most"))
        rows = lambda df: sorted((r.star_id, r["rank"], round(r.p0, 9), round(r.strength, 9)) for r in df.collect())
        assert rows(spectra.guess_lombscargle(lc, **options)) == rows(slow)


def test_planted_sine_is_found_and_noise_power_is_small():
    r = np.random.default_rng(3)
    t = np.sort(r.uniform(0, 300, 2000))
    span = t.max() - t.min()
    power = sine_power(t, np.sin(2 * np.pi * t / 7.3) + r.normal(size=2000), 2 / span, 1 / span / 5, 5000)
    freq = 2 / span + np.arange(5000) / span / 5
    assert abs(1 / freq[power.argmax()] / 7.3 - 1) < 0.01 and 0.25 < power.max() < 0.45
    assert np.nanmax(sine_power(t, r.normal(size=2000), 2 / span, 1 / span, 1000)) < 0.02


def test_a_long_curve_takes_seconds():
    t = np.arange(140_000) / 720
    y = np.sin(2 * np.pi * t / 3.1) + np.random.default_rng(4).normal(size=len(t))
    began = time.time()
    power = sine_power(t, y, 2 / t[-1], 1 / t[-1] / 10, 350_000)
    assert time.time() - began < 30 and abs((2 + power.argmax() / 10) / t[-1] - 1 / 3.1) < 0.1 / t[-1]


def test_no_points(spark):
    none = curves(spark, hard_stars()).limit(0)
    assert spectra.periodogram(none).count() == spectra.guess_lombscargle(none).count() == 0
