"""Evidence, pools and FITS files against brute force and hand-made bytes; every SQL equivalent against DuckDB."""

import math
import struct

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import periscan.plans.evidence  # noqa: F401
from periscan.operators import evidence, pools, spectra
from periscan.plans import catalogue
from periscan.sources import fits

NAMES = ["n9_nearest_peaks", "n8_trough_depths", "m3_peak_prominence", "n11_competition", "n10_band_power", "k6_highpass_sweep", "k12_harmonics", "o8_rank_histogram", "p4_rate_by_factor", "q7_phase_fold", "i12_sigma_clip", "k2_false_alarm", "k2_periodogram", "k2_lombscargle_candidates", "k4_lombscargle_short_candidates", "k2_false_alarm_own_grid"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("events", "orders", "customer", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    want = db.execute(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want) > 0

    def rows(frame):
        return sorted([tuple(None if v is None or v is pd.NA or v != v else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)], key=repr)

    wrong = [(a, b) for a, b in zip(rows(got), rows(want), strict=True) if any((x is None) != (y is None) or (isinstance(x, float) and abs(x - y) > 2e-5) or (isinstance(x, str) and x != y) for x, y in zip(a, b, strict=True))]
    assert not wrong, wrong[:3]


def test_log_gamma(spark):
    rows = spark.createDataFrame([(x,) for x in (0.5, 1.0, 3.5, 40.0)], "x double").select("x", evidence.log_gamma(F.col("x")).alias("g")).collect()
    assert all(abs(r.g - math.lgamma(r.x)) < 1e-9 for r in rows)


def test_competition_of_one_fit_and_of_null_redchi(spark):
    df = spark.createDataFrame([("a", 1, 5.0, 2.0), ("b", 1, 5.0, None), ("b", 2, 10.0, 1.0), ("b", 3, 5.05, 3.0)], "star_id string, cand_id long, p double, redchi double")
    got = {(r.star_id, r.cand_id): r for r in evidence.competition(df).collect()}
    assert got["a", 1].best_competing_redchi is None and got["a", 1].is_global_best and got["a", 1].ratio_to_best == 1.0
    assert got["b", 1].n_agreeing == 1 and got["b", 1].harmonic_factor == 0.5 and got["b", 2].is_global_best and got["b", 2].best_competing_redchi == 3.0


def test_spectrum_without_maxima_gives_nulls(spark):
    flat = spark.createDataFrame([("a", g, 1.0 + g, 1.0) for g in range(5)], "star_id string, g long, freq double, power double")
    r = evidence.nearest_peaks(flat, spark.createDataFrame([("a", 0.4)], "star_id string, p double")).first()
    assert r.peak_rank is None and r.width is None


def test_window_names(spark):
    rows = spark.createDataFrame([("acf_fft_hp2.5d",), ("acf_fft_hp10d",), ("wavelet",)], "m string").select(pools.window_of(F.col("m")).alias("w")).collect()
    assert [r.w for r in rows] == [2.5, 10.0, None]


def test_sector_keeps_its_unflagged_orbit(spark):
    points = spark.createDataFrame([("a", s, float(s), 1.0) for s in (0, 0, 1, 2, 3)], "star_id string, segment int, time double, flux double")
    stats = spark.createDataFrame([("a", 0, False), ("a", 1, True), ("a", 2, True), ("a", 3, True)], "star_id string, segment int, flagged boolean")
    got = {r.sector: r for r in pools.sector_collection(points, stats).collect()}
    assert got[1].orbits == [0] and got[1].orbits_excluded == [1] and got[1].n_points == 2 and got[1].flagged
    assert got[2].orbits == [] and got[2].n_points == 0 and got[2].start_time is None


def cards(*pairs):
    text = "".join(f"{k:<8}= {v:>20}".ljust(80) for k, v in pairs) + "END".ljust(80)
    return text.ljust(-(-len(text) // 2880) * 2880).encode()


def fits_file(rows):
    first = cards(("SIMPLE", "T"), ("BITPIX", 8), ("NAXIS", 0), ("PERIOD", "3.7"), ("BFLY", "F"))
    head = cards(
        ("XTENSION", "'BINTABLE'"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", 17), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", 3),
        ("EXTNAME", "'LIGHTCURVE'"), ("TFORM1", "'D'"), ("TTYPE1", "'TIME'"), ("TFORM2", "'5A'"), ("TTYPE2", "'NOTE'"), ("TFORM3", "'1E'"), ("TTYPE3", "'FLUX'"),
    )
    body = b"".join(struct.pack(">d5sf", t, b"note ", v) for t, v in rows)
    return first + head + body.ljust(-(-len(body) // 2880) * 2880, b"\0")


def test_fits_round_trip(spark, tmp_path):
    (tmp_path / "s1.fits").write_bytes(fits_file([(0.0, 1.5), (0.5, float("nan")), (1.0, 0.75)]))
    (tmp_path / "s2.fits").write_bytes(b"not a header".ljust(2880))
    rows = fits.light_curves(spark, str(tmp_path)).orderBy("star_id", "i").collect()
    assert [(r.star_id, r.i, r.time, r.flux) for r in rows[:3]] == [("s1", 0, 0.0, 0.5), ("s1", 1, 0.5, None), ("s1", 2, 1.0, -0.25)]
    assert len(rows) == 4 and rows[3].error and rows[3].flux is None
    heads = {r.star_id: (r.PERIOD, r.BFLY, r.INCL) for r in fits.headers(spark, str(tmp_path), ["PERIOD", "BFLY", "INCL"]).collect()}
    assert heads == {"s1": (3.7, 0.0, None), "s2": (None, None, None)}


def test_full_sweep_goes_on_to_long_windows_and_equals_sql(spark, sf_dir):
    test_query_equals_sql(spark, sf_dir, "k6_highpass_sweep_full")
    rows = catalogue.queries()["k6_highpass_sweep_full"](spark, sf_dir).select("window_days").distinct().collect()
    assert sorted(r.window_days for r in rows) == [2.0, 5.0, 10.0, 20.0]  # at this scale no curve has enough points for 40 days


def test_periodogram_on_each_stars_own_grid(spark):
    import numpy as np

    r, curves = np.random.default_rng(5), {}
    for star, span, dt, period in (("long", 90.0, 0.25, 23.0), ("fast", 4.0, 0.01, 0.07), ("few", 9.0, 1.0, 3.0)):
        t = np.arange(0, span, dt) + r.uniform(0, dt / 10, len(np.arange(0, span, dt)))
        curves[star] = t, np.sin(2 * np.pi * t / period) + 0.1 * r.normal(size=len(t))
    lc = spark.createDataFrame([(s, float(a), float(b)) for s, (t, y) in curves.items() for a, b in zip(t, y, strict=True)] + [("long", 9.5, None)], "star_id string, time double, flux double")
    rows = spectra.guess_lombscargle(lc).collect()
    for star, planted in (("long", 23.0), ("fast", 0.07)):
        t, y = curves[star]
        y, span, high = y - y.mean(), t.max() - t.min(), 1 / (4 * np.median(np.diff(t)))
        grid = 2 / span + np.arange(1 + round((high - 2 / span) * span)) / span
        power = []
        for f in grid:
            x = np.stack([np.ones_like(t), np.cos(2 * np.pi * f * t), np.sin(2 * np.pi * f * t)], 1)
            power.append(1 - np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2) / np.sum(y * y))
        tops = sorted(((power[k], 1 / grid[k]) for k in range(1, len(grid) - 1) if power[k] > power[k - 1] and power[k] > power[k + 1]), reverse=True)[:5]
        got = sorted((x.rank, x.p0, x.strength) for x in rows if x.star_id == star)
        assert abs(got[0][1] / planted - 1) < 0.2
        assert len(got) == len(tops) and all(abs(p - q) < 2e-6 and abs(s - v) < 2e-6 for (_, p, s), (v, q) in zip(got, tops, strict=True))
    assert not [x for x in rows if x.star_id == "few"]
