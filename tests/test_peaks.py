"""Prominences, spacings and errors of fits against plain loops, and the queries of peaks against DuckDB."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import periscan.plans.analytics  # noqa: F401
import periscan.plans.peaks  # noqa: F401
import periscan.plans.search  # noqa: F401
import periscan.plans.tables  # noqa: F401
from periscan.functions.fitting import standard_errors
from periscan.operators import comb, spacing
from periscan.plans import catalogue
from test_evidence import test_query_equals_sql as equals_sql


@pytest.mark.parametrize("name", ["e9_prominent_peaks", "k1_spacing_histogram", "k1_pairwise_events", "d9_group_quantiles", "t_guess_acf_fft", "t_guess_lombscargle", "d16_bin_medians", "d16_bin_trimmed_means", "q7_phase_medians", "k11_comb_score_weights", "i8_sector_points", "i8_chosen_sectors", "s2_streamed_bins", "o6_batch_failures", "o1_method_outcomes", "o4_batch_summary", "k10_gathered", "o8_rate_by_window", "o8_rate_by_window_and_band", "p5_merged_stars", "p3_zero_all_parameters", "p3_zero_candidates", "o5_event_windows", "m2_pdm_refine_users", "k11_t0_grid", "e14_interpolated", "f4_every_tenth", "p11_missed_fast_stars"])
def test_queries_equal_sql(spark, sf_dir, name):
    equals_sql(spark, sf_dir, name)


def test_choice_and_features_of_the_event_curves(spark, sf_dir):
    """Errors and quality of the chosen periods; the features of the same fits."""
    out = catalogue.queries()["l4_event_outcomes"](spark, sf_dir).collect()
    stars = {r.star_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("star_id")).distinct().collect()}
    assert {r.star_id for r in out} == stars
    for r in out:
        assert r.status in ("success", "none_passed", "none_fitted") and (r.p is None) == (r.status == "none_fitted") and r.n_tried > 0
        assert r.p_err is None or r.p_err > 0  # none for a period at its bound; in noise it may pass the period
    assert any(r.p_err for r in out)
    rows = catalogue.queries()["n_event_features"](spark, sf_dir).collect()
    assert {r.star_id for r in rows} <= stars and rows and all(r.P_err_frac is None or r.P_err_frac > 0 for r in rows) and any(r.P_err_frac for r in rows) and any(r.t0_err_frac for r in rows)


def prominences(y):
    """{place: (height, prominence)} of all tops, by looking both ways from each."""
    found, k = {}, 0
    while k < len(y):
        end = k
        while end + 1 < len(y) and y[end + 1] == y[k]:
            end += 1
        if 0 < k and end < len(y) - 1 and y[k - 1] < y[k] > y[end + 1]:
            at = (k + end) // 2
            left = right = at
            while left > 0 and y[left - 1] <= y[at]:
                left -= 1
            while right < len(y) - 1 and y[right + 1] <= y[at]:
                right += 1
            found[at] = (y[at], y[at] - max(min(y[left : at + 1]), min(y[at : right + 1])))
        k = end + 1
    return found


def test_prominence_equals_plain_search(spark):
    r = np.random.default_rng(6)
    stars = {f"s{j}": (r.integers(0, 6, n) / 4.0 if j % 2 else np.cumsum(r.normal(size=n))).tolist() for j, n in enumerate((1, 2, 3, 40, 90, 300, 301))}
    stars["flat"] = [1.0] * 20
    rows = [(s, k, k * 0.5, v) for s, y in stars.items() for k, v in enumerate(y)] + [("s3", 40, 20.0, None)]
    series = spark.createDataFrame(rows, "star_id string, k long, lag double, acf double").withColumns({"height": F.lit(1), "least": F.lit("clash")}).repartition(4)
    for least in (0.0, 0.3, 1.0):
        limit = series.select("star_id").distinct().withColumn("least", F.lit(least))
        got = {(x.star_id, x.k): (x.lag, x.height) for x in spacing.prominent_peaks(series, limit).collect()}
        want = {(s, k): (k * 0.5, h) for s, y in stars.items() for k, (h, p) in prominences(y).items() if p >= least}
        assert got == want


def test_spacings_equal_all_pairs(spark):
    r = np.random.default_rng(7)
    places = {s: sorted(r.choice(400, n, replace=False).tolist()) for s, n in (("a", 60), ("b", 2), ("c", 1))}
    peaks = spark.createDataFrame([(s, k) for s, ks in places.items() for k in ks], "star_id string, k long")
    want = {}
    for s, ks in places.items():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                want[s, b - a] = want.get((s, b - a), 0) + 1
    assert {(x.star_id, x.d): x.c for x in spacing.spacing_counts(peaks).collect()} == want


def test_long_series_take_seconds(spark):
    n = 140_000
    noise = F.pmod(F.xxhash64("id"), F.lit(1000)) / 4000.0
    series = spark.range(n).select(F.lit(1).alias("star_id"), F.col("id").alias("k"), (F.col("id") / 48).alias("lag"), (F.cos(F.col("id") / 60.0) + noise).alias("acf"))
    limit = spark.createDataFrame([(1, 1.0)], "star_id int, least double")
    began = time.time()
    peaks = spacing.prominent_peaks(series, limit)
    assert abs(peaks.count() - n / (120 * np.pi)) < 3
    assert spacing.spacing_counts(spacing.prominent_peaks(series, limit.withColumn("least", F.lit(0.0)))).count() > 100_000 and time.time() - began < 60


def test_errors_by_the_inverse_of_the_information():
    r = np.random.default_rng(8)
    jac, res = r.normal(size=(50, 4)), 0.1 * r.normal(size=50)
    loose = np.array([np.inf, np.inf, 0.2, np.inf])
    weight = (1 + res**2) ** -1.5 / 0.01
    want = np.sqrt(np.diag(np.linalg.inv((jac.T * weight) @ jac + np.diag(1 / loose**2))))
    assert np.allclose(standard_errors(jac, res, 0.01, np.ones(4, bool), loose), want)
    # Two columns that are one: neither is told, unless one is known besides or fixed.
    twin = jac.copy()
    twin[:, 1] = twin[:, 0]
    none = np.full(4, np.inf)
    assert np.isnan(standard_errors(twin, res, 0.01, np.ones(4, bool), none)).tolist() == [True, True, False, False]
    assert np.isnan(standard_errors(twin, res, 0.01, np.array([True, False, True, True]), none)).tolist() == [False, True, False, False]
    assert not np.isnan(standard_errors(twin, res, 0.01, np.ones(4, bool), np.array([np.inf, 0.1, np.inf, np.inf]))).any()
    assert np.isnan(standard_errors(0 * jac, res, 0.01, np.ones(4, bool), none)).all()


def planted(r, period, t0, spread, noise, teeth=6):
    lag = np.arange(0, t0 + teeth * period, period / 40)
    n = np.clip(np.rint((lag - t0) / period), 0, teeth - 1).astype(int)
    shift = np.concatenate([[0], r.uniform(-spread, spread, teeth - 1)])
    off = lag - t0 - n * period - shift[n]
    return lag, 0.8**n - 3 * off * off / period**2 + noise * r.normal(size=len(lag))


def test_errors_cover_planted_combs():
    r = np.random.default_rng(9)
    hits, n = {"p": 0, "t0": 0}, 120
    for _ in range(n):
        period, t0 = r.uniform(2, 6), r.uniform(2, 6)
        fit = comb.fit_comb(*planted(r, period, t0, 0.04 * period, 0.02), period * r.uniform(0.98, 1.02), t0 + 0.02, n_peaks=6)
        assert fit["error"] is None and 0 < fit["p_err"] < 0.05 * period and 0 < fit["t0_err"] < 0.1 * period
        hits["p"] += abs(fit["p"] - period) <= 2 * fit["p_err"]
        hits["t0"] += abs(fit["t0"] - t0) <= 2 * fit["t0_err"]
    assert min(hits.values()) >= 0.9 * n
    exact = comb.fit_comb(*planted(r, 4.0, 3.0, 0.0, 0.0), 4.01, 3.01, n_peaks=6)
    assert abs(exact["t0"] - 3) < 1e-4 and exact["t0_err"] < 1e-4 and abs(exact["p"] - 4) <= 2 * exact["p_err"]


def test_teeth_stay_where_they_are_as_shifts_shrink():
    teeth = np.array([0, 1, 3, 4])
    q = np.array([5.0, 2.0, *np.ones(8), 0.0, 0.1, 0.35, 0.38])
    low, high = np.array([4.0, 0.0, *np.full(8, -9.0), 0, -0.4, -0.4, -0.4]), np.array([6.0, 4.0, *np.full(8, 9.0), 0, 0.4, 0.4, 0.4])
    got = comb.smallest_shifts(q, teeth, low, high)
    place = lambda x: x[1] + teeth * x[0] + x[10:]
    assert np.allclose(place(got), place(q)) and got[1] == 2.0 and abs(got[0] - 5 - (0.1 + 3 * 0.35 + 4 * 0.38) / 26) < 1e-12
    high[0] = 5.01  # as far as the period may go
    assert np.isclose(comb.smallest_shifts(q, teeth, low, high)[0], 5.01)
    late = comb.smallest_shifts(np.array([5.0, 2.0, *np.ones(4), 0.1, 0.2]), np.array([1, 2]), np.full(8, -9.0), np.full(8, 9.0))
    assert np.allclose(late[[0, 1, 6, 7]], [5.1, 2.0, 0, 0])
