"""Fits, spacings, wavelets, segments and streams against planted truths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from periscan.functions.fitting import gaussian_fit
from periscan.functions.significance import beta_share
from periscan.operators import acf, comb, segments, spacing, wavelet
from periscan.plans import catalogue
from periscan.sources.light_curves import planted_curve


@pytest.fixture(scope="module")
def planted(spark):
    return planted_curve(spark).cache()


@pytest.fixture(scope="module")
def series(planted):
    coarse = planted.where("i % 5 = 0").withColumn("i", (F.col("i") / 5).cast("long"))
    return acf.acf(coarse, 0.1).cache()


def test_incomplete_beta_at_known_values():
    assert abs(beta_share(2, 3, 0.4) - 0.5248) < 1e-9  # 1 - 0.6^4 - 4 * 0.4 * 0.6^3
    assert abs(beta_share(0.5, 0.5, 0.5) - 0.5) < 1e-9


def test_gaussian_is_recovered():
    x = np.linspace(-2, 2, 41)
    assert np.allclose(gaussian_fit(x, 3 * np.exp(-0.5 * ((x - 0.3) / 0.5) ** 2), 0.2), (3, 0.3, 0.5), atol=1e-4)


def test_prominence_against_hand_counts(spark):
    values = [0.0, 3.0, 1.0, 2.0, 0.5, 4.0, 0.0]
    df = spark.createDataFrame([("a", k, float(k), v) for k, v in enumerate(values)], "star_id string, k long, lag double, acf double")
    least = spark.createDataFrame([("a", 2.0)], "star_id string, least double")
    # prominences: 3 - 0.5, 2 - 1, 4 - 0
    assert sorted(r.k for r in spacing.prominent_peaks(df, least).collect()) == [1, 5]


def test_spacings_equal_a_plain_histogram(series):
    points = series.where("lag >= 0.3 - 1e-9").orderBy("k").toPandas()
    y = points["acf"].to_numpy()
    least = 5 * np.std(np.diff(series.orderBy("k").toPandas()["acf"].to_numpy(), 2))
    peaks = []
    for k in range(1, len(y) - 1):
        if y[k - 1] < y[k] > y[k + 1]:
            left, right = k, k
            while left > 0 and y[left - 1] <= y[k]:
                left -= 1
            while right < len(y) - 1 and y[right + 1] <= y[k]:
                right += 1
            if y[k] - max(y[left : k + 1].min(), y[k : right + 1].min()) >= least:
                peaks.append(int(points["k"][k]))
    gaps = np.array([(b - a) * 0.1 for i, a in enumerate(peaks) for b in peaks[i + 1 :]])
    width = max(0.4, (gaps.max() - gaps.min()) / 200)
    low, high = max(0.0, gaps.min() - width), gaps.max() + width
    counts, edges = np.histogram(gaps, max(int((high - low) / width), 10), (low, high))
    got = spacing.peak_spacings(series, 0.1).orderBy("rank").collect()
    for r in got:
        assert counts[np.searchsorted(edges, r.p0) - 1] == r.support
    inner = [int(counts[k]) for k in range(1, len(counts) - 1) if counts[k - 1] < counts[k] > counts[k + 1]]
    assert len(peaks) == 7 and [r.support for r in got] == sorted(inner, reverse=True)[:5]


def test_wavelet_finds_the_planted_period(planted):
    got = wavelet.wavelet_candidates(planted, 0.02).orderBy("rank").first()
    assert abs(got.p0 - 3.7) / 3.7 < 0.1 and got.strength == 1.0


def test_fit_and_choice_find_the_planted_period(spark, series):
    pool = spark.createDataFrame([("planted", 3.6, "x"), ("planted", 3.65, "y"), ("planted", 2.3, "x"), ("planted", 0.1, "x")], "star_id string, p0 double, method string")
    rows = comb.rotation_periods(series, pool, 0.1).orderBy("place").collect()
    assert len(rows) == 2 and {r.status for r in rows} == {"success"}
    assert abs(rows[0].p - 3.7) / 3.7 < 0.03 and rows[0].methods == ["x", "y"] and rows[0].n_duplicates == 2


def test_exact_comb_is_fitted_exactly():
    lag = np.arange(0, 40, 0.1)
    tooth = np.round((lag - 2) / 5)
    got = comb.fit_comb(lag, 0.8 - 0.1 * (lag - 2 - 5 * tooth) ** 2, 5.0, 2.1)
    assert got["redchi"] < 1e-8 and all(abs(x["center"] - 2 - 5 * x["n"]) < 1e-3 for x in got["per_peak"])


def test_too_few_teeth_are_an_error():
    assert comb.fit_comb(np.arange(0, 5, 0.1), np.zeros(50), 40.0, 1.0)["error"]


def test_segments_break_at_planted_gaps(spark):
    rng = np.random.default_rng(0)
    flux = rng.normal(size=600)
    for start in (190, 395):
        flux[start : start + 20] = np.linspace(0, 0.01, 20)
    df = spark.createDataFrame([("a", k, float(k), float(v)) for k, v in enumerate(flux)], "star_id string, i long, time double, flux double")
    points, stats = segments.split_segments(df, n_segments=3, baseline_points=101)
    sizes = {r.segment: r["count"] for r in points.groupBy("segment").count().collect()}
    assert set(sizes) == {0, 1, 2} and all(abs(sizes[k] - n) <= 4 for k, n in enumerate((200, 205, 195)))
    assert points.where("gap_mask").count() >= 20 and stats.count() == 3
    assert segments.recombine(points, stats, drop_flagged=False).where("gap_mask").count() == 0


def test_stream_equals_batch(spark, sf_dir):
    from periscan.streaming.bins import hourly_means, replay
    from periscan.session import table

    want = {(r.star_id, r.hour): (round(r.flux, 9), r.n) for r in hourly_means(table(spark, sf_dir, "events")).collect()}
    assert {(r.star_id, r.hour): (round(r.flux, 9), r.n) for r in replay(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("name", ["l4_rotation_period", "i7_recombine"])
def test_new_queries_run(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() >= 0
