"""Gathering, batch tables, feature table, files and jobs."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from periscan import jobs
from periscan.operators import comb, spectra
from periscan.operators.acf import acf
from periscan.operators.feature_table import feature_table
from periscan.operators.gather import METHODS, Curves, batch, gather
from periscan.sources import files
from periscan.sources import light_curves as L


@pytest.fixture(scope="module")
def stars(spark, sf_dir):
    return L.planted_stars(spark, sf_dir, n=2400).where("star_id in ('planted-0', 'planted-7')").cache()


def flat(spark):
    return spark.range(30).select(F.lit("flat").alias("star_id"), F.col("id").alias("i"), (F.col("id") * 0.02).alias("time"), F.lit(1.0).alias("flux"))


def test_a_long_curve_takes_seconds(spark):
    n = 140_000
    lc = spark.range(n).select(F.lit(7).alias("star_id"), F.col("id").alias("i"), F.when(F.col("id") % 11 != 0, F.sin(F.col("id") / 50.0)).alias("flux"))
    began = time.time()
    found = spectra.guess_acf_fft(acf(lc, 1 / 48), n_guesses=1).collect()
    assert time.time() - began < 30
    assert abs(found[0].p0 - 2 * np.pi * 50 / 48) < 0.02


def test_acf_equals_sums_over_pairs(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(size=90)
    y[[4, 5, 40]] = np.nan
    rows = [("s", k, float(v)) for k, v in enumerate(y) if np.isfinite(v)]
    got = {r.k: (r.acf, r.n_pairs) for r in acf(spark.createDataFrame(rows, "star_id string, i long, flux double"), 1.0).collect()}
    x = y - np.nanmean(y)
    want = {k: (np.nanmean(x[: 90 - k] * x[k:]), int(np.isfinite(x[: 90 - k] * x[k:]).sum())) for k in range(30)}
    assert sorted(got) == list(range(30))
    assert all(abs(got[k][0] - want[k][0] / want[0][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)


def test_the_band_is_open_and_needs_three_frequencies(spark):
    series = spark.range(40).select(F.lit("s").alias("star_id"), F.col("id").alias("k"), (F.col("id") * 0.5).alias("lag"), F.cos(F.col("id") / 3.0).alias("acf"))
    freq = [r.freq for r in spectra.acf_spectrum(series).collect()]
    assert min(freq) > 2 / 19.5 and max(freq) < 0.5 and all(abs(f * 80 - round(f * 80)) < 1e-9 for f in freq)
    assert spectra.acf_spectrum(series, min_period=3.0, max_period=3.2).count() == 0


def test_gathering(spark, stars):
    both = stars.drop("true_period").unionByName(flat(spark)).unionByName(stars.select(F.lit("holed").alias("star_id"), "i", "time", F.when(F.col("i") % 50 > 2, F.col("flux")).alias("flux")).where("i < 2000").dropDuplicates(["i"]))
    curves = Curves.of(both, 0.02)
    with pytest.raises(ValueError, match="unknown methods: nothing"):
        gather(curves, ["acf_fft", "nothing"])
    found, failed = gather(curves, list(METHODS), n_guesses=3, options={"acf_fft_highpass": {"windows_days": [2, 5]}})
    rows = found.collect()
    assert {r.method for r in rows if r.star_id == "planted-7"} >= {"acf_fft", "acf_fft_short", "acf_fft_hp2d", "acf_fft_hp5d", "lombscargle", "lombscargle_short", "wavelet"}
    assert all(1 <= r["rank"] <= 3 for r in rows) and all((r.smoothing_window is not None) == r.method.startswith("acf_fft_hp") for r in rows)
    assert ("holed", "wavelet") in {(r.star_id, r.method) for r in failed.collect()}
    best = min(abs(r.p0 - 2.37) / 2.37 for r in rows if r.star_id == "planted-7")
    assert best < 0.03


def test_exceptions_are_failures_of_one_star_and_method(spark, stars):
    curves = Curves.of(stars.drop("true_period").unionByName(flat(spark).withColumn("flux", F.col("i") % 3 + 0.0)), 0.02)
    found, failed = gather(curves, ["acf_fft", "acf_fft_short", "lombscargle", "wavelet"], options={"acf_fft": {"min_period": "short"}, "wavelet": {"fill": True}})
    lost = {(r.star_id, r.method): r.error for r in failed.collect()}
    told = lost[("planted-7", "acf_fft")]
    assert {s for s, m in lost if m == "acf_fft"} == {"planted-0", "planted-7", "flat"} and told == lost[("planted-0", "acf_fft")] and told.startswith("TypeError: ")
    assert lost.get(("flat", "wavelet"), "no peak stands out") == "no peak stands out"
    assert {r.method for r in found.where("star_id = 'planted-7'").select("method").distinct().collect()} == {"acf_fft_short", "lombscargle", "wavelet"}
    few = Curves.of(stars.drop("true_period").where("i < 9 or i > 2390").withColumn("flux", F.when((F.col("i") < 4) | (F.col("i") > 2395), F.col("flux"))), 0.02)
    errors = {r.error for r in gather(few, ["lombscargle", "wavelet"])[1].collect()}
    assert {e for e in errors if "points" in e} == {"fewer than ten finite points: 8"} and any(e.startswith("the flux has ") for e in errors)


def test_every_star_and_method_has_a_row(spark, stars):
    lc = stars.drop("true_period").unionByName(flat(spark))
    known = stars.select("star_id", "true_period").distinct().unionByName(spark.createDataFrame([("flat", 1.0), ("absent", None)], "star_id string, true_period double")).withColumn("rank", F.lit("clash"))
    got = batch(lc, known, 0.02, list(METHODS), [2, 1000], every_window=True)
    rows = got.summary.collect()
    assert len(rows) == 2 * (len(METHODS) + 1) and {r.smoothing_window for r in rows} == {None, 2.0, 1000.0}
    assert all(r["rank"] == "clash" for r in got.candidates.collect())
    assert all(r.found_true_period == (r.rank_of_true_period is not None) for r in rows) and any(r.found_true_period for r in rows)
    lost = {(r.star_id, r.method) for r in got.failures.collect()}
    assert {("flat", "__load_or_acf__"), ("absent", "__load_or_acf__")} <= lost
    plain = batch(lc, known, 0.02, ["acf_fft", "acf_fft_highpass"], [1000]).summary.collect()
    assert sorted((r.star_id, r.method) for r in plain) == sorted((s, m) for s in ("planted-0", "planted-7") for m in ("acf_fft", "acf_fft_highpass"))


def test_feature_table(spark, stars):
    curves = Curves.of(stars.drop("true_period"), 0.02)
    table = feature_table(curves, stars.select("star_id", "true_period").distinct())
    assert len(table.columns) == 79 and table.columns[-1] == "label"
    rows = table.collect()
    assert {r.star_id for r in rows} == {"planted-0", "planted-7"} and any(r.label for r in rows)
    for r in rows:
        assert r["rank"] >= 1 and 0 < r.strength <= 1 and 0 <= r.frac_positive_heights <= 1 and r.n_agreeing_methods >= 1
        assert abs(r.period_frac_of_baseline * r.n_cycles_spanned - 1) < 1e-9
    assert sum(r.is_global_best_redchi for r in rows) == 2
    assert len(feature_table(curves).columns) == 78


def test_outcomes(spark, stars):
    lc = stars.drop("true_period")
    curves = Curves.of(lc, 0.02)
    pool = spark.createDataFrame([("planted-0", 0.01, "short"), ("planted-7", 2.37, "true")], "star_id string, p0 double, method string")
    got = {r.star_id: r for r in comb.outcomes(curves.series, pool, comb.rotation_periods(curves.series, pool, 0.02)).collect()}
    assert got["planted-0"].status == "none_sane" and got["planted-7"].status == "success" and abs(got["planted-7"].p - 2.37) < 0.1
    none = comb.outcomes(curves.series, pool.limit(0), comb.rotation_periods(curves.series, pool.limit(0), 0.02)).collect()
    assert {r.status for r in none} == {"no_candidates"}


def test_lists_and_csv(spark, tmp_path):
    (tmp_path / "list.txt").write_text(" b.fits \n\n  \na.fits\n")
    assert files.paths(spark, list_file=f"file://{tmp_path}/list.txt") == ["b.fits", "a.fits"]
    assert files.paths(spark, glob=f"file://{tmp_path}/*.txt") == [f"file:{tmp_path}/list.txt"]
    with pytest.raises(ValueError):
        files.paths(spark)
    df = spark.createDataFrame([(0, "x,\"y", 1.5), (1, None, None)], "n int, a string, b double")
    files.write_csv(df, f"file://{tmp_path}/t.csv")
    back = files.read_csv(spark, f"file://{tmp_path}/t.csv", "n int, a string, b double")
    assert sorted(map(tuple, back.collect())) == [(0, "x,\"y", 1.5), (1, None, None)]
    assert files.read_csv(spark, f"file://{tmp_path}/t.csv", index=True).columns == ["a", "b"]


def test_jobs(spark, stars, sf_dir, tmp_path):
    stars.drop("true_period").write.parquet(f"file://{tmp_path}/lc")
    known = stars.select("star_id", "true_period").distinct().withColumns({"activity": F.length("star_id") + 0.5, "diffrot": F.lit(-0.2)})
    files.write_csv(known, f"file://{tmp_path}/known")
    jobs.main(["batch", "--curves", f"file://{tmp_path}/lc", "--parameters", f"file://{tmp_path}/known", "--out", f"file://{tmp_path}/out", "--timestep", "1728", "--methods", "acf_fft", "lombscargle"])
    rows = files.read_csv(spark, f"file://{tmp_path}/out/summary.csv").collect()
    assert len(rows) == 4 and all(r.n_candidates > 0 and r.activity > 0 for r in rows)
    jobs.main(["analyse", "--summary", f"file://{tmp_path}/out/summary.csv", "--out", f"file://{tmp_path}/stats"])
    cut = {r.method: r for r in files.read_csv(spark, f"file://{tmp_path}/stats/structural_cutoffs.csv").collect()}
    assert cut["acf_fft"].n_below == 2 and cut["wavelet"].n_below == 0


def test_every_table_of_the_analysis(spark, tmp_path):
    """A summary of made-up stars, of which active ones are found."""
    import os

    stars = spark.range(160).select(F.concat(F.lit("s"), "id").alias("star_id"), (F.col("id") * 37 % 80 + 0.5).alias("true_period"), ((F.col("id") * 13) % 29 / 10 + 0.1).alias("activity"), ((F.col("id") * 7) % 21 / 10 - 1).alias("diffrot"), (F.col("id") % 90).alias("incl"))
    methods = spark.createDataFrame([("acf_fft", None), ("wavelet", None), ("acf_fft_highpass", 2.0), ("acf_fft_highpass", 5.0)], "method string, smoothing_window double")
    found = (F.col("activity") > 1.2) & (F.col("true_period") < 60) & ~((F.col("method") == "wavelet") & (F.col("incl") < 30))
    rows = stars.crossJoin(methods).withColumns({"found_true_period": found, "n_candidates": F.when(F.col("activity") < 0.6, 0).otherwise(5), "rank_of_true_period": F.when(found, 1), "matched_p0": F.when(found, F.col("true_period"))})
    files.write_csv(rows, f"file://{tmp_path}/summary.csv")
    jobs.main(["analyse", "--summary", f"file://{tmp_path}/summary.csv", "--out", f"file://{tmp_path}/out", "--trees", "20", "--leaf", "5"])
    made = {name.removesuffix(".csv") for name in os.listdir(tmp_path / "out")}
    assert made == {
        "hit_rates", "structural_cutoffs", "zero_candidate_correlations", "restricted_subsample", "merged_full", "spearman_correlations", "sweeps", "sweeps_by_band", "star_totals",
        "zero_rate_by_activity", "rate_by_diffrot", "rate_by_window", "rate_by_window_and_band", "feature_importance",
    }
    read = lambda name: files.read_csv(spark, f"file://{tmp_path}/out/{name}.csv").collect()
    pure = [r.asDict() for r in rows.collect()]
    assert len(read("merged_full")) == 160 and {r.star_id for r in read("restricted_subsample")} == {r["star_id"] for r in pure if r["true_period"] <= 50}
    many = {s: len({r["method"] for r in pure if r["star_id"] == s and r["found_true_period"]}) for s in {r["star_id"] for r in pure}}
    assert {r.star_id: (r.n_methods_found, r.found_by_any) for r in read("merged_full")} == {s: (n, n > 0) for s, n in many.items()}
    rates = {r.smoothing_window: (round(r.hit_rate, 6), r.n) for r in read("rate_by_window")}
    want = {w: [r["found_true_period"] for r in pure if r["smoothing_window"] == w] for w in (2.0, 5.0)}
    assert rates == {w: (round(sum(x) / 160, 6), 160) for w, x in want.items()}
    bands = {(r.smoothing_window, r.band): r.n for r in read("rate_by_window_and_band")}
    assert bands[2.0, 4] == sum(r["true_period"] > 50 for r in pure) // 4 and sum(bands.values()) == 320
    importance = {r.parameter: r.importance for r in read("feature_importance")}
    assert set(importance) == {"period", "activity", "diffrot", "incl"} and max(importance, key=importance.get) == "activity" and abs(sum(importance.values()) - 1) < 1e-6
    assert sum(r.n for r in read("rate_by_diffrot")) <= len(read("restricted_subsample")) and {r.method for r in read("zero_rate_by_activity")} == {"acf_fft", "wavelet", "acf_fft_highpass"}
    zero = {(r.method, r.parameter): r for r in read("zero_candidate_correlations")}
    assert zero["acf_fft", "activity"].median_when_zero < 0.6 < zero["acf_fft", "activity"].median_when_nonzero
