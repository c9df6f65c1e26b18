"""The table of features of every fitted candidate, for a model that is to tell true periods from false ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periscan.operators import evidence as E
from periscan.operators import features as N
from periscan.operators.comb import rotation_periods
from periscan.operators.gather import Curves, gather
from periscan.operators.spacing import acf_peaks, coverage, spacing_histogram
from periscan.operators.spectra import acf_spectrum, finite_points, periodogram
from periscan.session import materialize

KEYS = ["star_id", "cand_id"]


def _shape(fits: DataFrame, spread: DataFrame) -> DataFrame:
    """Summaries over the teeth of each fit."""
    teeth = fits.select(*KEYS, F.posexplode("per_peak").alias("at", "t")).join(spread, "star_id").withColumn("snr", F.col("t.height") / F.nullif(F.col("acf_std"), F.lit(0.0)))
    return teeth.groupBy(*KEYS).agg(
        F.avg((F.col("t.height") > 0).cast("int")).alias("frac_positive_heights"),
        F.avg("snr").alias("mean_height_snr"),
        F.min("snr").alias("min_height_snr"),
        F.max("snr").alias("max_height_snr"),
        F.stddev_pop("snr").alias("std_height_snr"),
        F.regr_slope("snr", "at").alias("height_snr_slope"),
        F.stddev_pop("t.curvature").alias("std_curvature"),
    )


def _s_ph(fits: DataFrame, lc: DataFrame, dt: float) -> DataFrame:
    """Mean deviation of the flux over chunks of one fitted period; five whole chunks at least, each with a third of its points."""
    chunks = fits.select(*KEYS, F.rint(F.col("p") / dt).cast("long").alias("chunk")).where("chunk >= 2")
    span = lc.groupBy("star_id").agg(F.min("i").alias("lo"), (F.max("i") - F.min("i") + 1).alias("n_all"))
    placed = chunks.join(span, "star_id").withColumn("bins", F.floor(F.col("n_all") / F.col("chunk"))).where("bins >= 5").join(lc.select("star_id", "i", "flux"), "star_id")
    parts = placed.withColumn("b", F.floor((F.col("i") - F.col("lo")) / F.col("chunk"))).where("b < bins").groupBy(*KEYS, "chunk", "b").agg(F.stddev_pop("flux").alias("sd"), F.count("flux").alias("n"))
    return parts.where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("chunk") / 3))).groupBy(*KEYS).agg(F.avg("sd").alias("s_ph"))


def _star_level(lc: DataFrame, dt: float) -> DataFrame:
    hours = lambda h: max(1, round(h / 24 / dt))
    parts = [N.r_var(lc, hours(4)), N.flicker(lc, hours(8)), N.moments(lc), N.duty_cycle(lc), N.von_neumann(lc), E.band_power(lc).withColumnsRenamed({f"band_{k}": f"fliper_band_{k}" for k in (1, 2, 3)})]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "star_id", "left")
    return out


def _nearest(spectrum: DataFrame, targets: DataFrame, prefix: str, keep: dict[str, str]) -> DataFrame:
    found = E.nearest_peaks(spectrum, targets)
    return found.select("star_id", "p", *(F.col(c).alias(f"{prefix}_{n}") for c, n in keep.items()), F.col("recognised").alias(f"{prefix}_recognised"), F.col("frac_power").alias(f"{prefix}_strength"))


def feature_table(curves: Curves, truth: DataFrame | None = None, n_peaks: int = 8, rel_tol: float = 0.03, label_tol: float = 0.03) -> DataFrame:
    """A row for each fitted candidate of (star_id, i, time, flux) curves: 78 features, and ``label`` if ``truth`` (star_id, true_period) is given.

    Candidates come from the three default methods. Undefined numbers are null. Stars are worked on together, keyed by star and candidate.
    """
    lc, series, dt = curves.lc, curves.series, curves.dt
    found, _ = gather(curves)
    fits = rotation_periods(series, found, dt).where("error is null")
    fits = materialize(fits.withColumn("cand_id", F.row_number().over(Window.partitionBy("star_id").orderBy("p0"))), "fits")
    context = materialize(series.groupBy("star_id").agg(F.stddev_pop("acf").alias("acf_std"), (F.max("lag") - F.min("lag")).alias("baseline_days"), F.count("*").cast("int").alias("n_acf_points")), "context")
    targets = fits.select("star_id", "p").distinct()

    points = finite_points(lc)
    ls = materialize(periodogram(points).where("power is not null"), "ls")
    ends = points.groupBy("star_id").agg(F.count("*").alias("n"), F.var_pop("time").alias("tv"), (F.max("time") - F.min("time")).alias("span"))
    ls_near = E.nearest_peaks(ls, targets).join(ends, "star_id", "left")
    fap = E.false_alarm(F.col("peak_power"), F.col("n"), F.col("tv"), 2.5 * F.col("n") / F.col("span"))
    ls_near = ls_near.select("star_id", "p", *(F.col(a).alias(f"ls_nearest_peak_{b}") for a, b in {"peak_rank": "rank", "frac_power": "frac_power", "rel_distance": "rel_distance", "width": "width"}.items()), fap.alias("ls_nearest_peak_fap"), F.col("recognised").alias("ls_recognised"), F.col("frac_power").alias("ls_strength"))
    shared = {"peak_rank": "nearest_peak_rank", "frac_power": "nearest_peak_frac_power", "rel_distance": "nearest_peak_rel_distance", "width": "nearest_peak_width", "snr": "nearest_peak_snr"}
    fft_near = _nearest(materialize(acf_spectrum(series), "fft"), targets, "fft", shared)
    peaks = materialize(acf_peaks(series, dt), "peaks")
    bins = spacing_histogram(peaks, dt).withColumns({"freq": 1 / F.col("freq"), "power": F.col("power").cast("double")})
    hist_near = _nearest(materialize(bins, "bins"), targets, "hist", {"peak_rank": "nearest_bin_rank", "frac_power": "nearest_bin_frac_count", "rel_distance": "nearest_bin_rel_distance"})
    covered = coverage(peaks, fits.select(*KEYS, F.col("p").alias("p0"), F.col("t0").alias("first"))).select(*KEYS, F.col("coverage").alias("coverage_at_fit"), F.col("n_peaks").cast("int").alias("n_acf_peaks_found"))

    teeth = fits.select("star_id", "p", F.explode("per_peak").alias("t")).select("star_id", "p", "t.n", "t.center", "t.height")
    troughs = E.trough_depths(teeth, series)
    troughs = troughs.select("star_id", "p", *(F.col(f"{k}_depth{s}").alias(f"{k}_peak_trough_depth{s}") for s in ("", "_snr") for k in ("mean", "min", "std")))
    rivals = E.competition(fits.select(*KEYS, "p", "redchi"), rel_tol)
    other = fits.select("star_id", F.col("p").alias("p2"), F.col("source.method").alias("m2"))
    agreeing = fits.select(*KEYS, "p").join(other, "star_id").where(F.abs(F.col("p2") - F.col("p")) <= rel_tol * F.col("p")).groupBy(*KEYS).agg(F.count_distinct("m2").cast("int").alias("n_agreeing_methods"))

    wide = fits.join(context.drop("acf_std"), "star_id").join(_shape(fits, context.select("star_id", "acf_std")), KEYS, "left").join(_s_ph(fits, lc, dt), KEYS, "left").join(covered, KEYS, "left")
    for part in (troughs, ls_near, fft_near, hist_near):
        wide = wide.join(part, ["star_id", "p"], "left")
    wide = wide.join(rivals.drop("p", "redchi"), KEYS).join(agreeing, KEYS).join(_star_level(lc, dt), "star_id", "left")

    sources = ["ls", "fft", "hist"]
    recognised = F.aggregate(F.array(*(F.coalesce(F.col(f"{s}_recognised"), F.lit(False)).cast("int") for s in sources)), F.lit(0), lambda a, x: a + x)
    strengths = F.filter(F.array(*(F.col(f"{s}_strength") for s in sources)), lambda x: x.isNotNull())
    strength = F.when(F.size(strengths) > 0, F.aggregate(strengths, F.lit(0.0), lambda a, x: a + x) / F.size(strengths))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    out = wide.select(
        "star_id",
        F.col("p").alias("period"),
        F.log10(positive("p")).alias("log_period"),
        (F.col("p") / positive("baseline_days")).alias("period_frac_of_baseline"),
        (F.col("baseline_days") / positive("p")).alias("n_cycles_spanned"),
        "t0",
        "source.method",
        "source.rank",
        "source.strength",
        F.col("source.coverage").alias("coverage_at_generation"),
        F.col("p").alias("fitted_P"),
        (F.col("p_err") / positive("p")).alias("P_err_frac"),
        (F.col("t0_err") / positive("p")).alias("t0_err_frac"),
        "redchi",
        F.log10(positive("redchi")).alias("log_redchi"),
        "n_peaks_used",
        "n_peaks_dropped",
        (F.col("n_peaks_used") / n_peaks).alias("n_peaks_used_frac"),
        "frac_positive_heights",
        F.col("frac_non_increasing").alias("frac_non_increasing_height"),
        *("mean_height_snr min_height_snr max_height_snr std_height_snr height_snr_slope".split()),
        "mean_curvature",
        "std_curvature",
        "passes_min_peaks",
        "passes_redchi",
        "passes_height_snr",
        F.col("passed").alias("passed_gates"),
        "acf_std",
        "baseline_days",
        "n_acf_points",
        "s_ph",
        *(f"{k}_peak_trough_depth{s}" for s in ("", "_snr") for k in ("mean", "min", "std")),
        *(f"ls_nearest_peak_{k}" for k in ("rank", "frac_power", "rel_distance", "width", "fap")),
        *(f"fft_nearest_peak_{k}" for k in ("rank", "frac_power", "rel_distance", "width", "snr")),
        *(f"hist_nearest_bin_{k}" for k in ("rank", "frac_count", "rel_distance")),
        "coverage_at_fit",
        "n_acf_peaks_found",
        recognised.alias("n_methods_recognize_as_peak"),
        strength.alias("combined_method_strength"),
        *("r_var flicker_std flux_std flux_skewness flux_kurtosis duty_cycle von_neumann_eta fliper_band_1 fliper_band_2 fliper_band_3".split()),
        F.col("n_duplicates").cast("int").alias("n_duplicate_guesses"),
        F.size("methods").alias("n_contributing_methods"),
        F.col("n_agreeing").cast("int").alias("n_agreeing_candidates"),
        "n_agreeing_methods",
        "best_competing_redchi",
        F.col("ratio_to_competing").alias("redchi_ratio_to_best_competing"),
        F.col("ratio_to_best").alias("redchi_ratio_to_global_best"),
        F.col("harmonic_factor").isNotNull().alias("is_harmonic_of_global_best"),
        F.col("harmonic_factor").alias("harmonic_factor_of_global_best"),
        F.col("is_global_best").alias("is_global_best_redchi"),
    )
    if truth is None:
        return out
    near = F.abs(F.col("fitted_P") - F.col("true_period")) / F.col("true_period") <= label_tol
    return out.join(truth.select("star_id", "true_period"), "star_id", "left").withColumn("label", near.cast("int")).drop("true_period")
