"""Evidence for periods: their nearest peaks in spectra, depths of teeth, rivals among a star's fits, shares of power."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periscan.operators.per_star import per_star
from periscan.operators.spectra import PI2, local_maxima

#: Ratios of periods that count as harmonics of each other, tried in this order.
HARMONICS = [1 / 3, 0.5, 2.0, 3.0]


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0, by its asymptotic series eight steps further up."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * F.log(F.lit(PI2)) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        series = series - F.log(x + k)
    return series


def false_alarm(power: Column, n: Column, time_var: Column, f_max: float) -> Column:
    """Bound of the chance that noise alone reaches this standard power anywhere up to ``f_max``; null below four points."""
    one = F.pow(1 - power, (n - 3) / 2)
    scale = F.sqrt(2 / (n - 1)) * F.exp(log_gamma((n - 1) / 2) - log_gamma((n - 2) / 2))
    width = f_max * F.sqrt(2 * PI2 * time_var)
    crossings = scale * width * F.pow(1 - power, (n - 4) / 2) * F.sqrt((n - 1) * power / 2)
    return F.when((n >= 4) & (power < 1), 1 - (1 - one) * F.exp(-crossings))


def nearest_peaks(spectrum: DataFrame, targets: DataFrame, rel_tol: float = 0.03) -> DataFrame:
    """For each (star_id, p), the local maximum of (star_id, g, freq, power) whose period is nearest.

    Adds peak_rank (1 is the star's strongest), peak_power, frac_power (of the
    spectrum's largest value), rel_distance, width (between the first values at or below half
    height either side, or the ends), snr (over the median) and recognised. All maxima count, not only
    those that became candidates. Equally near maxima: the longer period. Without maxima all are null.
    """
    tops = local_maxima(spectrum).select("star_id", "g", (1 / F.col("freq")).alias("x"), "power")
    tops = tops.withColumn("peak_rank", F.row_number().over(Window.partitionBy("star_id").orderBy(F.desc("power"), "g")))
    whole = spectrum.groupBy("star_id").agg(F.max("power").alias("most"), F.expr("percentile(power, 0.5)").alias("middle"), F.min("g").alias("g0"), F.max("g").alias("g1"))
    best = F.min(F.struct(F.abs(F.col("x") - F.col("p")).alias("d"), "g", "x", F.col("power").alias("peak_power"), "peak_rank"))
    near = targets.select("star_id", "p").distinct().join(tops, "star_id").groupBy("star_id", "p").agg(best.alias("b")).select("star_id", "p", "b.*").join(whole, "star_id")
    low = spectrum.select("star_id", F.col("g").alias("at"), F.col("power").alias("v"))
    ends = near.join(low, "star_id").where("v <= peak_power / 2").groupBy("star_id", "p").agg(F.max(F.when(F.col("at") < F.col("g"), F.col("at"))).alias("left"), F.min(F.when(F.col("at") > F.col("g"), F.col("at"))).alias("right"))
    sided = near.join(ends, ["star_id", "p"], "left").withColumns({"left": F.coalesce("left", "g0"), "right": F.coalesce("right", "g1")})
    x = spectrum.select("star_id", F.col("g").alias("at"), (1 / F.col("freq")).alias("edge"))
    for side in ("left", "right"):
        sided = sided.join(x.withColumnsRenamed({"at": side, "edge": f"{side}_x"}), ["star_id", side])
    found = sided.select(
        "star_id",
        "p",
        "peak_rank",
        "peak_power",
        F.when(F.col("most") > 0, F.col("peak_power") / F.col("most")).alias("frac_power"),
        (F.col("d") / F.col("p")).alias("rel_distance"),
        F.abs(F.col("left_x") - F.col("right_x")).alias("width"),
        F.when(F.col("middle") > 0, F.col("peak_power") / F.col("middle")).alias("snr"),
    ).withColumn("recognised", F.col("rel_distance") <= rel_tol)
    return targets.join(found, ["star_id", "p"], "left")


def trough_depths(teeth: DataFrame, series: DataFrame) -> DataFrame:
    """For each (star_id, p): mean, least and deviation of its teeth's heights over the lower of the two troughs beside them.

    ``teeth`` is (star_id, p, n, center, height). A trough is the least value of the
    autocorrelation within half a period; depths are given raw and in deviations of the autocorrelation.
    """
    spread = series.groupBy("star_id").agg(F.stddev_pop("acf").alias("acf_std"))
    near = teeth.join(series.select("star_id", "lag", "acf"), "star_id").where("abs(lag - center) <= p / 2")
    depth = near.groupBy("star_id", "p", "n").agg((F.max("height") - F.min("acf")).alias("depth"))
    stats = depth.groupBy("star_id", "p").agg(F.avg("depth").alias("mean_depth"), F.min("depth").alias("min_depth"), F.stddev_pop("depth").alias("std_depth")).join(spread, "star_id")
    return stats.select("star_id", "p", *(c for k in ("mean", "min", "std") for c in (F.col(f"{k}_depth"), (F.col(f"{k}_depth") / F.nullif(F.col("acf_std"), F.lit(0.0))).alias(f"{k}_depth_snr"))))


def peak_prominence(series: DataFrame, places: DataFrame, search_frac: float = 0.5) -> DataFrame:
    """For each (star_id, p, at): the highest value within ``search_frac`` periods of lag ``at`` and its mean rise over the minima either side; null with fewer than three lags."""
    keys = ["star_id", "p", "at"]
    near = places.select(*keys).distinct().join(series.select("star_id", "lag", "acf"), "star_id").where(F.abs(F.col("lag") - F.col("at")) <= search_frac * F.col("p") + 1e-12)
    top = near.groupBy(*keys).agg(F.max(F.struct("acf", (-F.col("lag")).alias("back"))).alias("t"), F.count("*").alias("n")).where("n >= 3").select(*keys, F.col("t.acf").alias("g_height"), (-F.col("t.back")).alias("peak_lag"))
    sides = near.join(top, keys).groupBy(*keys, "g_height", "peak_lag").agg(F.min(F.when(F.col("lag") <= F.col("peak_lag"), F.col("acf"))).alias("left_min"), F.min(F.when(F.col("lag") >= F.col("peak_lag"), F.col("acf"))).alias("right_min"))
    rise = F.col("g_height") - (F.col("left_min") + F.col("right_min")) / 2
    return places.join(sides.withColumn("h_rise", rise), keys, "left")


def composite_prominence(series: DataFrame, fits: DataFrame) -> DataFrame:
    """g_height and h_rise of each fit (star_id, p, t0): the prominence of the autocorrelation's peak at its own phase."""
    return peak_prominence(series, fits.select("star_id", "p", F.col("t0").alias("at")).distinct()).withColumnRenamed("at", "t0")


def competition(fits: DataFrame, rel_tol: float = 0.03, harmonic_tol: float = 0.03) -> DataFrame:
    """How each fit (star_id, cand_id, p, redchi) stands among its star's others.

    Adds n_agreeing, best_competing_redchi (the least among fits whose period is further than
    ``rel_tol`` off), its ratio, the ratio to the star's least, is_global_best and
    harmonic_factor of that best's period. A relative tolerance is a constant
    distance of logarithms, so frames of a window find both and no pairs are made.
    """
    log = fits.withColumn("lp", F.log("p"))
    below, above = f"{-_ln(1 - rel_tol)!r}D", f"{_ln(1 + rel_tol)!r}D"
    frame = "over (partition by star_id order by {} range between {} and {})"
    star = Window.partitionBy("star_id")
    best = F.min(F.struct(F.coalesce("redchi", F.lit(float("inf"))).alias("redchi"), "cand_id", "p")).over(star)
    out = log.withColumns(
        {
            "near": F.expr("count(*) " + frame.format("lp", f"{below} preceding", f"{above} following")),
            "under": F.expr("min(redchi) " + frame.format("lp", "unbounded preceding", f"{below} preceding")),
            "over": F.expr("min(redchi) " + frame.format("lp desc", "unbounded preceding", f"{above} preceding")),
            "best": best,
        }
    )
    rival = F.least("under", "over")
    ratio = F.col("p") / F.col("best.p")
    harmonic = F.lit(None).cast("double")
    for f in reversed(HARMONICS):
        harmonic = F.when(F.abs(ratio - f) / f <= harmonic_tol, F.lit(f)).otherwise(harmonic)
    is_best = F.col("cand_id") == F.col("best.cand_id")
    return out.select(
        *fits.columns,
        (F.col("near") - 1).alias("n_agreeing"),
        rival.alias("best_competing_redchi"),
        (F.col("redchi") / F.nullif(rival, F.lit(0.0))).alias("ratio_to_competing"),
        (F.col("redchi") / F.when(F.col("best.redchi") > 0, F.col("best.redchi"))).alias("ratio_to_best"),
        is_best.alias("is_global_best"),
        F.when(~is_best & (F.abs(ratio - 1) > rel_tol), harmonic).alias("harmonic_factor"),
    )


def _ln(x: float) -> float:
    import math

    return math.log(x)


def band_power(lc: DataFrame, fractions: tuple[float, ...] = (1 / 2, 1 / 8, 1 / 32)) -> DataFrame:
    """The shares of a curve's power at and above fractions of its Nyquist frequency, as band_1, band_2, ...

    The mean goes, gaps are zero, a Hann window is laid over the whole span, and the
    spectrum has two frequencies for each independent one; the constant term is left out. Null below twenty points.
    """

    def run(i: np.ndarray, flux: np.ndarray) -> list[list[float]]:
        ok = np.isfinite(flux)
        i, flux = i[ok].astype(np.int64), flux[ok]
        if len(i) < 20:
            return [[np.nan] for _ in fractions]
        at = i - i.min()
        n = int(at.max()) + 1
        y = np.zeros(n)
        y[at] = (flux - flux.mean()) * (0.5 - 0.5 * np.cos(PI2 * at / (n - 1)))
        power = np.abs(np.fft.rfft(y, 2 * n))[1:] ** 2
        total, j = power.sum(), np.arange(1, n + 1)
        return [[power[j >= f * n].sum() / total if total > 0 else np.nan] for f in fractions]

    return per_star(lc, ["i", "flux"], run, ", ".join(f"band_{k + 1} double" for k in range(len(fractions))))
