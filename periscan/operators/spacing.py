"""Candidate periods from the spacings between peaks of the autocorrelation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periscan.functions.sums import tops
from periscan.operators.per_star import per_star
from periscan.operators.spectra import local_maxima
from periscan.session import materialize


def _bases(y: list[float]) -> list[float]:
    """The least value from each place back to the nearest higher one, or to the start: each place joins and leaves the stack once."""
    held: list[tuple[float, float]] = []
    out = []
    for value in y:
        least = value
        while held and held[-1][0] <= value:
            least = min(least, held.pop()[1])
        held.append((value, least))
        out.append(least)
    return out


def prominent_peaks(series: DataFrame, prominence: DataFrame) -> DataFrame:
    """(star_id, k, lag, height): local maxima of (star_id, k, lag, acf) at least ``prominence`` (star_id, least) above the higher of their two bases.

    A base is the least value up to the nearest higher value on that side, or up to
    the end. Of a flat top, the middle counts (the lower of two). A star takes time as its points do. Points without a value don't count.
    """

    def run(k: np.ndarray, lag: np.ndarray, acf: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(k)
        order = order[~np.isnan(acf[order])]
        at = tops(acf[order]) if len(order) else order
        y = acf[order].tolist()
        base = np.maximum(_bases(y), _bases(y[::-1])[::-1])
        at = at[acf[order][at] - base[at] >= least[order][at]]
        return [k[order][at], lag[order][at], acf[order][at]]

    return per_star(series.select("star_id", "k", "lag", "acf").join(prominence.select("star_id", "least"), "star_id"), ["k", "lag", "acf", "least"], run, "k long, lag double, height double")


def spacing_counts(peaks: DataFrame) -> DataFrame:
    """(star_id, d, c): how many pairs of a star's peaks are ``d`` places apart, d > 0, from the autocorrelation of the row of peaks; no pair is ever made."""

    def run(k: np.ndarray) -> list[np.ndarray]:
        here = np.zeros(int(k.max() - k.min()) + 1)
        np.add.at(here, (k - k.min()).astype(np.int64), 1)
        size = 1 << (2 * len(here) - 1).bit_length()
        pairs = np.rint(np.fft.irfft(np.abs(np.fft.rfft(here, size)) ** 2, size)[1 : len(here)]).astype(np.int64)
        d = np.flatnonzero(pairs) + 1
        return [d, pairs[d - 1]]

    return per_star(peaks, ["k"], run, "d long, c long")


def acf_peaks(series: DataFrame, dt: float, sigmas: float = 5.0) -> DataFrame:
    """(star_id, k, lag, height) of the peaks past 3 dt that stand out by ``sigmas`` deviations of the second difference."""
    w = Window.partitionBy("star_id").orderBy("k")
    second = series.withColumn("d2", F.col("acf") - 2 * F.lag("acf", 1).over(w) + F.lag("acf", 2).over(w))
    least = second.groupBy("star_id").agg((sigmas * F.stddev_pop("d2")).alias("least"))
    return prominent_peaks(series.where(F.col("lag") >= 3 * dt - 1e-9), least)


def spacing_histogram(peaks: DataFrame, dt: float) -> DataFrame:
    """(star_id, g, freq, power): centres and counts of equal bins of the spacings between all peaks of a star.

    Lags are evenly spaced, so spacings are counted by whole lags before they are binned.
    """
    spacings = spacing_counts(peaks).withColumn("x", F.col("d") * dt)
    span = spacings.groupBy("star_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).withColumn("w", F.greatest(F.lit(4 * dt), (F.col("x1") - F.col("x0")) / 200))
    span = span.withColumns({"lo": F.greatest(F.lit(0.0), F.col("x0") - F.col("w")), "hi": F.col("x1") + F.col("w")}).withColumn("n", F.greatest(F.floor((F.col("hi") - F.col("lo")) / F.col("w")), F.lit(10)))
    cells = spacings.join(span, "star_id").withColumn("g", F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("n")), F.col("n") - 1)).groupBy("star_id", "g").agg(F.sum("c").alias("c"))
    bins = span.select("star_id", "lo", "hi", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("g"))
    hist = bins.join(cells, ["star_id", "g"], "left")
    return hist.select("star_id", "g", (F.col("lo") + (F.col("g") + 0.5) * (F.col("hi") - F.col("lo")) / F.col("n")).alias("freq"), F.coalesce("c", F.lit(0)).alias("power"))


def coverage(peaks: DataFrame, combs: DataFrame) -> DataFrame:
    """Adds to combs (star_id, p0, first) the share of the star's peaks within a tenth of a period of a tooth, and their number."""
    near = combs.join(peaks.select("star_id", "lag"), "star_id")
    off = F.abs(F.col("lag") - F.col("first") - F.rint((F.col("lag") - F.col("first")) / F.col("p0")) * F.col("p0"))
    return near.groupBy(*combs.columns).agg(F.avg((off <= 0.1 * F.col("p0")).cast("int")).alias("coverage"), F.count("*").alias("n_peaks"))


def peak_spacings(series: DataFrame, dt: float, n_guesses: int = 5, sigmas: float = 5.0) -> DataFrame:
    """Candidates from the histogram of spacings between all prominent peaks: star_id, rank, p0, strength, support, coverage.

    Stars with fewer than two peaks yield nothing. coverage is the share
    of peaks within a tenth of a period of the comb through the first peak. Only
    inner bins can be maxima: the first bin often holds the least spacing, and is then passed over.
    """
    peaks = materialize(acf_peaks(series, dt, sigmas), "peaks")
    hist = materialize(spacing_histogram(peaks, dt), "spacings")
    tops = local_maxima(hist).select("star_id", "g", "freq", "power")
    lone = hist.join(tops.select("star_id").distinct(), "star_id", "left_anti").groupBy("star_id").agg(F.max_by(F.struct("g", "freq", "power"), F.struct("power", -F.col("g"))).alias("b")).select("star_id", "b.*")
    rank = F.row_number().over(Window.partitionBy("star_id").orderBy(F.desc("power"), F.desc("freq")))
    best = tops.unionByName(lone).withColumn("rank", rank).where(F.col("rank") <= n_guesses).select("star_id", "rank", F.col("freq").alias("p0"), F.col("power").alias("support"))
    firsts = peaks.groupBy("star_id").agg(F.min("lag").alias("first"))
    covered = coverage(peaks, best.join(firsts, "star_id"))
    return covered.select("star_id", "rank", "p0", (F.col("support") / F.greatest(F.col("n_peaks") - 1, F.lit(1))).alias("strength"), "support", "coverage", F.lit("pairwise_histogram").alias("method"))
