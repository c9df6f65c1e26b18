"""Fit of an evenly spaced comb of parabolas to the autocorrelation, and the choice among candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periscan.functions.fitting import bounded_fit, standard_errors
from periscan.operators.diagnostics import best_phase
from periscan.operators.pools import FACTORS
from periscan.session import materialize

PEAK = "n int, center double, height double, curvature double, residual_rms double, n_points int"
FIT = f"p double, t0 double, p_err double, t0_err double, redchi double, n_peaks_used int, n_peaks_dropped int, per_peak array<struct<{PEAK.replace(' int', ':int').replace(' double', ':double')}>>, error string"


def windows_of(lag: np.ndarray, p0: float, t0: float, n_peaks: int) -> dict[int, np.ndarray]:
    """Points within a quarter period of each tooth, up to the last lag; teeth with fewer than four are left out."""
    found = {}
    for n in range(n_peaks):
        center = t0 + n * p0
        lo, hi = max(center - p0 / 4, lag[0]), min(center + p0 / 4, lag[-1])
        if center > lag[-1] or lo >= hi:
            break
        at = np.flatnonzero((lag >= lo) & (lag <= hi))
        if len(at) >= 4:
            found[n] = at
    return found


def smallest_shifts(q: np.ndarray, teeth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of all combs with the same teeth as ``q``, the one with the smallest shifts, as far towards it as the bounds let.

    Tooth 0 has no shift and so holds the phase; without it, phase and period are those of a straight line through the teeth.
    """
    shifts = q[-len(teeth) :]
    moved = np.flatnonzero(teeth > 0)
    n, off = teeth[moved].astype(float), shifts[moved]
    step = np.zeros(len(q))
    if len(n) > 1 and len(n) == len(teeth):
        step[0], step[1] = np.polyfit(n, off, 1)
    elif len(n):
        step[0] = (n @ off) / (n @ n)
    step[len(q) - len(teeth) + moved] = -(step[1] + n * step[0])
    # The part of the way that no bound cuts off.
    with np.errstate(divide="ignore", invalid="ignore"):
        room = np.where(step > 0, (high - q) / step, np.where(step < 0, (low - q) / step, np.inf))
    return q + min(1.0, max(0.0, float(room.min()))) * step


def fit_comb(lag: np.ndarray, acf: np.ndarray, p0: float, t0: float, n_peaks: int = 8, rejects: int = 3, sigmas: float = 4.0, least: int = 2) -> dict:
    """One comb: the period, the phase, and for each tooth height, curvature and a shift of a twentieth of p0 at most.

    The tooth that fits worst is dropped, and the rest is fitted anew, while its
    residual stands out of the others' by ``sigmas`` robust deviations.

    A period can be traded for shifts that grow from tooth to tooth, so that a fit alone leaves it open: of combs
    with the same teeth, that with the smallest shifts is taken. p_err and t0_err are standard errors; for them, a shift counts as known to the deviation of an
    even draw between its bounds, and parameters at a bound as fixed. An error is missing where nothing tells the value, as with flat teeth.
    """
    held, dropped = windows_of(lag, p0, t0, n_peaks), 0
    if len(held) < least:
        return {"error": "too few teeth in the range of lags"}
    while True:
        teeth = np.array(list(held))
        count = len(teeth)
        owner = np.repeat(np.arange(count), [len(held[n]) for n in teeth])
        at = np.concatenate([held[n] for n in teeth])
        x, y, row = lag[at], acf[at], np.arange(len(at))
        heights = np.array([acf[held[n]].max() for n in teeth])
        drops = heights - np.array([acf[held[n]].min() for n in teeth])
        halves = np.array([(min(t0 + (n + 0.25) * p0, lag[-1]) - max(t0 + (n - 0.25) * p0, lag[0])) / 2 for n in teeth])
        bends = np.maximum(drops, 1e-6) / np.maximum(halves**2, 1e-6)
        shift = np.where(teeth > 0, 0.05 * p0, 0.0)

        def model(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            h, a, d = q[2 : 2 + count], q[2 + count : 2 + 2 * count], q[2 + 2 * count :]
            off = x - (q[1] + teeth * q[0] + d)[owner]
            jac = np.zeros((len(x), len(q)))
            slope = 2 * a[owner] * off
            jac[:, 0], jac[:, 1] = slope * teeth[owner], slope
            jac[row, 2 + owner] = 1
            jac[row, 2 + count + owner] = -off * off
            jac[row, 2 + 2 * count + owner] = slope
            return h[owner] - a[owner] * off * off - y, jac

        free, wide = np.full(count, np.inf), 0.5 * p0
        low = np.concatenate([[0.7 * p0, t0 - wide], -free, np.zeros(count), -shift])
        high = np.concatenate([[1.3 * p0, t0 + wide], free, free, shift])
        q, r = bounded_fit(model, np.concatenate([[p0, t0], heights, bends, np.zeros(count)]), low, high, robust=True)
        rms = np.sqrt(np.bincount(owner, r * r) / np.bincount(owner))
        if dropped == rejects or count <= least:
            break
        middle = np.median(rms)
        mad = np.median(np.abs(rms - middle))
        sigma = 1.4826 * mad if mad > 0 else rms.std()
        if sigma == 0 or rms.max() <= middle + sigmas * sigma:
            break
        del held[int(teeth[rms.argmax()])]
        dropped += 1
    q = smallest_shifts(q, teeth, low, high)
    centers = q[1] + teeth * q[0] + q[2 + 2 * count :]
    freedom = max(len(x) - (2 + 2 * count + int((teeth > 0).sum())), 1)
    per_peak = [{"n": int(n), "center": float(c), "height": float(h), "curvature": float(a), "residual_rms": float(e), "n_points": len(held[n])} for n, c, h, a, e in zip(teeth, centers, q[2:], q[2 + count :], rms, strict=False)]
    redchi = float(r @ r) / freedom
    room = 1e-9 * np.maximum(np.abs(q), p0)
    loose = np.concatenate([np.full(2 + 2 * count, np.inf), np.where(teeth > 0, shift / np.sqrt(3), np.inf)])
    errors = standard_errors(model(q)[1], r, max(redchi, 1e-18), (q > low + room) & (q < high - room), loose)
    p_err, t0_err = (None if np.isnan(e) else float(e) for e in errors[:2])
    return {"p": float(q[0]), "t0": float(q[1]), "p_err": p_err, "t0_err": t0_err, "redchi": redchi, "n_peaks_used": count, "n_peaks_dropped": dropped, "per_peak": per_peak, "error": None}


def fit_candidates(series: DataFrame, candidates: DataFrame, n_peaks: int = 8) -> DataFrame:
    """Fits (star_id, p0, t0start) on (star_id, lag, acf): adds p, t0, p_err, t0_err, redchi, n_peaks_used, n_peaks_dropped, per_peak, error.

    A group is one star: its lags and its few candidates. A failure is a row with an error.
    """
    star_type = series.schema["star_id"].dataType.simpleString()
    names = ["p", "t0", "p_err", "t0_err", "redchi", "n_peaks_used", "n_peaks_dropped", "per_peak", "error"]

    def run(wanted: pd.DataFrame, curve: pd.DataFrame) -> pd.DataFrame:
        curve = curve.sort_values("lag")
        lag, acf = curve["lag"].to_numpy(float), curve["acf"].to_numpy(float)
        rows = []
        for star, p0, start in wanted[["star_id", "p0", "t0start"]].itertuples(index=False):
            try:
                fitted = fit_comb(lag, acf, p0, start, n_peaks) if len(lag) else {"error": "no autocorrelation"}
            except (np.linalg.LinAlgError, FloatingPointError) as e:
                fitted = {"error": str(e)}
            rows.append([star, p0, start, *(fitted.get(n) for n in names)])
        out = pd.DataFrame(rows, columns=["star_id", "p0", "t0start", *names])
        return out.astype({"n_peaks_used": "Int32", "n_peaks_dropped": "Int32", "p": "float64", "t0": "float64", "p_err": "float64", "t0_err": "float64", "redchi": "float64", "star_id": object, "per_peak": object, "error": object})

    both = candidates.select("star_id", "p0", "t0start").groupBy("star_id").cogroup(series.select(F.col("star_id").alias("star"), "lag", "acf").groupBy("star"))
    return both.applyInPandas(run, f"star_id {star_type}, p0 double, t0start double, {FIT}")


def merge_close(candidates: DataFrame, rel_tol: float = 0.03) -> DataFrame:
    """Of (star_id, p0, method), those further than ``rel_tol`` from the last one kept, upwards; with n_duplicates, the methods merged, and ``source``: method, rank, strength and coverage of the one kept."""
    known = candidates.select("star_id", "p0", "method", *(F.col(c).cast(t).alias(c) if c in candidates.columns else F.lit(None).cast(t).alias(c) for c, t in (("rank", "int"), ("strength", "double"), ("coverage", "double"))))
    grouped = known.groupBy("star_id").agg(F.array_sort(F.collect_list("p0")).alias("all"))
    kept = F.expr(f"aggregate(all, cast(array() as array<double>), (acc, x) -> if(size(acc) = 0 or (x - element_at(acc, -1)) > {rel_tol} * element_at(acc, -1), array_append(acc, x), acc))")
    heads = grouped.select("star_id", kept.alias("kept"))
    placed = known.join(heads, "star_id").withColumn("p", F.expr("array_max(filter(kept, x -> x <= p0))"))
    return placed.groupBy("star_id", F.col("p").alias("p0")).agg(
        F.count("*").alias("n_duplicates"), F.array_sort(F.collect_set("method")).alias("methods"), F.min(F.when(F.col("p0") == F.col("p"), F.struct("method", "rank", "strength", "coverage"))).alias("source")
    )


def assess(fits: DataFrame, series: DataFrame) -> DataFrame:
    """Adds to fits the shares and means over their teeth, and passed: four teeth, eight tenths of positive height, a mean height of one deviation."""
    spread = series.groupBy("star_id").agg(F.stddev_pop("acf").alias("acf_std"))
    h, c = "transform(per_peak, x -> x.height)", "transform(per_peak, x -> x.curvature)"
    total = "aggregate({0}, 0D, (a, x) -> a + x) / size(per_peak)"
    steps = "transform(sequence(1, size(per_peak) - 1), j -> if(per_peak[j].height - per_peak[j - 1].height <= 1e-3 * abs(per_peak[j - 1].height), 1D, 0D))"
    out = fits.join(spread, "star_id").withColumns(
        {
            "frac_positive": F.expr("size(filter(per_peak, x -> x.height > 0)) / size(per_peak)"),
            "mean_snr": F.expr(total.format(h)) / F.col("acf_std"),
            "min_snr": F.expr(f"array_min({h})") / F.col("acf_std"),
            "mean_curvature": F.expr(total.format(c)),
            "frac_non_increasing": F.expr(f"if(size(per_peak) > 1, aggregate({steps}, 0D, (a, x) -> a + x) / (size(per_peak) - 1), null)"),
        }
    )
    flags = {
        "passes_min_peaks": F.col("n_peaks_used") >= 4,
        "passes_redchi": F.coalesce(F.col("redchi") <= 5, F.lit(False)),
        "passes_height_snr": F.coalesce(F.col("min_snr") >= 3, F.lit(False)),
    }
    return out.withColumns(flags).withColumn("passed", F.coalesce(F.col("error").isNull() & (F.col("n_peaks_used") >= 4) & (F.col("frac_positive") >= 0.8) & (F.col("mean_snr") >= 1.0), F.lit(False)))


def rotation_periods(series: DataFrame, candidates: DataFrame, dt: float) -> DataFrame:
    """All fitted candidates (star_id, p0, method, ...) of each star, best first by ``place``; ``status`` names the star's outcome.

    Candidates at 2 dt or less, or with fewer than two teeth in the lags, are left
    out; those within three hundredths are merged; phases come from a grid. The order is
    passed before failed, then by redchi. A star's status is success, none_passed or none_fitted.
    """
    span = series.groupBy("star_id").agg(F.min("lag").alias("l0"), F.max("lag").alias("l1"))
    sane = candidates.join(span, "star_id").where((F.col("p0") > 2 * dt) & (F.floor((F.col("l1") - F.col("l0")) / F.col("p0")) + 1 >= 2))
    merged = materialize(merge_close(sane.select("star_id", "p0", "method", *(c for c in ("rank", "strength", "coverage") if c in sane.columns))), "merged")
    phases = best_phase(series, merged.select("star_id", F.col("p0").alias("p")), dt).select("star_id", F.col("p").alias("p0"), F.col("t0").alias("t0start"))
    fits = assess(fit_candidates(series, phases), series).join(merged, ["star_id", "p0"])
    star = Window.partitionBy("star_id")
    order = star.orderBy(F.desc("passed"), F.asc_nulls_last("redchi"), "p0")
    status = F.when(F.max("passed").over(star), "success").when(F.max(F.col("error").isNull()).over(star), "none_passed").otherwise("none_fitted")
    return fits.withColumns({"place": F.row_number().over(order), "status": status})


def ensemble(series: DataFrame, pool: DataFrame, dt: float, shortest: float | None = None, longest: float | None = None, factors: list[float] = FACTORS, rel_tol: float = 0.03, min_peaks: int = 4) -> DataFrame:
    """All fits of a pool (star_id, p0) widened by ``factors``, best first by ``place``, with the number ``n_tried``; a star with any fit has an answer, gates or not.

    Periods outside the bounds (two cadences and the range of lags, if not given) go, and those within ``rel_tol`` of the last one kept. The
    order is: ``min_peaks`` teeth or more, eight tenths of them of positive height, the smaller redchi, the shorter period.
    """
    span = series.groupBy("star_id").agg((F.max("lag") - F.min("lag")).alias("span"))
    wide = pool.select("star_id", F.explode(F.transform(F.array(*map(F.lit, factors)), lambda f: f * F.col("p0"))).alias("p0")).distinct().join(span, "star_id")
    low, high = F.lit(2 * dt if shortest is None else shortest), F.col("span") if longest is None else F.lit(longest)
    inside = wide.where(F.col("p0").between(low, high)).select("star_id", "p0", F.lit("ensemble").alias("method"))
    merged = materialize(merge_close(inside, rel_tol).select("star_id", "p0"), "merged")
    phases = best_phase(series, merged.select("star_id", F.col("p0").alias("p")), dt).select("star_id", F.col("p").alias("p0"), F.col("t0").alias("t0start"))
    tried = merged.groupBy("star_id").agg(F.count("*").cast("int").alias("n_tried"))
    fits = assess(fit_candidates(series, phases), series).where("error is null").join(tried, "star_id")
    order = Window.partitionBy("star_id").orderBy(F.desc(F.col("n_peaks_used") >= min_peaks), F.desc(F.coalesce("frac_positive", F.lit(0.0)) >= 0.8), F.asc_nulls_last("redchi"), "p0")
    return fits.withColumn("place", F.row_number().over(order))


def comb_curve(fits: DataFrame, series: DataFrame) -> DataFrame:
    """(star_id, p0, tooth, lag, acf, model) of fitted candidates (star_id, p0, t0start, per_peak): the parabola of each tooth kept, at the lags that it was fitted to."""
    span = series.groupBy("star_id").agg(F.min("lag").alias("l0"), F.max("lag").alias("l1"))
    teeth = fits.select("star_id", "p0", "t0start", F.explode("per_peak").alias("t")).join(span, "star_id")
    middle = F.col("t0start") + F.col("t.n") * F.col("p0")
    placed = teeth.select("star_id", "p0", F.col("t.n").alias("tooth"), "t.center", "t.height", "t.curvature", F.greatest(middle - F.col("p0") / 4, "l0").alias("lo"), F.least(middle + F.col("p0") / 4, "l1").alias("hi"))
    points = placed.join(series.select("star_id", "lag", "acf"), "star_id").where((F.col("lag") >= F.col("lo")) & (F.col("lag") <= F.col("hi")))
    off = F.col("lag") - F.col("center")
    return points.select("star_id", "p0", "tooth", "lag", "acf", (F.col("height") - F.col("curvature") * off * off).alias("model"))


def outcomes(series: DataFrame, candidates: DataFrame, fits: DataFrame) -> DataFrame:
    """A row for each star: status, message, the best fit's p, t0, their errors and redchi (the closest attempt where none passed), and how many fits were tried and failed.

    The status is no_candidates, none_sane (all too short, or with fewer than two teeth), none_fitted, none_passed or success.
    """
    stars = series.select("star_id").distinct()
    proposed = candidates.select("star_id").distinct().withColumn("proposed", F.lit(True))
    tried = fits.groupBy("star_id").agg(F.count("*").alias("n_tried"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.first("status").alias("fitted"), F.min(F.when(F.col("place") == 1, F.struct("p", "t0", "redchi", "p_err", "t0_err"))).alias("b"))
    joined = stars.join(proposed, "star_id", "left").join(tried, "star_id", "left")
    status = F.when(F.col("proposed").isNull(), "no_candidates").when(F.col("fitted").isNull(), "none_sane").otherwise(F.col("fitted"))
    said = {"no_candidates": "no method proposed a period", "none_sane": "every proposed period was too short or too long", "none_fitted": "no comb could be fitted", "none_passed": "no fit passed the gates; the closest one is given", "success": "the best of the fits that passed"}
    message = F.element_at(F.create_map(*[F.lit(x) for pair in said.items() for x in pair]), F.col("status"))
    return joined.withColumn("status", status).select("star_id", "status", message.alias("message"), "b.p", "b.t0", "b.p_err", "b.t0_err", "b.redchi", F.coalesce("n_tried", F.lit(0)).alias("n_tried"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"))
