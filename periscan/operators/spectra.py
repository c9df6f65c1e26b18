"""Spectra over explicit grids, their peaks, and candidate periods."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from periscan.functions.sums import sine_power, tops
from periscan.operators.per_star import TYPES, per_star

PI2 = 2 * 3.141592653589793
#: Frequencies that a task takes at a time, so that the spectrum of a long curve is spread over many.
GRID_PART = 2048
#: Even frequencies that a task takes at a time.
GRID_POINTS = 1 << 17
#: Angles held at a time.
CELLS = 1 << 20


def grid_of(stars: DataFrame, low: str, high: str, step: str) -> DataFrame:
    """(star_id, g, freq): frequencies from ``low`` in steps of ``step`` up to ``high``, each SQL over the columns of ``stars``."""
    n = F.floor((F.expr(high) - F.expr(low)) / F.expr(step) + 1e-9).cast("long")
    return stars.select("star_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(0).cast("long")))).alias("g"), F.expr(low).alias("f0"), F.expr(step).alias("df")).select("star_id", "g", (F.col("f0") + F.col("g") * F.col("df")).alias("freq"))


def grid_shapes(lc: DataFrame, samples_per_peak: int = 1, max_period: float | None = None) -> DataFrame:
    """(star_id, low, step, n): the even frequencies from half of each star's time span, or ``max_period``, down to four median steps, ``samples_per_peak`` to a peak's width 1 / span.

    Points without time or flux don't count; stars with fewer than ten, or of no span or step, have no grid.
    """
    points = finite_points(lc).select("star_id", "time")
    step = F.col("time") - F.lag("time").over(Window.partitionBy("star_id").orderBy("time"))
    stars = points.withColumn("dt", step).groupBy("star_id").agg(F.count("*").alias("n"), (F.max("time") - F.min("time")).alias("span"), F.expr("percentile(dt, 0.5)").alias("dt"))
    stars = stars.where("n >= 10 and span > 0 and dt > 0").withColumns({"low": F.lit(1 / max_period) if max_period else 2 / F.col("span"), "step": 1 / (samples_per_peak * F.col("span"))})
    stars = stars.withColumn("high", 1 / (4 * F.col("dt"))).where("high >= low")
    return stars.select("star_id", "low", "step", F.expr("cast(bround((high - low) / step) as long) + 1").alias("n"))


def own_grid(lc: DataFrame, samples_per_peak: int = 1, max_period: float | None = None) -> DataFrame:
    """(star_id, g, freq) of :func:`grid_shapes`, a row for each frequency."""
    return grid_of(grid_shapes(lc, samples_per_peak, max_period), "low", "low + (n - 1) * step", "step")


def finite_points(lc: DataFrame) -> DataFrame:
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("time", "flux")]
    return lc.where(ok[0] & ok[1])


def guess_lombscargle(lc: DataFrame, method: str = "lombscargle", n_guesses: int = 5, samples_per_peak: int = 1, max_period: float | None = None) -> DataFrame:
    """The strongest local maxima of each star's periodogram on its own grid as periods, or its largest value where it has none, with the power itself as strength.

    Only these leave a task: of each part of a star's grid its best maxima, and its largest value in case there are none.
    """
    found = _over_parts(lc, samples_per_peak, max_period, _best(n_guesses), "top boolean, g long, freq double, power double")
    any_top = F.max("top").over(Window.partitionBy("star_id"))
    rank = F.row_number().over(Window.partitionBy("star_id").orderBy(F.desc("power"), "freq"))
    ranked = found.withColumn("any", any_top).where(F.col("top") == F.col("any")).withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("any"), n_guesses).otherwise(1))
    return ranked.select("star_id", (1 / F.col("freq")).alias("p0"), F.col("power").alias("strength"), "rank", F.lit(method).alias("method"))


def periodogram(lc: DataFrame, samples_per_peak: int = 1, max_period: float | None = None) -> DataFrame:
    """(star_id, g, freq, power): standard power of a sine with a floating mean, on each star's own grid. Null where a frequency is not determined.

    A star takes time as its points and frequencies do, not as their product: see :func:`periscan.functions.sums.wave_sums`.
    """
    return _over_parts(lc, samples_per_peak, max_period, lambda g, freq, power, inner: [g[inner], freq[inner], power[inner]], "g long, freq double, power double")


def _best(n_guesses: int):
    def run(g: np.ndarray, freq: np.ndarray, power: np.ndarray, inner: np.ndarray) -> list[np.ndarray]:
        known = np.flatnonzero(~np.isnan(power))
        if not len(known):
            return [np.zeros(0, bool), *(np.zeros(0),) * 3]
        top = known[tops(power[known])]
        top = top[inner[top]]
        top = top[np.lexsort((g[top], -power[top]))][:n_guesses]
        own = known[inner[known]]
        highest = own[[np.argmax(power[own])]] if len(own) else own
        at = np.concatenate([top, highest])
        return [np.arange(len(at)) < len(top), g[at], freq[at], power[at]]

    return run


def _over_parts(lc: DataFrame, samples_per_peak: int, max_period: float | None, made: Callable[..., list], ddl: str) -> DataFrame:
    """What ``made`` gives of each star's periodogram. Grids of over ``GRID_POINTS`` frequencies, as curves with short steps in long spans have, are cut into parts that
    overlap by one frequency on either side; ``inner`` tells a part's own. Each part gets the whole curve."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / GRID_POINTS)))
    shapes = grid_shapes(lc, samples_per_peak, max_period).select("star_id", "low", "step", "n", parts.alias("part"))
    points = finite_points(lc).select("star_id", F.col("time").cast("double").alias("time"), F.col("flux").cast("double").alias("flux"))
    given = points.join(shapes.select("star_id", "part"), "star_id").select(F.col("star_id").alias("of"), F.col("part").alias("share"), "time", "flux")
    names = [x.split()[0] for x in ddl.split(", ")]
    types = [TYPES[x.split()[1]] for x in ddl.split(", ")]

    def run(shape: pa.Table, curve: pa.Table) -> pa.Table:
        low, step, n, part = (shape.column(c)[0].as_py() for c in ("low", "step", "n", "part"))
        begin, end = max(0, part * GRID_POINTS - 1), min(n, (part + 1) * GRID_POINTS + 1)
        g = np.arange(begin, end)
        power = sine_power(curve.column("time").to_numpy(), curve.column("flux").to_numpy(), low + begin * step, step, len(g))
        out = made(g, low + g * step, power, g // GRID_POINTS == part)
        star = shape.column("star_id").take(pa.array(np.zeros(len(out[0]), np.int64)))
        return pa.table([star, *(pa.array(x, t, from_pandas=True) for x, t in zip(out, types, strict=True))], names=["star_id", *names])

    star = lc.schema["star_id"].dataType.simpleString()
    both = shapes.groupBy("star_id", "part").cogroup(given.groupBy("of", "share"))
    return both.applyInArrow(run, f"star_id {star}, {ddl}")


def lomb_scargle(lc: DataFrame, grid: DataFrame) -> DataFrame:
    """Standard power of a sine with a floating mean, by closed form from ten sums for each frequency of (star_id, g, freq), which may be any. Even grids take :func:`periodogram`, which is far faster.

    A star's grid is cut into parts that are worked on apart, each with the
    whole curve. Null where a frequency is not determined. Points without flux don't count.
    """
    parts = grid.withColumn("part", F.floor(F.col("g") / GRID_PART))
    samples = lc.where("flux is not null").select("star_id", F.col("time").cast("double").alias("time"), F.col("flux").cast("double").alias("flux"))
    given = samples.join(parts.select("star_id", "part").distinct(), "star_id").select(F.col("star_id").alias("of"), F.col("part").alias("share"), "time", "flux")

    def run(wanted: pa.Table, curve: pa.Table) -> pa.Table:
        freq = wanted.column("freq").to_numpy()
        t, y = curve.column("time").to_numpy(), curve.column("flux").to_numpy()
        power = np.full(len(freq), np.nan)
        if len(t):
            t, y = t - t.min(), y - y.mean()
            step = max(1, CELLS // len(t))
            for k in range(0, len(freq), step):
                angle = PI2 * freq[k : k + step, None] * t
                c, s = np.cos(angle), np.sin(angle)
                mc, ms = c.mean(1), s.mean(1)
                cc, ss, cs = (c * c).mean(1) - mc * mc, (s * s).mean(1) - ms * ms, (c * s).mean(1) - mc * ms
                yc, ys = c @ y / len(y), s @ y / len(y)
                below = (y * y).mean() * (cc * ss - cs * cs)
                power[k : k + step] = np.divide(yc * yc * ss + ys * ys * cc - 2 * yc * ys * cs, below, out=np.full(len(below), np.nan), where=below != 0)
        return pa.table([wanted.column("star_id"), wanted.column("g"), wanted.column("freq"), pa.array(power, from_pandas=True)], names=["star_id", "g", "freq", "power"])

    star = grid.schema["star_id"].dataType.simpleString()
    both = parts.select("star_id", "part", "g", "freq").groupBy("star_id", "part").cogroup(given.groupBy("of", "share"))
    return both.applyInArrow(run, f"star_id {star}, g long, freq double, power double").where("g is not null")


def spectrum_of(k: np.ndarray, lag: np.ndarray, acf: np.ndarray, oversample: int = 4, min_period: float | None = None, max_period: float | None = None, taper: bool = True) -> list[np.ndarray]:
    """g, freq and power of one star; see :func:`acf_spectrum`."""
    order = np.argsort(k)
    lag, y = lag[order], acf[order] - acf.mean()
    n, dt = len(lag), np.median(np.diff(lag)) if len(lag) > 1 else np.nan
    none = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
    if n < 4:
        return none
    if taper:
        y = y * (0.5 - 0.5 * np.cos(PI2 * np.arange(n) / (n - 1)))
    size = max(int(oversample * n), n)
    g = np.arange(size // 2 + 1)
    freq = g / (size * dt)
    low, high = 1 / (max_period or (lag[-1] - lag[0]) / 2), 1 / (min_period or 4 * dt)
    inside = (freq > low * (1 + 1e-12)) & (freq < high * (1 - 1e-12))
    if inside.sum() < 3:
        return none
    return [g[inside], freq[inside], np.abs(np.fft.rfft(y, size))[inside] ** 2]


def acf_spectrum(series: DataFrame, oversample: int = 4, min_period: float | None = None, max_period: float | None = None, taper: bool = True) -> DataFrame:
    """(star_id, g, freq, power) of (star_id, k, lag, acf): squared modulus of its transform, less its mean and under a Hann window.

    The series is padded to ``oversample`` times its length. Frequencies lie
    strictly between 1 / ``max_period`` (half the range of lags if None) and 1 / ``min_period`` (four
    lags); stars with fewer than three of them have no rows.
    """

    return per_star(series, ["k", "lag", "acf"], lambda k, lag, acf: spectrum_of(k, lag, acf, oversample, min_period, max_period, taper), "g long, freq double, power double")


def guess_acf_fft(series: DataFrame, method: str = "acf_fft", n_guesses: int = 5, **options) -> DataFrame:
    """Candidates of the spectrum of each star's autocorrelation; options are those of :func:`acf_spectrum`."""
    return candidates(acf_spectrum(series, **options), method, n_guesses)


def local_maxima(spectrum: DataFrame) -> DataFrame:
    """Points above both neighbours; of a flat top, the middle (the lower of two). Ends are never maxima."""
    w = Window.partitionBy("star_id").orderBy("g")
    change = F.coalesce((F.col("power") != F.lag("power").over(w)).cast("int"), F.lit(1))
    runs = spectrum.withColumn("run", F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("star_id", "run").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.first("power").alias("power"))
    v = Window.partitionBy("star_id").orderBy("run")
    tops = runs.withColumns({"left": F.lag("power").over(v), "right": F.lead("power").over(v)}).where("power > left and power > right")
    return tops.select("star_id", F.floor((F.col("g0") + F.col("g1")) / 2).alias("g"), "power").join(spectrum.select("star_id", "g", "freq"), ["star_id", "g"])


def candidates(spectrum: DataFrame, method: str, n_guesses: int = 5) -> DataFrame:
    """The strongest local maxima of each star as periods, or its largest value where it has none: star_id, p0, strength (of the largest value), rank, method. Ties go to the longer period."""
    peaks = local_maxima(spectrum).select("star_id", "freq", "power")
    highest = F.max_by(F.struct("freq", "power"), F.struct("power", -F.col("g")))
    top = spectrum.groupBy("star_id").agg(F.max("power").alias("most"), highest.alias("b"))
    known = peaks.join(top, "star_id", "right")
    named = known.select("star_id", F.coalesce("freq", "b.freq").alias("freq"), (F.coalesce("power", "b.power") / F.when(F.col("most") > 0, F.col("most"))).alias("strength"))
    rank = F.row_number().over(Window.partitionBy("star_id").orderBy(F.desc("strength"), "freq"))
    ranked = named.withColumn("rank", rank).where(F.col("rank") <= n_guesses)
    return ranked.select("star_id", (1 / F.col("freq")).alias("p0"), F.coalesce("strength", F.lit(0.0)).alias("strength"), "rank", F.lit(method).alias("method"))
