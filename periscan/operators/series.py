"""Windows over evenly numbered series (star_id, i, time, flux)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rows(before: int, after: int):
    return Window.partitionBy("star_id").orderBy("i").rowsBetween(-before, after)


def rolling_std(lc: DataFrame, window: int = 9, into: str = "roll") -> DataFrame:
    """Centred sample standard deviation over ``window`` points; null where there is one point."""
    return lc.withColumn(into, F.stddev_samp("flux").over(_rows(window // 2, (window - 1) // 2)))


def rolling_median(lc: DataFrame, column: str, window: int, min_periods: int, into: str = "baseline") -> DataFrame:
    """Centred median of ``column`` over ``window`` points, null with fewer than ``min_periods`` values."""
    w = _rows(window // 2, (window - 1) // 2)
    return lc.withColumn(into, F.when(F.count(column).over(w) >= min_periods, F.expr(f"percentile({column}, 0.5)").over(w)))


def boxcar(lc: DataFrame, window: int, into: str = "trend") -> DataFrame:
    """Centred mean; an even window has one point more before than after. Needs a third of the window."""
    w = _rows(window // 2, (window - 1) // 2)
    return lc.withColumn(into, F.when(F.count("flux").over(w) >= max(1, window // 3), F.avg("flux").over(w)))


def highpass(lc: DataFrame, window: int) -> DataFrame:
    """The flux without its boxcar trend; a window of one point or less leaves it as it is."""
    return lc if window <= 1 else boxcar(lc, window).withColumn("flux", F.col("flux") - F.col("trend")).drop("trend")


def differences(lc: DataFrame) -> DataFrame:
    """First and second differences of the flux along each star."""
    w = Window.partitionBy("star_id").orderBy("i")
    one = F.col("flux") - F.lag("flux", 1).over(w)
    two = F.col("flux") - 2 * F.lag("flux", 1).over(w) + F.lag("flux", 2).over(w)
    return lc.withColumns({"d1": one, "d2": two})


def islands(lc: DataFrame, flag: Column, min_width: int) -> DataFrame:
    """Runs of flagged points at least ``min_width`` long: star_id, start_i, end_i, width, center_time."""
    w = Window.partitionBy("star_id").orderBy("i")
    numbered = lc.withColumn("n", F.row_number().over(w)).where(F.coalesce(flag, F.lit(False)))
    runs = numbered.withColumn("run", F.col("n") - F.row_number().over(w)).groupBy("star_id", "run")
    return runs.agg(F.min("i").alias("start_i"), F.max("i").alias("end_i"), F.count("*").alias("width"), F.avg("time").alias("center_time")).where(F.col("width") >= min_width).drop("run")


def candidate_gaps(lc: DataFrame, roll_window: int = 9, baseline_points: int = 241, thresh: float = 0.2, min_width: int = 10) -> DataFrame:
    """Stretches that look interpolated: the rolling deviation stays below a share of its local median."""
    rolled = rolling_median(rolling_std(lc, roll_window), "roll", baseline_points | 1, max(1, baseline_points // 4))
    return islands(rolled, F.col("roll") < thresh * F.col("baseline"), min_width)


def trailing_std(lc: DataFrame, window: int = 20, into: str = "roll") -> DataFrame:
    """Sample standard deviation of the last ``window`` points; null until there are as many values."""
    w = _rows(window - 1, 0)
    return lc.withColumn(into, F.when(F.count("flux").over(w) == window, F.stddev_samp("flux").over(w)))


def is_close(a: Column, b: Column, rel_tol: float) -> Column:
    return F.abs(a - b) <= F.lit(1e-8) + rel_tol * F.abs(b)


def modal_cadence(lc: DataFrame, step: float, rel_tol: float = 0.01) -> DataFrame:
    """(star_id, cadence, differs): the commonest distance of neighbours in seconds, the least of equals, and whether ``step`` (days) is another one."""
    gap = F.rint((F.col("time") - F.lag("time").over(Window.partitionBy("star_id").orderBy("time"))) * 86400)
    modes = lc.select("star_id", gap.alias("gap")).where("gap is not null").groupBy("star_id", "gap").agg(F.count("*").alias("n"))
    most = modes.groupBy("star_id").agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("cadence"))
    return most.withColumn("differs", ~is_close(F.lit(step * 86400), F.col("cadence"), rel_tol))


def slope(lc: DataFrame) -> DataFrame:
    """(star_id, slope): of the least-squares line through time and flux."""
    return lc.groupBy("star_id").agg(F.regr_slope("flux", "time").alias("slope"))


def histogram(values: DataFrame, column: str, n_bins: int) -> DataFrame:
    """(star_id, bin, lo, hi, n): counts of equal bins from each star's least to its largest value; the last bin holds that, empty bins count 0."""
    known = values.where(F.col(column).isNotNull())
    ends = known.groupBy("star_id").agg(F.min(column).alias("a"), F.max(column).alias("b")).where("b > a")
    at = F.least(F.floor((F.col(column) - F.col("a")) / (F.col("b") - F.col("a")) * n_bins), F.lit(n_bins - 1)).cast("int")
    counts = known.join(ends, "star_id").groupBy("star_id", at.alias("bin")).agg(F.count("*").alias("n"))
    bins = ends.select("star_id", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    edge = lambda k: F.col("a") + (F.col("b") - F.col("a")) * k / n_bins
    return bins.join(counts, ["star_id", "bin"], "left").select("star_id", "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def even_cadence(lc: DataFrame, step: float) -> DataFrame:
    """Every star on an even grid from its first time: the nearest grid point, the last of several, null where there is none.

    With a column flux_err, the error of the chosen point comes along.
    """
    times = lc.groupBy("star_id").agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    grid = times.select("star_id", "t0", F.explode(F.sequence(F.lit(0), F.rint((F.col("t1") - F.col("t0")) / step).cast("long"))).alias("i"))
    values = [c for c in ("flux", "flux_err") if c in lc.columns]
    placed = lc.join(times, "star_id").select("star_id", F.rint((F.col("time") - F.col("t0")) / step).cast("long").alias("i"), F.struct("time", *values).alias("o"))
    last = placed.groupBy("star_id", "i").agg(F.max("o").alias("o"))
    return grid.join(last, ["star_id", "i"], "left").select("star_id", "i", (F.col("t0") + F.col("i") * step).alias("time"), *(F.col(f"o.{c}").alias(c) for c in values))


def bin_curve(lc: DataFrame, width: float, statistic: Callable[[str], Column] = F.avg) -> DataFrame:
    """``statistic`` of the flux (its mean) in bins from each star's first time; a last bin that is not full is dropped, empty bins are null.

    A statistic is any aggregate of a column: a built-in one, one made of those (:mod:`periscan.functions.statistics`), or a grouped-aggregate pandas
    function. The last two get one bin of one star at a time, whole. With a column flux_err, a bin's error is the root of the sum of its squares over the number of its rows.
    """
    times = lc.groupBy("star_id").agg(F.min("time").alias("t0"), F.max("time").alias("t1"))
    errors = [(F.sqrt(F.sum(F.col("flux_err") * F.col("flux_err"))) / F.count("*")).alias("flux_err")] if "flux_err" in lc.columns else []
    last = F.floor((F.col("t1") - F.col("t0")) / width - 1e-9)
    grid = times.select("star_id", "t0", last.alias("bins"), F.explode(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)))).alias("i")).where("i < bins")
    placed = lc.join(times, "star_id").withColumn("i", F.floor((F.col("time") - F.col("t0")) / width))
    cells = summarised(placed, ["star_id", "i"], statistic, "flux", F.count("flux").alias("n"), *errors)
    return grid.join(cells, ["star_id", "i"], "left").select("star_id", F.col("i").cast("long").alias("i"), (F.col("t0") + (F.col("i") + 0.5) * width).alias("time"), "flux", *(["flux_err"] if errors else []), F.coalesce("n", F.lit(0)).alias("n"))


def summarised(df: DataFrame, keys: list[str], statistic: Callable[[str], Column], into: str, *others: Column) -> DataFrame:
    """``statistic`` of the flux by ``keys`` as ``into``, beside other aggregates; Python aggregates can't share a pass with built-in ones, and get their own."""
    own = statistic("flux").alias(into)
    if not hasattr(statistic, "evalType"):
        return df.groupBy(*keys).agg(own, *others)
    return df.groupBy(*keys).agg(*others).join(df.where("flux is not null").groupBy(*keys).agg(own), keys, "left")


def interpolate(lc: DataFrame) -> DataFrame:
    """Null flux filled linearly between its neighbours, and by the nearest value at the ends."""
    back = Window.partitionBy("star_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("star_id").orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("flux").isNotNull(), F.struct("i", "flux"))
    a, b = F.last(known, True).over(back), F.first(known, True).over(ahead)
    w = lc.withColumns({"a": a, "b": b})
    lerp = F.col("a.flux") + (F.col("b.flux") - F.col("a.flux")) * (F.col("i") - F.col("a.i")) / F.greatest(F.col("b.i") - F.col("a.i"), F.lit(1))
    return w.withColumn("flux", F.coalesce("flux", lerp, "a.flux", "b.flux")).drop("a", "b")
