"""Pools of candidate periods: sweeps over high-pass windows, harmonics, names of methods; and sectors of a curve."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periscan.operators.acf import acf
from periscan.operators.benchmark import cut, geometric_edges
from periscan.operators.series import highpass, summarised
from periscan.operators.spectra import guess_acf_fft

#: Factors by which a pool of periods may be widened.
FACTORS = [1.0, 0.5, 2.0, 1 / 3, 3.0]


#: Windows of the sweep, in days.
WINDOWS = [2.0, 5.0, 10.0, 20.0, 40.0]


def highpass_sweep(lc: DataFrame, dt: float, windows_days: list[float] = WINDOWS, n_guesses: int = 5, max_period: float = 50.0, oversample: int = 8, **acf_options) -> DataFrame:
    """Candidates from the autocorrelation's spectrum after each of several high-pass windows, ranked within star and window.

    All windows go through one autocorrelation and one spectrum, keyed by star and
    window. A star whose curve gives none at a window has no rows there.
    """
    star_type = lc.schema["star_id"].dataType
    keyed = None
    for days in windows_days:
        one = highpass(lc, round(days / dt)).select(F.concat(F.lit(f"{float(days)}|"), F.col("star_id").cast("string")).alias("star_id"), "i", "flux")
        keyed = one if keyed is None else keyed.unionByName(one)
    found = guess_acf_fft(acf(keyed, dt, **acf_options), "acf_fft_hp", n_guesses, max_period=max_period, oversample=oversample)
    window = F.substring_index("star_id", "|", 1).cast("double")
    star = F.expr("substring(star_id, locate('|', star_id) + 1)").cast(star_type)
    return found.select(star.alias("star_id"), window.alias("window_days"), method_of(window).alias("method"), "rank", "p0", "strength")


def method_of(window: Column) -> Column:
    """The name of the sweep's method at a window, without a trailing zero."""
    return F.concat(F.lit("acf_fft_hp"), F.regexp_replace(window.cast("string"), r"\.0$", ""), F.lit("d"))


def window_of(method: Column) -> Column:
    """The high-pass window in a method's name; null for other methods."""
    return F.nullif(F.regexp_extract(method, r"^acf_fft_hp([\d.]+)d$", 1), F.lit("")).cast("double")


def expand_harmonics(pool: DataFrame, shortest: float, longest: float, factors: list[float] = FACTORS) -> DataFrame:
    """The pool (star_id, p0, ...) with each period also halved, doubled and so on, within the bounds; ``factor`` says how."""
    wide = pool.withColumn("factor", F.explode(F.array(*map(F.lit, factors)))).withColumn("p0", F.col("p0") * F.col("factor"))
    return wide.where(F.col("p0").between(shortest, longest))


def sector_points(points: DataFrame, stats: DataFrame, sectors: list[int] | None = None, exclude_flagged: bool = False, normalise: bool = True) -> DataFrame:
    """(star_id, sector, segment, time, flux) of the points of two segments each, numbered from 1.

    Without ``sectors``, all are kept; with ``exclude_flagged``, flagged segments go, and a sector keeps its other one. With
    ``sectors``, only those, and one with any flagged segment goes as a whole. A segment without a row in ``stats`` counts as
    not flagged. With ``normalise``, the flux is divided by the median of what its sector keeps; null where that is 0.
    """
    sector = (F.floor(F.col("segment") / 2) + 1).cast("int")
    bad = stats.where("flagged").select("star_id", "segment").distinct()
    kept = points.select("star_id", sector.alias("sector"), "segment", "time", "flux")
    if sectors is not None:
        kept = kept.where(F.col("sector").isin(list(sectors))).join(bad.select("star_id", sector.alias("sector")).distinct(), ["star_id", "sector"], "left_anti")
    elif exclude_flagged:
        kept = kept.join(bad, ["star_id", "segment"], "left_anti")
    if normalise:
        # One sector of one star, a month of a curve, to a buffer.
        middle = kept.groupBy("star_id", "sector").agg(F.median("flux").alias("middle"))
        kept = kept.join(middle, ["star_id", "sector"]).withColumn("flux", F.col("flux") / F.nullif(F.col("middle"), F.lit(0.0)))
    return kept.select("star_id", "sector", "segment", "time", "flux")


def sector_collection(points: DataFrame, stats: DataFrame, exclude_flagged: bool = True) -> DataFrame:
    """A row for each star and sector (two segments, numbered from 1): its orbits, those left out, whether any was flagged, points and span.

    A sector keeps its other orbit when one is flagged; with both flagged it has no points.
    """
    marked = stats.select("star_id", "segment", "flagged").withColumn("sector", (F.floor(F.col("segment") / 2) + 1).cast("int"))
    per = points.groupBy("star_id", "segment").agg(F.count("flux").alias("n"), F.min("time").alias("t0"), F.max("time").alias("t1"))
    out = F.col("flagged") & F.lit(exclude_flagged)
    both = marked.join(per, ["star_id", "segment"], "left")
    return both.groupBy("star_id", "sector").agg(
        F.array_sort(F.collect_set(F.when(~out, F.col("segment")))).alias("orbits"),
        F.array_sort(F.collect_set(F.when(out, F.col("segment")))).alias("orbits_excluded"),
        F.max("flagged").alias("flagged"),
        F.sum(F.when(~out, F.coalesce("n", F.lit(0))).otherwise(0)).alias("n_points"),
        F.min(F.when(~out, F.col("t0"))).alias("start_time"),
        F.max(F.when(~out, F.col("t1"))).alias("end_time"),
    )


def phase_fold(lc: DataFrame, periods: DataFrame, n_bins: int = 20, statistic: Callable[[str], Column] = F.avg) -> DataFrame:
    """Mean (or another ``statistic``, see :func:`periscan.operators.series.bin_curve`), population deviation and count of the flux in bins of phase, for each (star_id, p, t0)."""
    cycle = (F.col("time") - F.col("t0")) / F.col("p")
    bins = F.least(F.floor((cycle - F.floor(cycle)) * n_bins), F.lit(n_bins - 1)).cast("int")
    folded = periods.join(lc.where("flux is not null").select("star_id", "time", "flux"), "star_id").withColumn("bin", bins)
    return summarised(folded, ["star_id", "p", "bin"], statistic, "mean", F.stddev_pop("flux").alias("std"), F.count("*").alias("n"))


def rank_histogram(matched: DataFrame, ranks: int = 5) -> DataFrame:
    """How often each method's true period has each rank, with zeros for ranks that never occur."""
    grid = matched.select("method").distinct().select("method", F.explode(F.sequence(F.lit(1), F.lit(ranks))).alias("rank_of_true_period"))
    counts = matched.groupBy("method", "rank_of_true_period").agg(F.count("*").alias("n"))
    return grid.join(counts, ["method", "rank_of_true_period"], "left").na.fill(0, ["n"])


def rate_by_factor(summary: DataFrame, column: str, lowest: float, n_bins: int = 8) -> DataFrame:
    """Hit rate and count by method in geometric bins from the least value (``lowest`` at least) to the largest, open below and closed above."""
    x = F.greatest(F.col(column), F.lit(lowest))
    ends = summary.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))  # one row
    binned = summary.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bin", cut(x, geometric_edges(F.col("lo"), F.col("hi"), n_bins)))
    return binned.where("bin is not null").groupBy("method", "bin").agg(F.avg("found").alias("hit_rate"), F.count("*").alias("n"))


def sigma_clip(df: DataFrame, column: str, below: float = 2.5, above: float = 3.0, rounds: int = 5) -> DataFrame:
    """Rows of each star whose ``column`` stays within deviations of its median, found anew after each round; null values go."""
    star = Window.partitionBy("star_id")
    kept = df.where(F.col(column).isNotNull())
    for _ in range(rounds):
        spread = kept.withColumns({"middle": F.expr(f"percentile({column}, 0.5)").over(star), "sigma": F.stddev_pop(column).over(star)})
        off = F.col(column) - F.col("middle")
        kept = spread.where((off >= -below * F.col("sigma")) & (off <= above * F.col("sigma"))).drop("middle", "sigma")
    return kept


def pool_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """The distinct (star_id, p0) of two pools."""
    return first.select("star_id", "p0").unionByName(second.select("star_id", "p0")).distinct()


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; order decides."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def sector_lists(lists: DataFrame, last: int = 13) -> DataFrame:
    """Distinct lists of sectors up to ``last``, in the order in which they first occur, of (i, sectors: text such as "[1, 2]")."""
    parsed = lists.select("i", F.filter(F.from_json("sectors", "array<int>"), lambda x: x <= last).alias("sectors"))
    return parsed.groupBy("sectors").agg(F.min("i").alias("first"), F.count("*").alias("n"))


def attach(rows: DataFrame, parameters: DataFrame, key: str = "star_id") -> DataFrame:
    """Rows with the columns of their star; where names clash, the star's win."""
    return rows.drop(*(c for c in parameters.columns if c != key)).join(parameters, key, "left")


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of the same candidates as one, matched by key instead of by position."""
    return left.join(right, keys)
