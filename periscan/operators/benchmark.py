"""Benchmark tables and detectability statistics over (star_id, method, n_candidates, found, period, activity)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periscan.operators.quantiles import group_quantiles
from periscan.session import materialize, shuffle_partitions

# Labelled bands of periods in days, open below and closed above.
BANDS = [0, 1, 10, 20, 50]


def correlation(x: str, y: str) -> Column:
    """Pearson's r over the rows that have both; null where either does not vary."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(F.when(both, F.col(x))) * F.stddev_pop(F.when(both, F.col(y))), F.lit(0.0))


def matches(p0: Column, truth: Column, rel_tol: float) -> Column:
    """Within ``rel_tol`` of the truth; false where there is none, or it is 0."""
    return F.coalesce((F.abs(p0 - truth) / F.nullif(truth, F.lit(0.0)) <= rel_tol) & ~F.isnan(truth), F.lit(False))


def rank_of_true(candidates: DataFrame, rel_tol: float = 0.15) -> DataFrame:
    """Per star and method of (star_id, method, rank, p0, true_period): candidates, and the rank and period of the first match."""
    hit = matches(F.col("p0"), F.col("true_period"), rel_tol)
    first = F.min(F.when(hit, F.struct("rank", "p0")))
    return candidates.groupBy("star_id", "method").agg(F.count("*").alias("n_candidates"), F.max(hit).alias("found_true_period"), first.alias("b")).select("star_id", "method", "n_candidates", "found_true_period", F.col("b.rank").alias("rank_of_true_period"), F.col("b.p0").alias("matched_p0"))


def hit_rate(summary: DataFrame) -> DataFrame:
    return summary.groupBy("method").agg(F.avg("found").alias("hit_rate"), F.count("*").alias("n"))


def band_of(x: Column, edges: list[float] = BANDS) -> Column:
    """The number of the right-closed band; null at or below the lowest edge; the last band is open."""
    out = F.when(x > edges[-1], len(edges) - 1)
    for k in range(len(edges) - 2, -1, -1):
        out = out.when((x > edges[k]) & (x <= edges[k + 1]), k)
    return out


def hit_rate_by_band(summary: DataFrame, methods: list[str]) -> DataFrame:
    """Hit rates with a row for each period band and a column for each method."""
    return summary.withColumn("band", band_of(F.col("period"))).where("band is not null").groupBy("band").pivot("method", methods).agg(F.avg("found"))


def cutoffs(summary: DataFrame, ceiling: float) -> DataFrame:
    """Hit rates and counts at or below a structural ceiling of the period, and above it."""
    low = F.col("period") <= ceiling
    return summary.groupBy("method").agg(
        F.avg(F.when(low, F.col("found"))).alias("hit_rate_below"), F.count_if(low).alias("n_below"), F.avg(F.when(~low, F.col("found"))).alias("hit_rate_above"), F.count_if(~low).alias("n_above")
    )


def zero_candidates(summary: DataFrame, is_zero: Column) -> DataFrame:
    """How often a method finds little, and whether that goes with activity: point-biserial r, rate and medians."""
    z = summary.withColumn("z", is_zero.cast("int"))
    out = z.groupBy("method").agg(correlation("z", "activity").alias("point_biserial_r"), F.avg("z").alias("zero_rate"))
    return out.join(_medians(z, ["method"], "activity"), "method", "left")


def _medians(z: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(``keys``, median_when_zero, median_when_nonzero) of the rows with z = 1 and z = 0: few groups, of any size."""
    both = group_quantiles(z.where("z is not null"), [*keys, "z"], column, [0.5])
    return both.groupBy(*keys).agg(*(F.max(F.when(F.col("z") == k, F.col("value"))).alias(name) for k, name in ((1, "median_when_zero"), (0, "median_when_nonzero"))))


def restricted(summary: DataFrame, cutoff: float) -> DataFrame:
    """A row for each star up to the cutoff: how many methods found it, and whether any did."""
    return summary.where(F.col("period") <= cutoff).groupBy("star_id").agg(F.sum("found").alias("n_methods_found"), F.max("found").alias("found_by_any"), F.max("period").alias("period"), F.max("activity").alias("activity"))


def average_rank(df: DataFrame, column: str, into: str, spread: int | None = None) -> DataFrame:
    """Adds average ranks (ties share the mean of theirs); rows without a value are left out. See :func:`rank_correlations`."""
    values = df.where(F.col(column).isNotNull()).groupBy(F.lit("").alias("parameter"), column).agg(F.count("*").alias("m"))
    return df.join(_ranks(values, column, into, spread or shuffle_partitions(df.sparkSession)).drop("parameter"), column)


def _ranks(values: DataFrame, of: str, into: str, spread: int) -> DataFrame:
    """Average ranks of the distinct values (parameter, ``of``, m) of each parameter, ``m`` being how often each occurs.

    The values are dealt to ranges, written once, so that a repeated task sees the
    same ranges; each is numbered on its own and starts after the rows of those below.
    """
    ranged = materialize(values.repartitionByRange(spread, "parameter", of).withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("parameter", "part").agg(F.sum("m").alias("t"))
    before = totals.select("parameter", "part", (F.sum("t").over(Window.partitionBy("parameter").orderBy("part")) - F.col("t")).alias("before"))
    inner = F.sum("m").over(Window.partitionBy("parameter", "part").orderBy(of))
    # at most ``spread`` rows for each parameter
    return ranged.join(F.broadcast(before), ["parameter", "part"]).select("parameter", of, (F.col("before") + inner - F.col("m") + (F.col("m") + 1) / 2).alias(into))


def spearman(df: DataFrame, parameters: list[str], against: str) -> DataFrame:
    """Rank correlation of each parameter with ``against``."""
    return rank_correlations(df, parameters, against).drop("n")


def rate_by_width(summary: DataFrame, column: str, width: float) -> DataFrame:
    """Hit rate and count in bins of equal width from 0, open below and closed above, by method."""
    inside = summary.where(F.col(column) > 0)
    return inside.groupBy("method", (F.ceil(F.col(column) / width) - 1).alias("bin")).agg(F.avg("found").alias("hit_rate"), F.count("*").alias("n"))


def cut(x: Column, edges: Column) -> Column:
    """The number (from 0) of the bin, open below and closed above, that holds ``x``; null outside, so the lowest edge lies in none."""
    below = F.size(F.filter(edges, lambda e: e < x))
    return F.when((below > 0) & (below < F.size(edges)), below - 1)


def even_edges(low: Column, high: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: low + (high - low) * k / n)


def geometric_edges(low: Column, high: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: low * F.pow(high / low, k / n))


def unpivoted(df: DataFrame, parameters: list[str], *keep: str) -> DataFrame:
    """(parameter, x) rows of the named columns, beside the kept ones; null values are left out."""
    pairs = F.array(*(F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("x")) for p in parameters))
    return df.select(*keep, F.inline(pairs)).where("x is not null")


def ceilings(summary: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Hit rates at or below each method's structural ceiling of the period, and above it. Methods without rows have counts of zero."""
    known = summary.sparkSession.createDataFrame(sorted(limits.items()), "method string, predicted_cutoff_days double")
    low = F.col("period") <= F.col("predicted_cutoff_days")
    joined = F.broadcast(known).join(summary.select("method", "period", "found"), "method", "left")
    return joined.groupBy("method", "predicted_cutoff_days").agg(
        F.avg(F.when(low, F.col("found"))).alias("hit_rate_below"),
        F.count_if(low).alias("n_below"),
        F.avg(F.when(~low, F.col("found"))).alias("hit_rate_above"),
        F.count_if(~low).alias("n_above"),
    )


def zero_candidate_correlations(summary: DataFrame, parameters: list[str], is_zero: Column) -> DataFrame:
    """By method and parameter: point-biserial correlation with finding nothing, the rate of that, counts and medians. Methods that always find something are left out."""
    z = unpivoted(summary.withColumn("z", is_zero.cast("int")), parameters, "method", "z")
    out = z.groupBy("method", "parameter").agg(
        correlation("z", "x").alias("point_biserial_r"),
        F.avg("z").alias("zero_candidate_rate"),
        F.count("*").alias("n"),
    )
    return out.where("zero_candidate_rate > 0").join(_medians(z, ["method", "parameter"], "x"), ["method", "parameter"], "left")


def zero_rate_by_activity(summary: DataFrame, stars: DataFrame, methods: list[str], is_zero: Column, n_bins: int = 8, least: float = 0.01) -> DataFrame:
    """How often each of ``methods`` finds nothing, in geometric bins of activity over the given stars."""
    sub = summary.join(stars.select("star_id"), "star_id", "left_semi")
    ends = sub.agg(F.greatest(F.min("activity"), F.lit(least)).alias("lo"), F.max("activity").alias("hi"))  # one row
    binned = sub.where(F.col("method").isin(methods)).crossJoin(F.broadcast(ends)).withColumn("bin", cut(F.col("activity"), geometric_edges(F.col("lo"), F.col("hi"), n_bins)))
    return binned.where("bin is not null").groupBy("method", "bin").agg(F.avg(is_zero.cast("int")).alias("zero_rate"), F.count("*").alias("n"))


def found_by_star(summary: DataFrame, methods: list[str], absent: bool = True) -> DataFrame:
    """A row for each star: n_methods_found and found_by_any over ``methods``; a method without a row for the star counts as ``absent`` (found, in the definition that this follows)."""
    wide = summary.groupBy("star_id").pivot("method", methods).agg(F.first("found"))
    cells = [F.coalesce(F.col(f"`{m}`").cast("int"), F.lit(int(absent))) for m in methods]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    return wide.select("star_id", total.alias("n_methods_found"), (total > 0).alias("found_by_any"))


def sweeps(stars: DataFrame, parameters: list[str], label: str, n_bins: int, bands: bool = False, least: int = 10, low: float | None = None) -> DataFrame:
    """The rate of ``label`` in ``n_bins`` even bins of each parameter, from its least value (or ``low``) to its largest.

    With ``bands``, by band of the column ``period`` too, over the same bins; bands of fewer than ``least`` stars are left out.
    """
    keep = ["band", label] if bands else [label]
    if bands:
        stars = stars.withColumn("band", band_of(F.col("period"))).where("band is not null")
        sizes = stars.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    long = unpivoted(stars, parameters, *keep)
    ends = long.groupBy("parameter").agg((F.lit(low) if low is not None else F.min("x")).alias("lo"), F.max("x").alias("hi"))  # a row for each parameter
    binned = long.join(F.broadcast(ends), "parameter").withColumn("bin", cut(F.col("x"), even_edges(F.col("lo"), F.col("hi"), n_bins))).where("bin is not null")
    if bands:
        binned = binned.join(F.broadcast(sizes), "band")
    return binned.groupBy("parameter", *keep[:-1], "bin").agg(F.avg(F.col(label).cast("int")).alias("rate"), F.count("*").alias("n"))


def rank_correlations(df: DataFrame, parameters: list[str], against: str, spread: int | None = None) -> DataFrame:
    """Spearman's rho of each parameter with ``against`` over the rows that have both: (parameter, spearman_rho, n), all parameters in one pass.

    Only counts of distinct values are ordered.
    """
    spread = spread or shuffle_partitions(df.sparkSession)
    long = unpivoted(df.where(F.col(against).isNotNull()).withColumn("__y", F.col(against).cast("double")), parameters, "__y")
    cells = materialize(long.groupBy("parameter", "x", F.col("__y").alias("y")).agg(F.count("*").alias("n")), "cells")

    def ranks(of: str, into: str) -> DataFrame:
        return _ranks(cells.groupBy("parameter", of).agg(F.sum("n").alias("m")), of, into, spread)

    both = cells.join(ranks("x", "rx"), ["parameter", "x"]).join(ranks("y", "ry"), ["parameter", "y"])
    sums = both.groupBy("parameter").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.expr(e)).alias(a) for a, e in {"a": "rx", "b": "ry", "aa": "rx * rx", "bb": "ry * ry", "ab": "rx * ry"}.items()))
    rho = F.expr("(ab - a * b / n) / nullif(sqrt((aa - a * a / n) * (bb - b * b / n)), 0)")
    return sums.select("parameter", rho.alias("spearman_rho"), "n")


def star_totals(summary: DataFrame) -> DataFrame:
    """Per star over all methods: candidates, whether any found the period, and the period."""
    return summary.groupBy("star_id").agg(F.sum("n_candidates").alias("n_candidates"), (F.max("found") > 0).alias("found"), F.first("period").alias("period"))


def rate_by_window(summary: DataFrame) -> DataFrame:
    """(smoothing_window, hit_rate, n) of the high-pass sweep's rows of a batch with every window."""
    swept = summary.where(F.col("smoothing_window").isNotNull())
    return swept.groupBy("smoothing_window").agg(F.avg(F.col("found_true_period").cast("int")).alias("hit_rate"), F.count("*").alias("n"))


def rate_by_window_and_band(summary: DataFrame, edges: list[float] = BANDS) -> DataFrame:
    """(smoothing_window, band, hit_rate, n): the same by band of the true period too; rows without one lie in none."""
    swept = summary.where(F.col("smoothing_window").isNotNull()).withColumn("band", band_of(F.col("true_period"), edges)).where("band is not null")
    return swept.groupBy("smoothing_window", "band").agg(F.avg(F.col("found_true_period").cast("int")).alias("hit_rate"), F.count("*").alias("n"))


def merged_stars(summary: DataFrame, methods: list[str], parameters: list[str]) -> DataFrame:
    """A row for each star: its parameters (first seen), n_methods_found and found_by_any."""
    known = summary.groupBy("star_id").agg(*(F.first(p, ignorenulls=True).alias(p) for p in parameters))
    return known.join(found_by_star(summary, methods), "star_id")
