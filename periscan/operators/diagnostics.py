"""Scores of candidate periods: comb of teeth on the autocorrelation, phase dispersion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periscan.session import shuffle_partitions


def harmonic_weight(n: Column) -> Column:
    """1 / (n + 1): the first teeth count most."""
    return 1.0 / (n + 1)


def comb_score(series: DataFrame, combs: DataFrame, n_max: int = 5, weight: Callable[[Column], Column] = harmonic_weight) -> DataFrame:
    """Adds ``score`` to combs (star_id, p, t0, ...): the mean of the autocorrelation at t0 + n p, weighted by ``weight`` of n. Null if the weights add up to 0.

    Values between lags are interpolated by index arithmetic; teeth past the last lag are left out.
    """
    span = series.groupBy("star_id").agg(F.min("lag").alias("l0"), F.max("lag").alias("l1"), F.max("k").alias("k1"), F.min("k").alias("k0"))
    teeth = combs.join(span, "star_id").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_max))).alias("n")).withColumn("at", F.col("t0") + F.col("n") * F.col("p")).where("at <= l1")
    place = (F.col("at") - F.col("l0")) / ((F.col("l1") - F.col("l0")) / (F.col("k1") - F.col("k0"))) + F.col("k0")
    put = teeth.withColumn("x", F.greatest(place, F.col("k0"))).withColumn("k", F.least(F.floor("x"), F.col("k1") - 1)).withColumn("part", F.col("x") - F.col("k"))
    low = series.select("star_id", "k", F.col("acf").alias("a"))
    high = series.select("star_id", (F.col("k") - 1).alias("k"), F.col("acf").alias("b"))
    value = put.join(low, ["star_id", "k"]).join(high, ["star_id", "k"]).withColumn("v", F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).withColumn("w", weight(F.col("n")).cast("double"))
    return value.groupBy(*combs.columns).agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("score"))


def best_phase(series: DataFrame, periods: DataFrame, dt: float, n_phase: int = 200, weight: Callable[[Column], Column] = harmonic_weight) -> DataFrame:
    """Of ``n_phase`` phases from 3 dt to a period later, that with the best comb score: star_id, p, t0, score."""
    trial = periods.select("star_id", "p", F.explode(F.sequence(F.lit(0), F.lit(n_phase - 1))).alias("j")).select("star_id", "p", (3 * dt + F.col("p") * F.col("j") / n_phase).alias("t0"))
    scored = comb_score(series, trial, weight=weight)
    return scored.groupBy("star_id", "p").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("t0")).alias("t"))).alias("b")).select("star_id", "p", (-F.col("b.t")).alias("t0"), F.col("b.s").alias("score"))


def phase_dispersion(lc: DataFrame, periods: DataFrame, n_bins: int = 10) -> DataFrame:
    """theta of each (star_id, p): the pooled variance within phase bins over that of all points. Bins of one point count neither way."""
    whole = lc.groupBy("star_id").agg(F.var_samp("flux").alias("all_var"), F.count("*").alias("n"), F.min("time").alias("t0"))
    cycle = (F.col("time") - F.col("t0")) / F.col("p")
    folded = periods.join(lc, "star_id").join(whole, "star_id").withColumn("bin", F.least(F.floor((cycle - F.floor(cycle)) * n_bins), F.lit(n_bins - 1)))
    bins = folded.groupBy("star_id", "p", "bin").agg(F.var_samp("flux").alias("v"), F.count("*").alias("m"), F.first("all_var").alias("all_var"), F.first("n").alias("n")).where("m >= 2")
    sums = bins.groupBy("star_id", "p").agg(F.sum((F.col("m") - 1) * F.col("v")).alias("within"), F.sum("m").alias("used"), F.count("*").alias("bins"), F.first("all_var").alias("all_var"), F.first("n").alias("n"))
    ok = (F.col("n") >= 2 * n_bins) & (F.col("all_var") > 0) & (F.col("n") > F.col("bins"))
    return sums.select("star_id", "p", F.when(ok, F.col("within") / ((F.col("n") - F.col("bins")) * F.col("all_var"))).alias("theta"))


def refine_by_dispersion(lc: DataFrame, periods: DataFrame, search_frac: float = 0.02, n_trial: int = 201, n_bins: int = 10) -> DataFrame:
    """The period within ``search_frac`` of each p with the least theta (as :func:`phase_dispersion` has it): star_id, p0, p, theta.

    Trials are made inside tasks, never as rows. Points come sorted by star, and of a star only its sums by trial and bin are held, however
    many its points are; trials within rounding of the best leave the task.
    """
    spark = lc.sparkSession
    whole = lc.groupBy("star_id").agg(F.avg("flux").alias("mean"), F.var_samp("flux").alias("all_var"), F.count("*").alias("n"), F.min("time").alias("t0")).where((F.col("n") >= 2 * n_bins) & (F.col("all_var") > 0))
    asked = periods.select("star_id", F.col("p").cast("double").alias("p0")).where("p0 is not null").distinct()
    points = lc.join(whole, "star_id").join(asked, "star_id").select("star_id", "p0", (F.col("time") - F.col("t0")).cast("double").alias("since"), (F.col("flux") - F.col("mean")).alias("off"), "all_var", "n")
    dealt = points.repartition(shuffle_partitions(spark), "star_id", "p0").sortWithinPartitions("star_id", "p0")
    star = points.schema["star_id"].dataType.simpleString()
    tried = dealt.mapInArrow(_trials(1 - search_frac + 2 * search_frac * np.arange(n_trial) / (n_trial - 1), n_bins), f"star_id {star}, p0 double, p double, theta double")
    # The rows of a star and p0 come from one task.
    return tried.groupBy("star_id", "p0").agg(F.min(F.struct(F.round("theta", 9).alias("theta"), "p")).alias("b")).select("star_id", "p0", "b.p", "b.theta")


def _trials(factors: np.ndarray, n_bins: int, rows: int = 1024) -> Callable:
    """A function of batches of points sorted by (star_id, p0), for ``mapInArrow``: the trials p0 x ``factors`` whose theta is the least or near it."""
    size = len(factors) * n_bins

    def theta(sums: np.ndarray, n: int, all_var: float) -> np.ndarray:
        m, c, s, q = sums.reshape(4, len(factors), n_bins)
        with np.errstate(all="ignore"):
            v = (q - s * s / c) / (c - 1)
            within = np.where((m >= 2) & (c >= 2), (m - 1) * np.maximum(v, 0), 0).sum(1)
            bins = (m >= 2).sum(1)
            return np.where(((m >= 2) & (c >= 2)).any(1) & (n > bins), within / ((n - bins) * all_var), -1)  # -1: none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = None, None
        for batch in batches:
            schema = batch.schema.field("star_id").type
            found = []
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                star, p0, since, off, all_var, n = (part.column(k).to_numpy(zero_copy_only=False) for k in range(6))
                new = np.append(True, (star[1:] != star[:-1]) | (p0[1:] != p0[:-1]))
                first, group = np.flatnonzero(new), np.cumsum(new) - 1
                with np.errstate(all="ignore"):
                    cycle = since[:, None] / (p0[:, None] * factors)
                    phase = np.nan_to_num(np.floor((cycle - np.floor(cycle)) * n_bins), nan=0.0)
                bins = np.clip(phase, 0, n_bins - 1).astype(np.int64)
                bins[part.column("since").is_null().to_numpy(zero_copy_only=False)] = n_bins - 1  # where the smaller of no bin and the last is the last
                cell = (bins + np.arange(len(factors)) * n_bins + group[:, None] * size).ravel()
                valid = ~part.column("off").is_null().to_numpy(zero_copy_only=False)
                x = np.where(valid, off, 0.0)
                weights = (None, valid.astype(float), x, x * x)
                made = np.stack([np.bincount(cell, None if w is None else np.repeat(w, len(factors)), len(first) * size) for w in weights]).reshape(4, len(first), size).swapaxes(0, 1)
                for g, k in enumerate(first):
                    key = (star[k], p0[k], int(n[k]), float(all_var[k]))
                    if held is not None and key[:2] == held[:2]:
                        sums = sums + made[g]
                    else:
                        if held is not None:
                            found.append((held, sums))
                        held, sums = key, made[g].astype(float)
            yield from best(found, schema)
        if held is not None:
            yield from best([(held, sums)], schema)

    def best(found: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        out = []
        for (star, p0, n, all_var), sums in found:
            t = theta(sums, n, all_var)
            some = t[t >= 0]
            near = (t >= 0) & (t <= some.min() + 3e-9) if len(some) else np.isnan(t)
            out += [(star, p0, p0 * factors[k], t[k]) for k in np.flatnonzero(near)]
        if out:
            a, b, c, d = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, pa.float64()), pa.array(c, pa.float64()), pa.array(d, pa.float64())], names=["star_id", "p0", "p", "theta"])

    return run
