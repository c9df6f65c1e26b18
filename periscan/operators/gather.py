"""Candidates of several methods at once, failures as rows, and the batch tables of a set of stars."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periscan.functions.sums import ranked_tops
from periscan.operators.acf import acf
from periscan.operators.benchmark import matches
from periscan.operators.per_star import per_star
from periscan.operators.pools import WINDOWS, attach, highpass_sweep
from periscan.operators.series import interpolate
from periscan.operators.spacing import peak_spacings
from periscan.operators.spectra import guess_lombscargle, spectrum_of
from periscan.operators.wavelet import wavelet_candidates
from periscan.session import materialize


@dataclass
class Curves:
    """Evenly numbered curves (star_id, i, time, flux), their autocorrelation, and the cadence in days."""

    lc: DataFrame
    series: DataFrame
    dt: float

    @classmethod
    def of(cls, lc: DataFrame, dt: float, **acf_options) -> Curves:
        return cls(lc, materialize(acf(lc, dt, **acf_options), "acf"), dt)


@dataclass
class Method:
    run: Callable[..., DataFrame]
    #: Why a star may have no candidates: SQL over the columns of :func:`_facts`; None where that is no failure, or where the method itself says.
    failure: str | None


#: Every method that can be asked for, by name.
METHODS: dict[str, Method] = {}
DEFAULT = ("pairwise_histogram", "lombscargle", "acf_fft")
COLUMNS = ["star_id", "method", "smoothing_window", "rank", "p0", "strength", "coverage"]


TOO_FEW = "case when points < 10 then concat('fewer than ten finite points: ', points) when span > 0 then 'no frequency is determined between the longest and the shortest period' else 'no span of time' end"


def method(name: str, failure: str | None):
    """Registers a function of (curves, n_guesses, **options) that returns candidates (star_id, method, rank, p0, strength, ...)."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        METHODS[name] = Method(f, failure)
        return f

    return add


@method("pairwise_histogram", "'fewer than two prominent peaks in the autocorrelation'")
def _(curves: Curves, n_guesses: int) -> DataFrame:
    return peak_spacings(curves.series, curves.dt, n_guesses)


@method("lombscargle", TOO_FEW)
def _(curves: Curves, n_guesses: int, **options) -> DataFrame:
    return guess_lombscargle(curves.lc, "lombscargle", n_guesses, **options)


@method("lombscargle_short", TOO_FEW)
def _(curves: Curves, n_guesses: int, **options) -> DataFrame:
    return guess_lombscargle(curves.lc, "lombscargle_short", n_guesses, **{"samples_per_peak": 5, "max_period": 15.0} | options)


#: Methods that read nothing but a star's autocorrelation, with the options of their spectrum. All that are asked for share one pass over it.
SPECTRA: dict[str, dict] = {"acf_fft": {}, "acf_fft_short": {"oversample": 8, "max_period": 15.0}}


def spectra_candidates(series: DataFrame, asked: dict[str, dict], n_guesses: dict[str, int]) -> DataFrame:
    """(star_id, asked, rank, p0, strength, error) of several spectra of each star's autocorrelation, options by name; a method that fails for a star is one row with the error."""

    def run(k: np.ndarray, lag: np.ndarray, acf: np.ndarray) -> list[list]:
        rows = []
        for name, options in asked.items():
            try:
                _, freq, power = spectrum_of(k, lag, acf, **options)
                if not len(freq):
                    raise ValueError("fewer than three frequencies in the band")
                at = ranked_tops(freq, power)[: n_guesses[name]]
                top = power.max()
                rows += [(name, place, 1 / freq[j], power[j] / top if top > 0 else 0.0, None) for place, j in enumerate(at, 1)]
            except Exception as e:  # noqa: BLE001  one star and method that fails is a row, whatever the cause
                rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
        return [list(c) for c in zip(*rows, strict=True)]

    return per_star(series, ["k", "lag", "acf"], run, "asked string, rank int, p0 double, strength double, error string")


def _spectrum_method(name: str) -> None:
    def run(curves: Curves, n_guesses: int, **options) -> DataFrame:
        found = spectra_candidates(curves.series, {name: SPECTRA[name] | options}, {name: n_guesses})
        return found.where("error is null").select("star_id", "rank", "p0", "strength", F.lit(name).alias("method"))

    method(name, None)(run)


for _name in SPECTRA:
    _spectrum_method(_name)


@method("acf_fft_highpass", None)
def _(curves: Curves, n_guesses: int, **options) -> DataFrame:
    return highpass_sweep(curves.lc, curves.dt, n_guesses=n_guesses, **options).withColumnRenamed("window_days", "smoothing_window")


@method("wavelet", "if(gaps > 0 and not filled, concat('the flux has ', gaps, ' gaps'), 'no peak stands out')")
def _(curves: Curves, n_guesses: int, fill: bool = False, **options) -> DataFrame:
    return wavelet_candidates(interpolate(curves.lc) if fill else curves.lc, curves.dt, n_guesses, **options)


def _facts(curves: Curves, filled: bool) -> DataFrame:
    """What failures are explained by: each star's finite points, gaps between its first and last, span and least step."""
    ok = F.col("flux").isNotNull() & ~F.isnan("flux")
    return curves.lc.groupBy("star_id").agg(F.count_if(ok & F.col("time").isNotNull()).alias("points"), (F.max("i") - F.min("i") + 1 - F.count_if(ok)).alias("gaps"), (F.max(F.when(ok, F.col("time"))) - F.min(F.when(ok, F.col("time")))).alias("span"), F.lit(filled).alias("filled"))


def gather(curves: Curves, methods: tuple[str, ...] | list[str] = DEFAULT, n_guesses: int = 5, options: dict[str, dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates of all ``methods`` as one written table, and (star_id, method, error) of the stars where a method failed.

    ``options`` has further arguments by method. An unknown name is an error before anything runs. A method of :data:`SPECTRA`
    that raises an exception for a star fails there, with the exception's type and text; the other stars and methods go on. Where the
    other methods have no candidates for a star, the error says what its curve lacks. Candidates of the high-pass sweep are
    named after their windows (``acf_fft_hp2d``); :func:`batch` calls all of them ``acf_fft_highpass``.
    """
    unknown = [m for m in methods if m not in METHODS]
    if unknown:
        raise ValueError(f"unknown methods: {', '.join(unknown)}")
    given = {m: {"n_guesses": n_guesses} | (options or {}).get(m, {}) for m in methods}
    parts = []
    together = [m for m in methods if m in SPECTRA]
    if together:
        asked = {m: SPECTRA[m] | {o: v for o, v in given[m].items() if o != "n_guesses"} for m in together}
        parts.append(spectra_candidates(curves.series, asked, {m: given[m]["n_guesses"] for m in together}).withColumn("method", F.col("asked")))
    parts += [METHODS[m].run(curves, **given[m]).withColumn("asked", F.lit(m)) for m in methods if m not in SPECTRA]
    found = None
    for part in parts:
        for column, kind in (("smoothing_window", "double"), ("coverage", "double"), ("error", "string")):
            if column not in part.columns:
                part = part.withColumn(column, F.lit(None).cast(kind))
        part = part.select("asked", *COLUMNS, "error")
        found = part if found is None else found.unionByName(part)
    found = materialize(found, "candidates")
    stars = curves.series.select("star_id").distinct()
    told = [(m, METHODS[m].failure) for m in methods if METHODS[m].failure]
    failed = found.where("error is not null").select("star_id", F.col("asked").alias("method"), "error")
    if told:
        names = curves.lc.sparkSession.createDataFrame([(m,) for m, _ in told], "method string")
        # a row for each star and method
        silent = stars.crossJoin(F.broadcast(names)).join(found.select("star_id", F.col("asked").alias("method")).distinct(), ["star_id", "method"], "left_anti")
        facts = silent.join(_facts(curves, (options or {}).get("wavelet", {}).get("fill", False)), "star_id", "left")
        cases = " ".join(f"when method = '{m}' then {why}" for m, why in told)
        failed = failed.unionByName(facts.select("star_id", "method", F.expr(f"case {cases} end").alias("error")))
    return found.where("error is null").drop("asked", "error"), failed


@dataclass
class Batch:
    summary: DataFrame
    candidates: DataFrame
    failures: DataFrame


NO_CURVE = "__load_or_acf__"


def batch(lc: DataFrame, parameters: DataFrame, dt: float, methods: tuple[str, ...] | list[str] = tuple(METHODS), windows: list[float] = WINDOWS, every_window: bool = False, rel_tol: float = 0.15, n_guesses: int = 5) -> Batch:
    """The benchmark of a set of stars: do the methods propose the period in ``parameters`` (star_id, true_period, ...)?

    ``summary`` has a row for each star, method and high-pass window, also where
    the method failed or found nothing (those without a window; with
    ``every_window`` one for each window). ``candidates`` has all candidates and whether each
    matches. ``failures`` has star_id, method, error; a star of ``parameters`` without an autocorrelation has one
    row there and none elsewhere. Parameters are attached to all rows; where names clash, they win.
    """
    curves = Curves.of(lc, dt)
    options = {"acf_fft_highpass": {"windows_days": windows}, "wavelet": {"fill": True}}
    found, failed = gather(curves, methods, n_guesses, {m: o for m, o in options.items() if m in methods})
    spark = lc.sparkSession
    named = found.withColumn("method", F.when(F.col("smoothing_window").isNotNull(), "acf_fft_highpass").otherwise(F.col("method")))
    truth = parameters.select("star_id", "true_period")
    hit = matches(F.col("p0"), F.col("true_period"), rel_tol)
    candidates = materialize(named.drop("coverage").join(truth, "star_id", "left").withColumn("is_match", hit), "matched")
    first = F.min(F.when(F.col("is_match"), F.struct("rank", "p0")))
    seen = candidates.groupBy("star_id", "method", "smoothing_window").agg(F.count("*").alias("n_candidates"), F.max("is_match").alias("found_true_period"), first.alias("b"))
    stars = curves.series.select("star_id").distinct()
    if every_window and "acf_fft_highpass" in methods:
        cells = [(m, w) for m in methods for w in (windows if m == "acf_fft_highpass" else [None])]
        grid = spark.createDataFrame([(m, None if w is None else float(w)) for m, w in cells], "method string, smoothing_window double")
        wanted = stars.crossJoin(F.broadcast(grid))
    else:
        grid = spark.createDataFrame([(m,) for m in methods], "method string")
        empty = stars.crossJoin(F.broadcast(grid)).join(seen.select("star_id", "method"), ["star_id", "method"], "left_anti").withColumn("smoothing_window", F.lit(None).cast("double"))
        wanted = seen.select("star_id", "method", "smoothing_window").unionByName(empty)
    cell = F.coalesce("smoothing_window", F.lit(-1.0))  # nulls are equal here
    rows = wanted.withColumn("cell", cell).join(seen.withColumn("cell", cell).drop("smoothing_window"), ["star_id", "method", "cell"], "left").join(truth, "star_id", "left")
    summary = rows.select(
        "star_id", "method", "smoothing_window", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("found_true_period", F.lit(False)).alias("found_true_period"), F.col("b.rank").alias("rank_of_true_period"), F.col("b.p0").alias("matched_p0"), "true_period"
    )
    lost = parameters.select("star_id").distinct().join(stars, "star_id", "left_anti").select("star_id", F.lit(NO_CURVE).alias("method"), F.lit("no points, or one value only").alias("error"))
    return Batch(attach(summary, parameters), attach(candidates, parameters), failed.unionByName(lost))
