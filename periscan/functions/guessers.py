"""The proposers of periods as table functions: ``SELECT * FROM guess_acf_fft(1 / 24D, 5, TABLE(curves) PARTITION BY star_id)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from periscan.functions.sums import ranked_tops, sine_power
from periscan.operators.acf import acf_of
from periscan.operators.spectra import spectrum_of

RESULT = "star_id string, rank int, p0 double, strength double, method string"


class _Curve:
    """Holds the batches of one star; ``propose`` gets its columns and the options."""

    def __init__(self):
        self.held: list[pa.RecordBatch] = []
        self.options: list[float] = []

    def keep(self, batch, *options) -> Iterator[pa.Table]:
        self.held.append(batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch]))
        self.options = [x[0].as_py() if isinstance(x, pa.Array | pa.ChunkedArray) else x for x in options]
        return iter(())

    def column(self, rows: pa.Table, name: str) -> np.ndarray:
        return rows.column(name).cast(pa.float64()).to_numpy()

    def terminate(self) -> Iterator[pa.Table]:
        if self.held:
            rows = pa.concat_tables(self.held)
            star = str(rows.column("star_id")[0].as_py())
            p0, strength, method = self.propose(rows, *self.options)
            n = len(p0)
            yield pa.table([pa.array([star] * n, pa.string()), pa.array(np.arange(1, n + 1), pa.int32()), pa.array(p0, pa.float64()), pa.array(strength, pa.float64()), pa.array([method] * n, pa.string())], names=["star_id", "rank", "p0", "strength", "method"])


def _from_acf(curve: _Curve, rows: pa.Table, dt: float, n_guesses: int, **options):
    k, lag, acf, _ = acf_of(curve.column(rows, "i"), curve.column(rows, "flux"), dt)
    _, freq, power = spectrum_of(k, lag, acf, **options) if len(k) else (None, np.zeros(0), np.zeros(0))
    if not len(power):
        return [], []
    at = ranked_tops(freq, power)[: int(n_guesses)]
    return 1 / freq[at], power[at] / power.max() if power.max() > 0 else np.zeros(len(at))


@arrow_udtf(returnType=RESULT)
class GuessAcfFft(_Curve):
    """(dt, n_guesses, TABLE of star_id, i, flux)."""

    def eval(self, dt, n_guesses, curves):
        return self.keep(curves, dt, n_guesses)

    def propose(self, rows: pa.Table, dt: float, n_guesses: int):
        return *_from_acf(self, rows, dt, n_guesses), "acf_fft"


@arrow_udtf(returnType=RESULT)
class GuessAcfFftShort(_Curve):
    """(dt, n_guesses, TABLE of star_id, i, flux): a finer grid, up to 15 days."""

    def eval(self, dt, n_guesses, curves):
        return self.keep(curves, dt, n_guesses)

    def propose(self, rows: pa.Table, dt: float, n_guesses: int):
        return *_from_acf(self, rows, dt, n_guesses, oversample=8, max_period=15.0), "acf_fft_short"


@arrow_udtf(returnType=RESULT)
class GuessLombScargle(_Curve):
    """(samples_per_peak, n_guesses, TABLE of star_id, time, flux)."""

    def eval(self, samples_per_peak, n_guesses, curves):
        return self.keep(curves, samples_per_peak, n_guesses)

    def propose(self, rows: pa.Table, samples_per_peak: int, n_guesses: int):
        time, flux = self.column(rows, "time"), self.column(rows, "flux")
        ok = np.isfinite(time) & np.isfinite(flux)
        time, flux = time[ok], flux[ok]
        span, dt = (time.max() - time.min(), np.median(np.diff(np.sort(time)))) if len(time) >= 10 else (0.0, 0.0)
        if span <= 0 or dt <= 0 or 1 / (4 * dt) < 2 / span:
            return [], [], "lombscargle"
        low, step = 2 / span, 1 / (samples_per_peak * span)
        freq = low + np.arange(int(np.rint((1 / (4 * dt) - low) / step)) + 1) * step
        power = sine_power(time, flux, low, step, len(freq))
        freq, power = freq[~np.isnan(power)], power[~np.isnan(power)]
        at = ranked_tops(freq, power)[: int(n_guesses)] if len(power) else np.zeros(0, np.int64)
        return 1 / freq[at], power[at], "lombscargle"


def register(spark: SparkSession) -> None:
    """Makes the functions known to SQL. Curves come as the last argument, with PARTITION BY star_id; a partition is one star's curve."""
    for name, function in (("guess_acf_fft", GuessAcfFft), ("guess_acf_fft_short", GuessAcfFftShort), ("guess_lombscargle", GuessLombScargle)):
        spark.udtf.register(name, function)
