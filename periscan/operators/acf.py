"""Autocorrelation that knows about gaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from periscan.operators.per_star import per_star


def correlate(x: np.ndarray) -> np.ndarray:
    """Sums of the products of all pairs k apart, for every k, by a padded transform."""
    size = 1 << (2 * len(x) - 1).bit_length()
    return np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[: len(x)]


def acf_of(i: np.ndarray, flux: np.ndarray, dt: float, max_lag_frac: float = 1 / 3, min_valid_frac: float = 0.3, gaps: bool = True) -> list[np.ndarray]:
    """k, lag, acf and number of pairs of one curve; see :func:`acf`."""
    ok = np.isfinite(flux)
    i, flux = i[ok].astype(np.int64), flux[ok]
    if not len(i):
        return [np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)]
    at = i - i.min()
    x, held = np.zeros(at.max() + 1), np.zeros(at.max() + 1)
    x[at], held[at] = flux - flux.mean(), 1.0
    most = int(np.floor(at.max() * max_lag_frac + 1e-9)) + 1
    pairs = np.rint(correlate(held))[:most]
    raw = correlate(x)[:most]
    value = np.divide(raw, pairs, out=np.full(most, np.nan), where=pairs > 0) if gaps else raw
    low = np.flatnonzero(pairs < min_valid_frac * pairs[0])
    keep = np.arange(most) < (low[0] if len(low) and low[0] >= 10 else most)
    keep &= (pairs > 0) & (abs(x).max() > 0)
    k = np.flatnonzero(keep)
    return [k, k * dt, value[k] / value[0] if len(k) else np.zeros(0), pairs[k].astype(np.int64)]


def acf(lc: DataFrame, dt: float, max_lag_frac: float = 1 / 3, min_valid_frac: float = 0.3, gaps: bool = True) -> DataFrame:
    """(star_id, k, lag, acf, n_pairs): the mean product of pairs ``k`` cadences apart, over that of k = 0.

    Two transforms for each star give the sums of products and the numbers of
    pairs. Lags end at ``max_lag_frac`` of the span, and before the first with
    less than ``min_valid_frac`` of the points in pairs, unless fewer than ten
    would be left. With ``gaps`` false, sums are not divided by their numbers of
    pairs, so that long lags fade. Curves of one value have no autocorrelation.
    """

    return per_star(lc, ["i", "flux"], lambda i, flux: acf_of(i, flux, dt, max_lag_frac, min_valid_frac, gaps), "k long, lag double, acf double, n_pairs long")
