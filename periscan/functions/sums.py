"""Sums of waves at uneven times over an even grid of frequencies, for use inside tasks."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Cells of the fine grid that a point is spread over: about as many correct digits.
SPREAD = 13
#: Width of the kernel exp(STEEP (sqrt(1 - z^2) - 1)) for a fine grid of twice the frequencies.
STEEP = 2.3 * SPREAD
#: Points spread at a time.
POINTS = 1 << 15


@cache
def _nodes() -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a quadrature of the kernel over half its width."""
    x, w = np.polynomial.legendre.leggauss(2 + 3 * SPREAD)
    z = (x + 1) / 2
    return z, w / 2 * np.exp(STEEP * (np.sqrt(1 - z * z) - 1)) * SPREAD


def wave_sums(time: np.ndarray, weights: np.ndarray, first: float, step: float, n: int) -> np.ndarray:
    """Sum of ``weights`` x exp(-2 pi i f t) over all points, for f = first + g step, g = 0 to n - 1; a row for each row of ``weights``.

    Each point is spread over the few nearest cells of a grid twice as fine
    (Barnett, Magland and af Klinteberg 2019); one fast transform gives all frequencies, and division by the
    kernel's own transform undoes the spreading. About 12 digits of the sum of absolute weights are right.
    """
    weights = np.atleast_2d(weights)
    size = 1 << max(5, int(2 * n - 1).bit_length())
    middle = n // 2
    # Frequencies are counted from the middle one, where the kernel's transform is largest.
    turned = weights * np.exp(-2j * np.pi * np.mod((first + middle * step) * time, 1.0))
    place = np.mod(time * step, 1.0) * size
    grid = np.zeros((len(weights), size), complex)
    reach = np.arange(SPREAD)
    for k in range(0, len(time), POINTS):
        x = place[k : k + POINTS]
        low = np.ceil(x - SPREAD / 2).astype(np.int64)
        z = (low[:, None] + reach - x[:, None]) * (2 / SPREAD)
        kernel = np.exp(STEEP * (np.sqrt(np.maximum(1 - z * z, 0)) - 1))
        cell = ((low[:, None] + reach) % size).ravel()
        for row, t in zip(grid, turned[:, k : k + POINTS], strict=True):
            spread = kernel * t[:, None]
            row += np.bincount(cell, spread.real.ravel(), size) + 1j * np.bincount(cell, spread.imag.ravel(), size)
    g = np.arange(n) - middle
    z, w = _nodes()
    own = np.cos(np.pi * SPREAD / size * g[:, None] * z) @ w
    return np.fft.fft(grid, axis=1)[:, g % size] / own


def sine_power(time: np.ndarray, flux: np.ndarray, first: float, step: float, n: int) -> np.ndarray:
    """Standard power of a sine with a floating mean at n even frequencies; NaN where it is not determined.

    By the closed form of the least-squares fit, with all means of cosines, sines and their products from sums of waves at f and 2 f.
    """
    time, flux = time - time.min(), flux - flux.mean()
    points = len(time)
    one, y = wave_sums(time, np.stack([np.ones(points), flux]), first, step, n) / points
    two = wave_sums(time, np.ones(points), 2 * first, 2 * step, n)[0] / points
    c, s, yc, ys = one.real, -one.imag, y.real, -y.imag
    cc, ss, cs = (1 + two.real) / 2 - c * c, (1 - two.real) / 2 - s * s, -two.imag / 2 - c * s
    square = cc * ss - cs * cs
    below = (flux * flux).mean() * square
    # Beneath rounding of the sums, cosine and sine are one and the same at these times.
    known = (square > 1e-10) & (below > 0)
    return np.divide(yc * yc * ss + ys * ys * cc - 2 * yc * ys * cs, below, out=np.full(n, np.nan), where=known)


def tops(power: np.ndarray) -> np.ndarray:
    """Places above both neighbours; of a flat top, the middle (the lower of two). Ends are never tops."""
    edge = np.flatnonzero(np.diff(power) != 0)
    begin, end = np.concatenate(([0], edge + 1)), np.concatenate((edge, [len(power) - 1]))
    level = power[begin]
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (begin[inner] + end[inner]) // 2


def ranked_tops(freq: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Places of the local maxima, strongest first, or of the largest value if there is none; ties go to the lower frequency."""
    top = tops(power)
    return top[np.lexsort((freq[top], -power[top]))] if len(top) else np.array([power.argmax()])
