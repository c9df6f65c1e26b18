"""Least squares within bounds, for use inside tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def bounded_fit(model: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, low: np.ndarray, high: np.ndarray, robust: bool = False, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and residuals at the least cost found from ``start``.

    ``model`` gives residuals and their Jacobian. Damped Gauss-Newton steps are cut
    at the bounds; a parameter at a bound that its gradient presses against rests
    for that step. With ``robust``, the cost is 2 (sqrt(1 + r^2) - 1) for each residual.
    """

    def cost(r: np.ndarray) -> float:
        return float(np.sum(2 * (np.sqrt(1 + r * r) - 1))) if robust else float(r @ r)

    x = np.clip(np.asarray(start, float), low, high)
    r, jac = model(x)
    best, damping = cost(r), 1e-3
    for _ in range(rounds):
        weight = 1 / np.sqrt(1 + r * r) if robust else np.ones_like(r)
        slope = jac.T @ (weight * r)
        free = ~(((x <= low) & (slope > 0)) | ((x >= high) & (slope < 0)))
        if not free.any():
            break
        hessian = (jac[:, free].T * weight) @ jac[:, free]
        scale = np.maximum(np.diag(hessian), 1e-12)
        done = True
        while damping < 1e10:
            step = np.linalg.solve(hessian + np.diag(damping * scale), -slope[free])
            trial = x.copy()
            trial[free] += step
            trial = np.clip(trial, low, high)
            r2, jac2 = model(trial)
            now = cost(r2)
            if now < best:
                done = best - now <= 1e-10 * best
                x, r, jac, best, damping = trial, r2, jac2, now, max(damping / 5, 1e-9)
                break
            damping *= 4
        if done:
            break
    return x, r


def standard_errors(jac: np.ndarray, r: np.ndarray, variance: float, free: np.ndarray, known_to: np.ndarray) -> np.ndarray:
    """Standard errors of the parameters of a fit with a soft loss, from its Jacobian and residuals at the solution; NaN for fixed ones.

    ``variance``: of a residual. ``known_to``: how well a parameter is known besides, as a deviation; infinite if not at all. A
    parameter that has a part in a direction which nothing determines is NaN too.
    """
    out = np.full(jac.shape[1], np.nan)
    if not free.any():
        return out
    # The curvature of the loss at each residual, as a weight.
    data = jac[:, free] * ((1 + r * r) ** -0.75 / np.sqrt(variance))[:, None]
    rows = np.concatenate([data, np.diag(1 / known_to[free])])
    length = np.sqrt((rows * rows).sum(0))
    scale = np.where(length > 0, length, 1.0)
    _, s, vt = np.linalg.svd(rows / scale, full_matrices=False)
    told = s > s[0] * 1e-12 if s[0] > 0 else np.zeros(len(s), bool)
    error = np.sqrt(((vt[told] / s[told, None]) ** 2).sum(0)) / scale
    lost = (vt[~told] ** 2).sum(0) > 1e-9
    out[free] = np.where(lost | (length == 0), np.nan, error)
    return out


def gaussian_fit(x: np.ndarray, y: np.ndarray, center: float) -> tuple[float, float, float]:
    """(height, center, sigma) of a Gaussian; the centre stays within ``x``."""
    high = y > y.max() / 2
    width = max(float(x[high].max() - x[high].min()) / 2, float(x[1] - x[0]))

    def model(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x - p[1]) / p[2]
        e = np.exp(-0.5 * z * z)
        return p[0] * e - y, np.column_stack([e, p[0] * e * z / p[2], p[0] * e * z * z / p[2]])

    p, _ = bounded_fit(model, np.array([y.max(), center, width]), np.array([-np.inf, x[0], 1e-9]), np.array([np.inf, x[-1], np.inf]))
    return float(p[0]), float(p[1]), float(p[2])
