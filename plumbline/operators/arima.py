"""ARIMA by exact maximum likelihood: state-space form, Kalman filter, quasi-Newton search.

The differenced series is an ARMA process in the state-space form whose first state entry is the
observation. The filter starts in the stationary distribution, so its prediction errors give the exact
Gaussian likelihood. The variance is profiled out; the other parameters are searched in a space where
every point is stationary and invertible. All trial points of a search step are filtered together.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# The filter's gain is kept once it has changed by less than this in a step.
STEADY = 1e-12


def from_partial(partial: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression with these partial autocorrelations; rows are trials."""
    out = np.zeros_like(partial)
    for k in range(partial.shape[1]):
        before = out[:, :k].copy()
        out[:, :k] = before - partial[:, k : k + 1] * before[:, ::-1]
        out[:, k] = partial[:, k]
    return out


def _unbounded(points: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Autoregressive and moving-average coefficients of search points."""
    return from_partial(np.tanh(points[:, :p])), -from_partial(np.tanh(points[:, p:]))


def _system(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transition, noise loading and stationary state covariance (for unit variance) of every trial."""
    trials, size = len(ar), max(ar.shape[1], ma.shape[1] + 1)
    move = np.zeros((trials, size, size))
    move[:, : ar.shape[1], 0] = ar
    move[:, np.arange(size - 1), np.arange(1, size)] = 1
    load = np.zeros((trials, size))
    load[:, 0] = 1
    load[:, 1 : 1 + ma.shape[1]] = ma
    noise = load[:, :, None] * load[:, None, :]
    # P = T P T' + R R', as one linear system in the entries of P.
    kron = np.einsum("tij,tkl->tikjl", move, move).reshape(trials, size * size, size * size)
    start = np.linalg.solve(np.eye(size * size) - kron, noise.reshape(trials, -1, 1)).reshape(trials, size, size)
    return move, noise, start


def filtered(w: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sum of v^2 / f, sum of log f, last predicted state)`` of every trial, for unit variance."""
    move, noise, cov = _system(ar, ma)
    state = np.zeros(move.shape[:2])
    squares, logs = np.zeros(len(ar)), np.zeros(len(ar))
    steady = False
    for value in w:
        if not steady:
            f = cov[:, 0, 0]
            gain = np.einsum("tij,tj->ti", move, cov[:, :, 0]) / f[:, None]
            after = np.einsum("tij,tjk,tlk->til", move, cov, move) + noise - gain[:, :, None] * gain[:, None, :] * f[:, None, None]
            steady = np.abs(after - cov).max() < STEADY
            cov = after
        v = value - state[:, 0]
        squares += v * v / f
        logs += np.log(f)
        state = np.einsum("tij,tj->ti", move, state) + gain * v[:, None]
    return squares, logs, state


def log_likelihood(w: np.ndarray, ar: np.ndarray, ma: np.ndarray, sigma2: float | None = None) -> float:
    """Exact Gaussian log-likelihood of an ARMA series; ``sigma2`` None takes the most likely variance."""
    squares, logs, _ = filtered(np.asarray(w, float), np.atleast_2d(ar), np.atleast_2d(ma))
    n = len(w)
    sigma2 = sigma2 or squares[0] / n
    return float(-0.5 * (n * math.log(2 * math.pi * sigma2) + logs[0] + squares[0] / sigma2))


def minimise(loss: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int = 100, tolerance: float = 1e-6) -> np.ndarray:
    """Quasi-Newton search (inverse Hessian updates, halved steps) on a loss that takes many points at once."""
    x, size = start.astype(float), len(start)
    inverse, width = np.eye(size), 1e-5

    def slope(x: np.ndarray) -> tuple[float, np.ndarray]:
        moves = np.concatenate([np.zeros((1, size)), np.eye(size) * width, -np.eye(size) * width])
        values = loss(x + moves)
        return float(values[0]), (values[1 : size + 1] - values[size + 1 :]) / (2 * width)

    value, g = slope(x)
    for _ in range(steps):
        if np.abs(g).max() < tolerance:
            break
        direction = -inverse @ g
        if direction @ g >= 0:
            inverse, direction = np.eye(size), -g
        direction /= max(1.0, np.abs(direction).max())
        scales = 0.5 ** np.arange(30)
        tried = loss(x + scales[:, None] * direction)
        fine = np.nonzero(tried <= value + 1e-4 * scales * (direction @ g))[0]
        if not len(fine):
            break
        step = scales[fine[0]] * direction
        before = g
        x = x + step
        value, g = slope(x)
        change = g - before
        bend = step @ change
        if bend > 1e-12:
            left = np.eye(size) - np.outer(step, change) / bend
            inverse = left @ inverse @ left.T + np.outer(step, step) / bend
    return x


@dataclass(frozen=True)
class Arima:
    """A fitted model; ``likelihood`` is that of the differenced series."""

    ar: np.ndarray
    ma: np.ndarray
    differences: int
    sigma2: float
    likelihood: float
    state: np.ndarray
    ends: tuple[float, ...]

    def forecast(self, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Point forecasts and their standard errors."""
        move = _system(self.ar[None], self.ma[None])[0][0]
        state, ahead = self.state.copy(), np.empty(steps)
        weights = np.zeros(steps)  # of past shocks on the differenced series
        shock = np.zeros(len(state))
        shock[0] = 1
        shock[1 : 1 + len(self.ma)] = self.ma
        for h in range(steps):
            ahead[h], weights[h] = state[0], shock[0]
            state, shock = move @ state, move @ shock
        for end in self.ends:
            ahead, weights = end + np.cumsum(ahead), np.cumsum(weights)
        return ahead, np.sqrt(self.sigma2 * np.cumsum(weights**2))


def fit(y: np.ndarray, order: tuple[int, int, int] = (1, 1, 1)) -> Arima:
    """Most likely ARIMA of a series without constant; a constant series has variance 0 and stays where it is."""
    p, d, q = order
    w, ends = np.asarray(y, float), []
    for _ in range(d):
        ends.append(float(w[-1]))
        w = np.diff(w)
    ends = tuple(reversed(ends))
    size = max(p, q + 1)
    spread = float(np.sqrt(np.mean(w * w)))
    if spread == 0:
        return Arima(np.zeros(p), np.zeros(q), d, 0.0, math.inf, np.zeros(size), ends)
    scaled, n = w / spread, len(w)

    def loss(points: np.ndarray) -> np.ndarray:
        # Far out tanh rounds to 1, where no stationary distribution exists.
        points = np.clip(points, -6, 6)
        squares, logs, _ = filtered(scaled, *_unbounded(points, p))
        return 0.5 * (np.log(squares / n) + logs / n)

    # The search starts at the best of a small grid, as the likelihood may have several hills.
    axes = np.meshgrid(*[np.arctanh([-0.8, -0.3, 0.0, 0.3, 0.8])] * min(p + q, 3))
    grid = np.zeros((axes[0].size if p + q else 1, p + q))
    for k in range(min(p + q, 3)):
        grid[:, k] = axes[k].ravel()
    best = grid[int(np.argmin(loss(grid)))]
    found = np.clip(minimise(loss, best), -6, 6) if p + q else best
    ar, ma = _unbounded(found[None], p)
    squares, _, state = filtered(scaled, ar, ma)
    sigma2 = float(squares[0] / n * spread**2)
    return Arima(ar[0], ma[0], d, sigma2, log_likelihood(w, ar, ma, sigma2), state[0] * spread, ends)
