"""Regression solvers on real rows; NumPy only, seeded where they draw."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np

from tellura.errors import ParameterError


def least_squares(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    if weight is not None:
        root = np.sqrt(weight)
        x, y = x * root[:, None], y * root
    return np.linalg.lstsq(x, y, rcond=None)[0]


def trimmed_mean(r: np.ndarray, k: float = 2.0) -> np.ndarray:
    return (np.abs(r) <= k).astype(float)


def bisquare(r: np.ndarray, k: float = 4.685) -> np.ndarray:
    inside = np.clip(1 - (r / k) ** 2, 0, None)
    return inside**2


def huber_weights(r: np.ndarray, k: float = 1.345) -> np.ndarray:
    return np.minimum(1.0, k / np.maximum(np.abs(r), 1e-300))


#: Least scale of Huber's estimate, as a share of the first.
FLOOR = 1e-4

WEIGHTS = {"trimmed_mean": trimmed_mean, "bisquare": bisquare, "huber": huber_weights}


def robust_scale(r: np.ndarray) -> np.ndarray:
    """Residuals less their median, over their interquartile range."""
    low, mid, high = np.percentile(r, [25, 50, 75])
    return (r - mid) / (high - low if high > low else 1.0)


@dataclass(frozen=True)
class Solver:
    """``fit_intercept`` adds a column of ones, which the result leaves out."""

    fit_intercept: bool = False

    def solve(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
        if not len(x):
            return np.full(x.shape[1], np.nan)
        design = np.column_stack([x, np.ones(len(x))]) if self.fit_intercept else x
        return self._solve(design, y, np.random.default_rng(seed))[: x.shape[1]]

    def _solve(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        raise NotImplementedError


@dataclass(frozen=True)
class OLS(Solver):
    def _solve(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return least_squares(x, y)


@dataclass(frozen=True)
class Huber(Solver):
    """Huber's joint estimate of coefficients and scale: quadratic loss to ``epsilon`` scales, linear beyond.

    With an ``epsilon`` of 1 the loss falls as long as the scale does, towards
    least absolute deviations; the scale stays above FLOOR of the first one.
    """

    epsilon: float = 1.0
    alpha: float = 1e-4
    max_iter: int = 200

    def _solve(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        if self.epsilon < 1:
            raise ParameterError("epsilon is 1 or more")
        b = least_squares(x, y)
        scale = max(float(np.median(np.abs(y - x @ b))), 1e-12)
        floor = FLOOR * scale
        for _ in range(self.max_iter):
            r = np.abs(y - x @ b)
            root = np.sqrt(np.minimum(1.0, self.epsilon * scale / np.maximum(r, 1e-300)))
            ridge = np.sqrt(self.alpha * scale) * np.eye(x.shape[1])
            new = np.linalg.lstsq(np.vstack([x * root[:, None], ridge]), np.concatenate([y * root, np.zeros(x.shape[1])]), rcond=None)[0]
            # the loss in the scale s is n s + sum of inner r^2 / s, less eps^2 s for each outer one
            r = np.abs(y - x @ new)
            outer = r > self.epsilon * scale
            free = len(y) - self.epsilon**2 * outer.sum()
            inner = float((r[~outer] ** 2).sum())
            before, scale = scale, max(np.sqrt(inner / free) if free > 0 and inner > 0 else scale * 0.9, floor)
            done = np.abs(new - b).max() <= 1e-10 * max(1.0, np.abs(new).max()) and abs(scale - before) <= 1e-10 * before
            b = new
            if done:
                break
        return b


def spatial_median(points: np.ndarray, max_iter: int = 300) -> np.ndarray:
    """Point of least summed distance (Weiszfeld steps, Vardi and Zhang's form)."""
    m = np.median(points, axis=0) if points.shape[1] == 1 else points.mean(axis=0)
    if points.shape[1] == 1:
        return m
    for _ in range(max_iter):
        d = np.sqrt(((points - m) ** 2).sum(axis=1))
        away = d > 1e-12
        if not away.any():
            return m
        w = 1 / d[away]
        t = (points[away] * w[:, None]).sum(axis=0) / w.sum()
        pull = np.sqrt(((((points[away] - m) * w[:, None]).sum(axis=0)) ** 2).sum())
        here = (~away).sum()
        share = min(1.0, here / pull) if pull > 0 else 1.0
        new = (1 - share) * t + share * m
        if np.sqrt(((new - m) ** 2).sum()) <= 1e-10 * max(1.0, np.abs(m).max()):
            return new
        m = new
    return m


@dataclass(frozen=True)
class TheilSen(Solver):
    """Spatial median of least-squares fits to subsets of the rows.

    Subsets hold as many rows as there are coefficients, or ``n_subsamples``,
    a proportion of the rows. All subsets serve if they are no more than
    ``max_subpopulation``, else so many that are drawn without repeats.
    """

    max_subpopulation: int = 2000
    n_subsamples: float | None = None

    def _solve(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        n, k = x.shape
        size = min(max(k, int(self.n_subsamples * n) if self.n_subsamples is not None else k), n)
        if size == n:
            return least_squares(x, y)
        if math.comb(n, size) <= self.max_subpopulation:
            draws = np.array(list(combinations(range(n), size)))
        else:
            draws = np.stack([rng.choice(n, size, replace=False) for _ in range(self.max_subpopulation)])
        fits = []
        at_once = max(1, 5_000_000 // (size * k * k))  # bounds memory; the draws are the same
        for first in range(0, len(draws), at_once):
            rows = draws[first : first + at_once]
            xs, ys = x[rows], y[rows]
            normal, right = np.einsum("sij,sik->sjk", xs, xs), np.einsum("sij,si->sj", xs, ys)
            ridge = 1e-12 * np.trace(normal, axis1=1, axis2=2)[:, None, None] / k * np.eye(k)
            fits.append(np.linalg.solve(normal + ridge + 1e-300 * np.eye(k), right[..., None])[..., 0])
        points = np.concatenate(fits)
        return spatial_median(points[np.isfinite(points).all(axis=1)])


@dataclass(frozen=True)
class RANSAC(Solver):
    """Of fits to random subsets the one with most inliers, fitted again to them."""

    min_samples: float = 0.8
    max_trials: int = 20

    def _solve(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        n, k = x.shape
        size = min(n, max(k, int(np.ceil(self.min_samples * n)) if self.min_samples < 1 else int(self.min_samples)))
        limit = float(np.median(np.abs(y - np.median(y))))
        best, best_count, best_error = None, 0, np.inf
        for _ in range(self.max_trials):
            rows = rng.choice(n, size, replace=False)
            r = np.abs(y - x @ least_squares(x[rows], y[rows]))
            inside = r <= limit
            error = float((r[inside] ** 2).mean()) if inside.any() else np.inf
            if inside.sum() > best_count or (inside.sum() == best_count and error < best_error):
                best, best_count, best_error = inside, int(inside.sum()), error
        return least_squares(x, y) if best is None or best_count < k else least_squares(x[best], y[best])


@dataclass(frozen=True)
class WLS(Solver):
    """``n_iter`` reweighted fits; weights of the scaled residuals."""

    n_iter: int = 50
    weights: str = "trimmed_mean"

    def _solve(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        b, before = least_squares(x, y), None
        for _ in range(self.n_iter):
            w = WEIGHTS[self.weights](robust_scale(y - x @ b))
            if w.sum() < x.shape[1] or (before is not None and np.array_equal(w, before)):
                break
            b, before = least_squares(x, y, w), w
        return b


SOLVERS = {c.__name__: c for c in (OLS, Huber, TheilSen, RANSAC, WLS)}
