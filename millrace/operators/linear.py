"""Linear models solved from one scan: least squares, ridge, lasso, PCA, principal-component regression."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dot, let
from .gram import collect_moments, merged

# The penalty grid of ridge and lasso.
ALPHAS = tuple(np.logspace(-3, 2, 10))


class LinearFit(NamedTuple):
    coef: np.ndarray
    intercept: float

    def predict(self, df: DataFrame, vec: str, out: str = "prediction") -> DataFrame:
        weights = F.array(*[F.lit(float(w)) for w in self.coef])
        return df.withColumn(out, dot(F.col(vec), weights) + F.lit(float(self.intercept)))


class GridResult(NamedTuple):
    fit: LinearFit
    best: float
    scores: dict


def _sums(df: DataFrame, vec: str, y: str, fold: str | None = None) -> dict:
    joined = F.concat(F.col(vec).cast("array<double>"), F.array(F.col(y).cast("double")))
    cols = [joined.alias("__z")] + ([F.col(fold)] if fold else [])
    return collect_moments(df.filter(F.col(y).isNotNull()).select(*cols), "__z", fold)


def solve_ridge(m: tuple, alpha: float = 0.0) -> LinearFit:
    n, mean, s = m
    a, b = s[:-1, :-1], s[:-1, -1]
    coef = (np.linalg.lstsq(a, b, rcond=None)[0] if alpha == 0
            else np.linalg.solve(a + alpha * np.eye(len(b)), b))
    return LinearFit(coef, float(mean[-1] - coef @ mean[:-1]))


def solve_lasso(m: tuple, alpha: float, tol: float = 1e-10, max_iter: int = 10_000) -> LinearFit:
    """Minimum of |y - Xw|^2 / (2n) + alpha |w|_1 by coordinate descent on the cross products."""
    n, mean, s = m
    a, b = s[:-1, :-1] / n, s[:-1, -1] / n
    w = np.zeros(len(b))
    grad = b.copy()  # b - a w
    for _ in range(max_iter):
        biggest = 0.0
        for j in np.nonzero(np.diag(a) > 0)[0]:
            rho = grad[j] + a[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / a[j, j]
            step = new - w[j]
            if step:
                grad -= a[:, j] * step
                w[j] = new
                biggest = max(biggest, abs(step) * np.sqrt(a[j, j]))
        if biggest <= tol:
            break
    return LinearFit(w, float(mean[-1] - w @ mean[:-1]))


def held_r2(fit: LinearFit, m: tuple) -> float:
    """R2 of a fit on the rows summed in m."""
    n, mean, s = m
    c = fit.coef
    off = mean[-1] - fit.intercept - c @ mean[:-1]
    sse = s[-1, -1] - 2 * c @ s[:-1, -1] + c @ s[:-1, :-1] @ c + n * off * off
    return float(1 - sse / s[-1, -1]) if s[-1, -1] > 0 else float("nan")


def ols(df: DataFrame, vec: str, y: str) -> LinearFit:
    return solve_ridge(_sums(df, vec, y)[None])


def _grid(sums: dict, solver, alphas: Sequence[float]) -> GridResult:
    """Mean held-out R2 per penalty over the folds, then a fit on all rows with the best one."""
    folds = list(sums)
    scores = {}
    for alpha in alphas:
        held = [held_r2(solver(merged(sums[g] for g in folds if g != f), alpha), sums[f]) for f in folds]
        scores[float(alpha)] = float(np.mean(held))
    best = max(scores, key=scores.get)
    return GridResult(solver(merged(sums.values()), best), best, scores)


def ridge(df: DataFrame, vec: str, y: str, alphas: Sequence[float] = ALPHAS, fold: str | None = None) -> GridResult:
    """Ridge with the penalty chosen by cross validation over a fold column."""
    return _pick(df, vec, y, alphas, fold, solve_ridge)


def lasso(df: DataFrame, vec: str, y: str, alphas: Sequence[float] = ALPHAS, fold: str | None = None) -> GridResult:
    """Lasso with the penalty chosen by cross validation over a fold column."""
    return _pick(df, vec, y, alphas, fold, solve_lasso)


def _pick(df, vec, y, alphas, fold, solver) -> GridResult:
    alphas = [alphas] if isinstance(alphas, (int, float)) else list(alphas)
    if fold is None:
        if len(alphas) > 1:
            raise ValueError("a penalty grid needs a fold column")
        return GridResult(solver(_sums(df, vec, y)[None], alphas[0]), alphas[0], {})
    return _grid(_sums(df, vec, y, fold), solver, alphas)


class PcaFit(NamedTuple):
    mean: np.ndarray
    components: np.ndarray  # k x d, largest entry of each row positive
    variances: np.ndarray

    def transform(self, df: DataFrame, vec: str, out: str = "scores") -> DataFrame:
        """Centred projection; the mean is the one of the fit rows."""
        shift = self.components @ self.mean
        axes = [(F.array(*[F.lit(float(x)) for x in row]), float(c)) for row, c in zip(self.components, shift)]
        return df.withColumn(out, let(F.col(vec), lambda v: F.array(*[dot(v, a) - F.lit(c) for a, c in axes])))


def _axes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(s)
    order = values.argsort()[::-1]
    rows = vectors[:, order].T
    signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])
    return np.maximum(values[order], 0.0), rows * np.where(signs == 0, 1, signs)[:, None]


def pca(df: DataFrame, vec: str, k: int) -> PcaFit:
    """Principal axes from the covariance of one scan."""
    n, mean, s = collect_moments(df.select(F.col(vec).cast("array<double>").alias("__v")), "__v")[None]
    values, rows = _axes(s / max(n - 1, 1))
    return PcaFit(mean, rows[:k], values[:k])


def pca_log_likelihood(train: tuple, held: tuple, k: int) -> float:
    """Mean log likelihood of held rows under probabilistic PCA with k axes (Tipping & Bishop, 1999)."""
    n, mean, s = train
    values, rows = _axes(s / max(n - 1, 1))
    d = len(values)
    noise = values[k:].mean() if k < d else 0.0
    spread = np.concatenate([values[:k], np.full(d - k, noise)])
    if (spread <= 0).any():
        return float("-inf")
    off = held[1] - mean
    seen = held[2] / held[0] + np.outer(off, off)
    along = np.einsum("ij,jk,ik->i", rows, seen, rows)
    return float(-0.5 * (d * np.log(2 * np.pi) + np.log(spread).sum() + (along / spread).sum()))


def select_pca_k(df: DataFrame, vec: str, ks: Sequence[int], fold: str) -> tuple[int, dict]:
    """The number of axes with the best mean held-out likelihood, and all scores: one scan."""
    sums = collect_moments(df.select(F.col(vec).cast("array<double>").alias("__v"), fold), "__v", fold)
    scores = {int(k): float(np.mean([
        pca_log_likelihood(merged(sums[g] for g in sums if g != f), sums[f], k) for f in sums])) for k in ks}
    return max(scores, key=scores.get), scores


class PcrFit(NamedTuple):
    pca: PcaFit
    lasso: GridResult

    def predict(self, df: DataFrame, vec: str, out: str = "prediction") -> DataFrame:
        scored = self.pca.transform(df, vec, "__scores")
        return self.lasso.fit.predict(scored, "__scores", out).drop("__scores")


def pcr(df: DataFrame, vec: str, y: str, ks: Sequence[int], fold: str, alphas: Sequence[float] = ALPHAS) -> PcrFit:
    """Principal-component regression: axes chosen by likelihood, then a lasso on the scores.

    The scores are a linear map of the columns, so their cross products follow from the ones
    already summed: the whole fit is one scan.
    """
    sums = _sums(df, vec, y, fold)
    x_only = {f: (n, m[:-1], s[:-1, :-1]) for f, (n, m, s) in sums.items()}
    scores = {int(k): float(np.mean([
        pca_log_likelihood(merged(x_only[g] for g in sums if g != f), x_only[f], k) for f in sums])) for k in ks if k}
    k = max(scores, key=scores.get)
    n, mean, s = merged(x_only.values())
    values, rows = _axes(s / max(n - 1, 1))
    axes = PcaFit(mean, rows[:k], values[:k])
    turn = np.block([[axes.components, np.zeros((k, 1))], [np.zeros((1, len(mean))), np.ones((1, 1))]])
    shift = np.append(axes.components @ mean, 0.0)
    rotated = {f: (n, turn @ m - shift, turn @ s @ turn.T) for f, (n, m, s) in sums.items()}
    return PcrFit(axes, _grid(rotated, solve_lasso, alphas))
