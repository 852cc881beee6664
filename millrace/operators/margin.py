"""Penalised margin models on a grid: logistic, linear SVM, RBF SVM and SVR.

All (feature map, penalty, fold, class) problems of a grid advance together by Newton's method with conjugate gradients.
Every problem asks for one vector a pass: its gradient at a trial point, or the product of its Hessian with a
direction. Tasks return these vectors, d numbers a problem. Only a problem with the L1 penalty whose conjugate gradients
run out of steps or lead nowhere lower asks for its d x d Hessian as well, as far as MATRIX_CELLS go.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax, dot, let
from ..session import Shared, stored
from .batches import list_column, matrix
from .gram import total_array
from .stats import classes_of

# Penalty grids and kernel widths of the classifiers.
C_GRID = tuple(range(1, 10))
C_GRID_SMALL = (0.5, 1.0, 1.5)
GAMMA_GRID = (0.001, 0.01, 0.1, 1, 3, 5, 7, 10)


def _pointwise(loss: str, f: np.ndarray, t: np.ndarray, eps: float):
    """Loss, slope and curvature in the score f for targets t (+-1, or real for 'squared_eps')."""
    if loss == "logistic":
        z = t * f
        p = 1.0 / (1.0 + np.exp(np.clip(z, -700, 700)))
        return np.logaddexp(0.0, -z), -t * p, p * (1 - p)
    if loss == "squared_hinge":
        gap = np.maximum(1 - t * f, 0.0)
        return gap * gap, -2 * t * gap, 2.0 * (gap > 0)
    if loss == "squared_eps":
        r = f - t
        over = np.maximum(np.abs(r) - eps, 0.0)
        return over * over, 2 * np.sign(r) * over, 2.0 * (over > 0)
    raise ValueError(f"unknown loss {loss}")


class Problem(NamedTuple):
    c: float
    fold: int  # rows of this fold are left out; -1 for none
    target: object  # class of a one-vs-rest problem, None for a real target
    map: int = 0  # number of the feature map


class Features(NamedTuple):
    """Random Fourier features: sqrt(2 / n) cos(x @ w + b)."""

    w: np.ndarray
    b: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / len(self.b)) * np.cos(x @ self.w + self.b)


def _design(x: np.ndarray, features: Features | None) -> np.ndarray:
    return np.hstack([x if features is None else features.of(x), np.ones((len(x), 1))])


# The sample that shapes the search directions: rows as a multiple of the number of features, and doubles at most.
SHAPE_ROWS, SHAPE_CELLS = 4, 2_000_000
# Doubles of the state of problems that advance together, and scores (rows x problems) that a task holds at once.
STATE_CELLS, SCORE_CELLS = 4_000_000, 500_000
# Conjugate-gradient steps of one Newton step, step halvings, and halvings that show a problem to be hard.
CG_STEPS, HALVINGS, HARD_HALVINGS = 60, 40, 3
# Doubles of the Hessians that a task returns in one pass.
MATRIX_CELLS = 2_000_000


class _Shape:
    """Approximate inverse Hessians (1 + c k S)^-1 of one feature map and fold, S from a bounded sample of rows.

    They precondition the conjugate gradients: a rough S costs steps and never changes a solution.
    """

    def __init__(self, x: np.ndarray, share: float):
        value, self.basis = np.linalg.eigh(x.T @ x * share)
        self.value = np.maximum(value, 0.0)

    def solve(self, r: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (r @ self.basis) / (1.0 + k[:, None] * self.value[None]) @ self.basis.T


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _least(a: np.ndarray, b: np.ndarray, weigh: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The v of least v a v / 2 + b v + weigh |v|, searched over signs from those of the given v (Lee et al., 2007).

    Coordinates of fixed signs are solved at once; where signs turn on the way, the lowest of the turning points is taken.
    Then the zero coordinate of the steepest slope joins. Every round lowers the value.
    """
    def value(x):
        return 0.5 * ((x @ a) * x).sum(-1) + x @ b + np.abs(x) @ weigh

    best, bound, joined = value(v), weigh + 1e-10 * (weigh + np.abs(b)), False
    active, side = (v != 0) | (weigh == 0), np.sign(v) * (weigh > 0)
    for _ in range(20 * len(v)):
        own, goal = np.flatnonzero(active), np.zeros(len(v))
        goal[own] = np.linalg.solve(a[np.ix_(own, own)], -(b + side * weigh)[own])
        turns = own[goal[own] * side[own] < 0]
        if len(turns):
            at = v[turns] / (v[turns] - goal[turns])
            shares = np.unique(at)
            points = v + shares[:, None] * (goal - v)
            points[np.searchsorted(shares, at), turns] = 0.0
            points = np.vstack([points, goal])
            goal = points[value(points).argmin()]
        now = value(goal)
        fell = now < best
        if fell:
            v, best = goal, now
            active, side = (v != 0) | (weigh == 0), np.sign(v) * (weigh > 0)
            if len(turns):
                continue
        elif joined:
            break
        slope = a @ v + b
        over = np.where(active, 0.0, np.abs(slope) - bound)
        i = int(over.argmax())
        if over[i] <= 0:
            break
        active[i], side[i], joined = True, -np.sign(slope[i]), True
    return v


class _Newton:
    """State of problems that advance together: one row each.

    A problem is in mode "point" (it asks for loss and gradient at `trial`) or "product" (for the Hessian at `w` times
    `p`). With the L1 penalty the steps stay in the orthant of the pseudo-gradient (Byrd et al. 2012): coordinates that
    are zero and stay zero are left out, and those that would change sign are set to zero. A problem with this penalty
    that spent CG_STEPS without reaching its goal, or halved a step HARD_HALVINGS times, is `hard`: its points come with the
    Hessian, and its step goes to the minimum of the penalised quadratic form (Lee et al. 2012).
    """

    def __init__(self, problems: list, d: int, penalty: str, free: np.ndarray, curve: float, shapes: dict, tol: float):
        n = len(problems)
        self.problems, self.l1, self.tol = problems, penalty == "l1", tol
        self.c = np.array([p.c for p in problems])
        self.weigh = np.where(free, 0.0, 1.0)
        self.groups: dict = {}
        for i, p in enumerate(problems):
            self.groups.setdefault((p.map, p.fold), []).append(i)
        self.shapes, self.k = shapes, self.c * curve
        self.w, self.g, self.trial = np.zeros((n, d)), np.zeros((n, d)), np.zeros((n, d))
        self.value = np.full(n, np.inf)
        self.step, self.r, self.p, self.z = (np.zeros((n, d)) for _ in range(4))
        self.rz, self.goal, self.first = np.zeros(n), np.zeros(n), np.full(n, np.nan)
        self.alpha, self.inner, self.halved = np.ones(n), np.zeros(n, int), np.zeros(n, int)
        self.active = np.ones((n, d), bool)
        self.point = np.ones(n, bool)
        self.open, self.converged = np.ones(n, bool), np.zeros(n, bool)
        self.hard, self.exact, self.promise = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n)

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """Points and directions of all problems; a direction of nan asks for loss and gradient."""
        return (np.where(self.point[:, None], self.trial, self.w)[self.open],
                np.where(self.point[:, None], np.nan, self.p)[self.open])

    def square(self) -> np.ndarray:
        """Which of the open problems want the Hessian at their point."""
        return (self.hard & self.point)[self.open]

    def told(self, loss: np.ndarray, vector: np.ndarray, matrices: np.ndarray) -> None:
        """Takes the sums of the open problems, in order."""
        at = np.flatnonzero(self.open)
        point = self.point[at]
        self._points(at[point], loss[point], vector[point], dict(zip(at[self.square()], matrices)))
        self._products(at[~point], vector[~point])

    def _condition(self, i: np.ndarray, r: np.ndarray) -> np.ndarray:
        out, place = np.empty_like(r), np.full(len(self.problems), -1)
        place[i] = np.arange(len(i))
        for key, members in self.groups.items():
            own = place[members]
            own = own[own >= 0]
            if len(own):
                out[own] = self.shapes[key].solve(r[own], self.k[i[own]])
        return np.where(self.active[i], out, 0.0)

    def _points(self, i: np.ndarray, loss: np.ndarray, vector: np.ndarray, matrices: dict) -> None:
        if not len(i):
            return
        w = self.trial[i]
        size = np.abs(w) if self.l1 else 0.5 * w * w
        value = self.c[i] * loss + (size * self.weigh).sum(1)
        moved = w - self.w[i]
        known = np.isfinite(self.value[i])
        slack = 1e-12 * np.abs(np.where(known, self.value[i], 0.0))
        # The pseudo-gradient was kept in g: enough descent is a share of what it promises.
        fall = np.where(self.exact[i], self.alpha[i] * self.promise[i], _dots(self.g[i], moved))
        good = ~known | (value <= self.value[i] + 1e-4 * fall + slack)
        self._halve(i[~good])
        i, w, value, vector = i[good], w[good], value[good], vector[good]
        if not len(i):
            return
        stuck = np.isfinite(self.value[i]) & (self.value[i] - value <= 1e-14 * np.abs(value)) & (self.alpha[i] > 0)
        g = self.c[i][:, None] * vector
        if self.l1:
            side = np.where(w != 0, np.sign(w), np.where(g < -1, 1.0, np.where(g > 1, -1.0, 0.0))) * self.weigh
            g = np.where((w == 0) & (side == 0) & (self.weigh > 0), 0.0, g + side)
            self.active[i] = (w != 0) | (g != 0)
        else:
            g = g + self.weigh * w
        self.w[i], self.g[i], self.value[i] = w, g, value
        norm = np.sqrt(_dots(g, g))
        self.first[i] = np.where(np.isnan(self.first[i]), norm, self.first[i])
        ended = (norm <= self.tol * np.maximum(self.first[i], 1e-300)) | (norm == 0) | stuck
        self.converged[i[ended]], self.open[i[ended]] = True, False
        direct = ~ended & self.hard[i]
        for j, slope in zip(i[direct], vector[direct]):
            self._solve(j, self.c[j] * slope, self.c[j] * matrices[j])
        ended |= direct
        i, g, norm = i[~ended], g[~ended], norm[~ended]
        self.step[i], self.r[i] = 0.0, -np.where(self.active[i], g, 0.0)
        self.z[i] = self._condition(i, self.r[i])
        self.p[i], self.rz[i] = self.z[i], _dots(self.r[i], self.z[i])
        self.goal[i] = norm * np.minimum(0.1, norm / self.first[i])
        self.inner[i], self.halved[i], self.point[i], self.exact[i] = 0, 0, False, False

    def _solve(self, i: int, slope: np.ndarray, a: np.ndarray) -> None:
        """Aims problem `i` at the least value of its penalised quadratic form at w."""
        w, at = self.w[i], np.arange(len(a))
        a[at, at] += 1e-12 * (a[at, at] + max(a[at, at].max(), 1.0))
        v = _least(a, slope - a @ w, self.weigh, w)
        self.step[i], self.promise[i] = v - w, slope @ (v - w) + (np.abs(v) - np.abs(w)) @ self.weigh
        self.alpha[i], self.halved[i], self.exact[i] = 1.0, 0, True
        if self.promise[i] < 0:
            self._aim(np.array([i]))
        else:
            self.converged[i], self.open[i] = True, False

    def _products(self, i: np.ndarray, vector: np.ndarray) -> None:
        if not len(i):
            return
        p = self.p[i]
        product = self.c[i][:, None] * vector + (0.0 if self.l1 else self.weigh * p)
        product = np.where(self.active[i], product, 0.0) + 1e-10 * p
        alpha = self.rz[i] / np.maximum(_dots(p, product), 1e-300)
        self.step[i] += alpha[:, None] * p
        self.r[i] -= alpha[:, None] * product
        self.inner[i] += 1
        near = np.sqrt(_dots(self.r[i], self.r[i])) <= self.goal[i]
        ready = near | (self.inner[i] >= CG_STEPS)
        self._harden(i[ready & ~near])
        more = i[~ready]
        self.z[more] = self._condition(more, self.r[more])
        rz = _dots(self.r[more], self.z[more])
        self.p[more] = self.z[more] + (rz / self.rz[more])[:, None] * self.p[more]
        self.rz[more] = rz
        self.alpha[i[ready]] = 1.0
        self._aim(i[ready])

    def _aim(self, i: np.ndarray) -> None:
        trial = self.w[i] + self.alpha[i][:, None] * self.step[i]
        if self.l1:
            side = np.where(self.w[i] != 0, np.sign(self.w[i]), -np.sign(self.g[i]))
            trial = np.where((np.sign(trial) != side) & (self.weigh > 0) & ~self.exact[i][:, None], 0.0, trial)
        self.trial[i], self.point[i] = trial, True

    def _harden(self, i: np.ndarray) -> np.ndarray:
        """Marks problems as hard while there is room for their Hessians; returns those it marked."""
        room = MATRIX_CELLS // self.w.shape[1] ** 2 - int((self.hard & self.open).sum()) if self.l1 else 0
        i = i[~self.hard[i]][:max(room, 0)]
        self.hard[i] = True
        return i

    def _halve(self, i: np.ndarray) -> None:
        self.alpha[i] *= 0.5
        self.halved[i] += 1
        # Such a problem is asked for its Hessian where it stands.
        self.alpha[self._harden(i[self.halved[i] >= HARD_HALVINGS])] = 0.0
        ended = i[self.halved[i] > HALVINGS]  # no point beside this one is lower in the numbers' precision
        self.converged[ended], self.open[ended] = True, False
        self._aim(i[self.halved[i] <= HALVINGS])


def fit_grid(df: DataFrame, vec: str, y: str, problems: Sequence[Problem], loss: str, penalty: str,
             fold: str | None = None, eps: float = 0.1, penalise_bias: bool = False, tol: float = 1e-9,
             max_passes: int = 1000, maps: Sequence[Features | None] = (None,)) -> dict[Problem, np.ndarray]:
    """Weights (bias last) minimising penalty(w) + C * sum(loss) for every problem.

    `df` is read once per pass: hand in a checkpointed or written table. Problems that `max_passes` passes did not bring
    to a gradient of `tol` times the first one's are named in a warning.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec).cast("array<double>").alias("x"), F.col(y).alias("y"),
                     (F.col(fold) if fold else F.lit(-2)).cast("int").alias("fold"))
    width = rows.select(F.size("x")).first()[0]
    d = (width if maps[0] is None else len(maps[0].b)) + 1
    free = np.zeros(d, dtype=bool)
    free[-1] = not penalise_bias
    n, tasks = rows.count(), rows.rdd.getNumPartitions()
    some = max(1, min(SHAPE_ROWS * d, SHAPE_CELLS // max(width, 1)))
    sample = rows.select("x", "fold", F.xxhash64("x").alias("__r")).orderBy("__r").limit(some).toPandas()
    x = matrix(sample["x"])
    curve = {"logistic": 0.25, "squared_hinge": 1.0, "squared_eps": 1.0}[loss]
    shapes = {}
    for k, f in {(p.map, p.fold) for p in problems}:
        own = _design(x[(sample["fold"] != f).to_numpy()], maps[k])
        shapes[k, f] = _Shape(own, n / max(len(x), 1))
    done: dict[Problem, np.ndarray] = {}
    late, at_once = 0, max(1, STATE_CELLS // d)
    for lo in range(0, len(problems), at_once):
        state = _Newton(list(problems[lo:lo + at_once]), d, penalty, free, curve, shapes, tol)
        for _ in range(max_passes):
            if not state.open.any():
                break
            state.told(*_sums(spark, rows, [state.problems[i] for i in np.flatnonzero(state.open)], *state.asked(),
                              state.square(), loss, eps, maps, tasks))
        late += int((~state.converged).sum())
        done.update(zip(state.problems, state.w, strict=True))
    if late:
        warnings.warn(f"{late} of {len(problems)} fits did not converge in {max_passes} passes", stacklevel=2)
    return done


def _sums(spark, rows: DataFrame, todo: list, w: np.ndarray, p: np.ndarray, square: np.ndarray, loss: str, eps: float, maps,
          tasks: int):
    """Loss and gradient, or Hessian product, of every problem in one pass; also the Hessians of those marked in `square`."""
    by_map: dict[int, list[int]] = {}
    for i, q in enumerate(todo):
        by_map.setdefault(q.map, []).append(i)
    place = np.cumsum(square) - 1
    shared = Shared(spark, (todo, by_map, w, p, square, place, [maps[k] if k in by_map else None for k in range(len(maps))]))

    def vectors(batches):
        todo, by_map, w, p, square, place, maps = shared.value
        total, matrices = np.zeros((len(todo), 1 + w.shape[1])), np.zeros((int(square.sum()), w.shape[1], w.shape[1]))
        folds = np.array([q.fold for q in todo])
        point = np.isnan(p[:, 0])
        for b in batches:
            every = b["x"], b["y"].to_numpy(), b["fold"].to_numpy()
            for k, own in by_map.items():
                step = max(1, SCORE_CELLS // len(own))
                for lo in range(0, len(b), step):
                    raw, labels, fold_of = (column[lo:lo + step] for column in every)
                    x = _design(raw, maps[k])
                    if todo[own[0]].target is None:
                        t = labels.astype(float)[:, None]
                    else:
                        t = np.where(labels[:, None] == np.array([todo[i].target for i in own])[None], 1.0, -1.0)
                    use = fold_of[:, None] != folds[own][None]
                    value, slope, bend = _pointwise(loss, x @ w[own].T, t, eps)
                    at = point[own]
                    turn = np.zeros_like(slope)
                    if not at.all():
                        turn[:, ~at] = x @ p[np.array(own)[~at]].T
                    coefficient = np.where(at[None], slope, bend * turn) * use
                    total[own, 0] += (value * use).sum(0)
                    total[own, 1:] += coefficient.T @ x
                    for j in np.flatnonzero(square[own]):
                        weight = bend[:, j] * use[:, j]
                        seen = np.flatnonzero(weight)
                        matrices[place[own[j]]] += (x[seen] * weight[seen, None]).T @ x[seen]
        yield np.concatenate([total.ravel(), matrices.ravel()])

    size, d = w.size + len(w), w.shape[1]
    got = total_array(rows, vectors, tasks, size + int(square.sum()) * d * d)
    shared.unpersist()
    sums = got[:size].reshape(len(todo), -1)
    return sums[:, 0], sums[:, 1:], got[size:].reshape(-1, d, d)


class MarginFit(NamedTuple):
    classes: list | None  # None for a regression
    weights: np.ndarray  # classes x (d + 1), bias last

    def transform(self, df: DataFrame, vec: str, out: str = "prediction") -> DataFrame:
        """Score columns stay in the JVM: one dot product per class."""
        rows = [(F.array(*[F.lit(float(x)) for x in w[:-1]]), F.lit(float(w[-1]))) for w in self.weights]
        if self.classes is None:
            return df.withColumn(out, dot(F.col(vec), rows[0][0]) + rows[0][1])
        if len(self.classes) == 2:
            score = dot(F.col(vec), rows[0][0]) + rows[0][1]
            return df.withColumn(out, F.when(score > 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))
        scores = let(F.col(vec), lambda v: F.array(*[dot(v, a) + b for a, b in rows]))
        names = F.array(*[F.lit(c) for c in self.classes])
        return df.withColumn(out, F.element_at(names, argmax(scores) + 1))


class SearchResult(NamedTuple):
    fit: MarginFit
    best: float
    scores: dict


def _targets(classes: list | None) -> list:
    if classes is None:
        return [None]
    return [classes[1]] if len(classes) == 2 else list(classes)


def _held_scores(df, vec, y, fold, fits, cs, folds, classes, spark, maps) -> dict:
    """Mean held-out accuracy (or R2) per feature map and C over the folds, from one pass."""
    names, order = _targets(classes), list(folds)
    shared = Shared(spark, {(m, f): np.stack([fits[Problem(c, f, k, m)] for c in cs for k in names])
                            for m in range(len(maps)) for f in folds})

    def count(batches):
        total = np.zeros((len(maps), len(order), len(cs), 4))
        for b in batches:
            raw, y_all, fold_of = b["x"], b["y"].to_numpy(), b["fold"].to_numpy()
            for m, i in ((m, i) for m in range(len(maps)) for i in range(len(order))):
                held = np.nonzero(fold_of == order[i])[0]
                if not len(held):
                    continue
                s = (_design(raw[held], maps[m]) @ shared.value[m, order[i]].T).reshape(len(held), len(cs), len(names))
                t = y_all[held]
                if classes is None:
                    t = t.astype(float)
                    sums = [((s[:, :, 0] - t[:, None]) ** 2).sum(0), len(t), t.sum(), (t * t).sum()]
                else:
                    pick = (s[:, :, 0] > 0).astype(int) if len(classes) == 2 else s.argmax(2)
                    sums = [(np.asarray(classes)[pick] == t[:, None]).sum(0), len(t), 0.0, 0.0]
                for j, part in enumerate(sums):
                    total[m, i, :, j] += part
        yield total.ravel()

    rows = df.select(F.col(vec).cast("array<double>").alias("x"), F.col(y).alias("y"), F.col(fold).cast("int").alias("fold"))
    got = total_array(rows, count).reshape(len(maps), len(order), len(cs), 4)
    if classes is None:
        spread = got[..., 3] - got[..., 2] ** 2 / np.maximum(got[..., 1], 1)
        per_fold = 1 - got[..., 0] / np.where(spread > 0, spread, np.nan)
    else:
        per_fold = got[..., 0] / np.maximum(got[..., 1], 1)
    # A fold whose target is constant has no score; the others decide.
    known = ~np.isnan(per_fold)
    mean = np.where(known, per_fold, 0.0).sum(1) / np.maximum(known.sum(1), 1)
    return {(m, c): float(mean[m, j]) if known[m, :, j].any() else float("-inf")
            for m in range(len(maps)) for j, c in enumerate(cs)}


def _searched(df: DataFrame, vec: str, y: str, cs: Sequence[float], loss: str, penalty: str, fold: str | None,
              regression: bool, maps: Sequence[Features | None], **kw) -> tuple[MarginFit, int, float, dict]:
    """(fit on all rows, feature map, C, scores by both): the best by cross-validation, the first of equal ones.

    The final fits of every feature map and C ride along.
    """
    cs = [float(c) for c in ([cs] if isinstance(cs, (int, float)) else cs)]
    if fold is None and len(cs) > 1:
        raise ValueError("a grid of C needs a fold column")
    classes = None if regression else classes_of(df, y)
    names = _targets(classes)
    folds = classes_of(df, fold) if fold else []
    problems = [Problem(c, f, k, m) for m in range(len(maps)) for c in cs for f in [-1, *folds] for k in names]
    fits = fit_grid(df, vec, y, problems, loss, penalty, fold, maps=maps, **kw)
    scores = _held_scores(df, vec, y, fold, fits, cs, folds, classes, df.sparkSession, maps) if fold else {}
    m, c = max(scores, key=scores.get) if scores else (0, cs[0])
    return MarginFit(classes, np.stack([fits[Problem(c, -1, k, m)] for k in names])), m, c, scores


def search(df: DataFrame, vec: str, y: str, cs: Sequence[float], loss: str, penalty: str, fold: str | None = None,
           regression: bool = False, **kw) -> SearchResult:
    """Cross-validated C, then a fit on all rows."""
    fit, _, c, scores = _searched(df, vec, y, cs, loss, penalty, fold, regression, (None,), **kw)
    return SearchResult(fit, c, {c: v for (_, c), v in scores.items()})


def logistic(df: DataFrame, vec: str, y: str, cs: Sequence[float] = C_GRID, fold: str | None = None) -> SearchResult:
    """L2 logistic regression; the bias is not penalised."""
    return search(df, vec, y, cs, "logistic", "l2", fold)


def linear_svm_l1(df: DataFrame, vec: str, y: str, cs: Sequence[float] = C_GRID, fold: str | None = None) -> SearchResult:
    """|w|_1 + C sum max(0, 1 - t f)^2, one problem per class, bias penalised as a constant feature."""
    return search(df, vec, y, cs, "squared_hinge", "l1", fold, penalise_bias=True)


def fourier(d: int, gamma: float, n_features: int, seed: int) -> Features:
    """A draw of random Fourier features of the kernel exp(-gamma |x - y|^2) (Rahimi & Recht, 2007)."""
    draw = np.random.default_rng(seed)
    return Features(draw.normal(0.0, np.sqrt(2.0 * gamma), (d, n_features)), draw.uniform(0.0, 2 * np.pi, n_features))


def random_features(df: DataFrame, vec: str, gamma: float, n_features: int, seed: int, out: str = "rff") -> DataFrame:
    """The column of `fourier` features."""
    shared = Shared(df.sparkSession, fourier(df.select(F.size(vec)).first()[0], gamma, n_features, seed))

    @F.arrow_udf("array<double>")
    def lift(col: pa.Array) -> pa.Array:
        return list_column(shared.value.of(matrix(col)))

    return df.withColumn(out, lift(F.col(vec).cast("array<double>")))


class KernelResult(NamedTuple):
    fit: MarginFit
    gamma: float
    c: float
    scores: dict  # {(gamma, C): score}
    n_features: int
    seed: int

    def transform(self, df: DataFrame, vec: str, out: str = "prediction") -> DataFrame:
        lifted = random_features(df, vec, self.gamma, self.n_features, self.seed, "__rff")
        return self.fit.transform(lifted, "__rff", out).drop("__rff")


def _kernel(df, vec, y, cs, gammas, fold, n_features, seed, loss, regression, **kw) -> KernelResult:
    """All widths advance in the same passes; their features are computed from the vectors in the tasks."""
    gammas = [gammas] if isinstance(gammas, (int, float)) else list(gammas)
    if fold is None and len(gammas) > 1:
        raise ValueError("a grid of gamma needs a fold column")
    rows = stored(df.select(vec, y, *([fold] if fold else [])))
    d = rows.select(F.size(vec)).first()[0]
    maps = [fourier(d, g, n_features, seed) for g in gammas]
    fit, m, c, scores = _searched(rows, vec, y, cs, loss, "l2", fold, regression, maps, **kw)
    return KernelResult(fit, float(gammas[m]), c, {(float(gammas[m]), c): v for (m, c), v in scores.items()}, n_features, seed)


def rbf_svm(df: DataFrame, vec: str, y: str, cs: Sequence[float] = C_GRID, gammas: Sequence[float] = GAMMA_GRID,
            fold: str | None = None, n_features: int = 256, seed: int = 0) -> KernelResult:
    """RBF-kernel classifier, one-vs-rest, on random features; `n_features` sets the accuracy."""
    return _kernel(df, vec, y, cs, gammas, fold, n_features, seed, "squared_hinge", False)


def rbf_svr(df: DataFrame, vec: str, y: str, cs: Sequence[float] = C_GRID_SMALL, gammas: Sequence[float] | None = None,
            fold: str | None = None, eps: float = 0.1, n_features: int = 256, seed: int = 0) -> KernelResult:
    """RBF-kernel regression with an epsilon-insensitive squared loss; default width 1 / d."""
    if gammas is None:
        gammas = [1.0 / df.select(F.size(vec)).first()[0]]
    return _kernel(df, vec, y, cs, gammas, fold, n_features, seed, "squared_eps", True, eps=eps)


class ChainFit(NamedTuple):
    fits: list
    labels: list

    def transform(self, df: DataFrame, vec: str) -> DataFrame:
        """Adds p_<label> columns; each model sees the predictions before it."""
        out, feats = df, F.col(vec).cast("array<double>")
        for fit, label in zip(self.fits, self.labels):
            out = fit.transform(out.withColumn("__chain", feats), "__chain", f"p_{label}").drop("__chain")
            feats = F.concat(feats, F.array(F.col(f"p_{label}").cast("double")))
        return out


def classifier_chain(df: DataFrame, vec: str, labels: Sequence[str], c: float = 6.0, gamma: float = 3.0,
                     n_features: int = 256, seed: int = 0) -> ChainFit:
    """One RBF classifier per label; model j also sees the true labels 1..j-1 as features."""
    fits, feats = [], F.col(vec).cast("array<double>")
    for label in labels:
        rows = df.withColumn("__chain", feats).select("__chain", label)
        fits.append(rbf_svm(rows, "__chain", label, [c], [gamma], None, n_features, seed))
        feats = F.concat(feats, F.array(F.col(label).cast("double")))
    return ChainFit(fits, list(labels))
