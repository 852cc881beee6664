"""Grid search for any estimator."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from functools import partial
from multiprocessing.pool import ThreadPool
from typing import Any, NamedTuple

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from ..session import cut_lineage
from .order import complement
from .stats import classes_of


class GridResult(NamedTuple):
    best: dict  # the parameters of the best mean score
    scores: list  # (parameters, mean held-out score, folds that gave one)
    fit: Any  # the estimator fitted with them on all rows


def grid_search(df: DataFrame, est: Callable[..., Any], grid: Iterable[dict], evaluator: Callable[[DataFrame], DataFrame],
                fold: str, predict: Callable[[Any, DataFrame], DataFrame] | None = None,
                larger_is_better: bool = False, parallelism: int = 4) -> GridResult:
    """Every parameter set of `grid`, scored on each held-out fold of a model fitted on the others.

    `est(rows, **params)` fits; `predict(fit, rows)` applies (by default `fit.transform(rows)`); `evaluator(rows)` is a
    one-row frame with the score in its first column. Folds without a score (null or NaN) are left out of the mean. The
    rows are stored once for all fits. The first of equal scores wins. `parallelism` fits run at a time, so that the end of
    one does not leave the cluster idle. Estimators with a search of their own (penalty grids, kernels, boosting) fit all
    candidates in shared passes and are cheaper.
    """
    rows = cut_lineage(df)
    apply = predict or (lambda fit, part: fit.transform(part))
    folds, grid = classes_of(rows, fold), [dict(params) for params in grid]

    def score(params: dict, held) -> float | None:
        fit = est(complement(rows, fold, held), **params)
        value = evaluator(apply(fit, rows.filter(rows[fold] == held))).first()[0]
        return None if value is None or math.isnan(value) else float(value)

    tasks = [inheritable_thread_target(df.sparkSession)(partial(score, params, held)) for params in grid for held in folds]
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        values = pool.map(lambda task: task(), tasks, chunksize=1)
    scores = []
    for i, params in enumerate(grid):
        found = [v for v in values[i * len(folds):(i + 1) * len(folds)] if v is not None]
        scores.append((params, sum(found) / len(found) if found else math.nan, len(found)))
    known = [s for s in scores if s[2]]
    if not known:
        raise ValueError("no fold gave a score")
    best = (max if larger_is_better else min)(known, key=lambda s: s[1])[0]
    return GridResult(best, scores, est(rows, **best))
