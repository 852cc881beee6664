"""k-means, its sweep over k, nearest-centre assignment, colour palettes, Gaussian naive Bayes."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, squared_distance
from ..session import Shared, cut_lineage
from .batches import list_column, matrix
from .evaluate import silhouettes
from .gram import total_array


class KMeansFit(NamedTuple):
    centres: np.ndarray
    cost: float

    def transform(self, df: DataFrame, vec: str, out: str = "cluster") -> DataFrame:
        return assign(df, vec, self.centres, out)


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 0, max_iter: int = 500) -> KMeansFit:
    """k-means|| start, then Lloyd steps."""
    rows = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=1e-4).fit(rows)
    return KMeansFit(np.stack(model.clusterCenters()), float(model.summary.trainingCost))


def assign(df: DataFrame, vec: str, centres, out: str = "cluster") -> DataFrame:
    """Index of the nearest centre; ties to the lowest index."""
    points = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    dist = let(F.col(vec), lambda v: F.transform(points, lambda c: squared_distance(c, v)))
    return df.withColumn(out, let(dist, lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int")))


def lloyd_step(df: DataFrame, vec: str, centres) -> DataFrame:
    """(cluster, pos, n, mean): the centres after one step from the given ones."""
    cells = assign(df, vec, centres).select("cluster", F.posexplode(vec).alias("pos", "x"))
    return cells.groupBy("cluster", "pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"))


# Rows that starts are drawn from, and doubles of them that reach the driver at most.
START_ROWS, START_CELLS = 20_000, 4_000_000


def _start(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ (Arthur & Vassilvitskii, 2007) over sampled rows; fewer centres where these have fewer distinct values."""
    draw = np.random.default_rng([seed, k])
    chosen = [int(draw.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and far.sum() > 0:
        chosen.append(int(draw.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen].copy()


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of every row; ties to the lowest index."""
    return _nearest_grid(x, [centres])[:, 0]


def _nearest_grid(x: np.ndarray, grid: Sequence[np.ndarray]) -> np.ndarray:
    """Index of the nearest centre of every row in each set of centres (rows x sets); ties to the lowest index.

    Distances to the centres of all sets come from one matrix product; rows whose nearest centres are as good as equal in it
    are compared by differences.
    """
    ends = np.cumsum([0, *(len(c) for c in grid)])
    every = np.concatenate(grid)
    out, step = np.empty((len(x), len(grid)), np.int64), max(1, 2_000_000 // max(len(every), 1))
    square = (every * every).sum(1)
    turned = np.vstack([-2.0 * every.T, square])
    for lo in range(0, len(x), step):
        part = x[lo:lo + step]
        d, norm, at = np.hstack([part, np.ones((len(part), 1))]) @ turned, (part * part).sum(1), np.arange(len(part))
        for j, centres in enumerate(grid):
            own, few = d[:, ends[j]:ends[j + 1]], max(1, 2_000_000 // max(centres.size, 1))
            best = own.argmin(1)
            first = own[at, best]
            own[at, best] = np.inf
            slack = 1e-11 * (norm + square[ends[j]:ends[j + 1]].max())
            close = np.flatnonzero(~(own.min(1) > first + slack))
            for i in range(0, len(close), few):
                rows = close[i:i + few]
                best[rows] = ((part[rows][:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
            out[lo:lo + step, j] = best
    return out


def _add_members(total: np.ndarray, near: np.ndarray, x: np.ndarray) -> None:
    """Adds number and sum of the members of every cluster to `total` (clusters x (1 + width))."""
    total[:, 0] += np.bincount(near, minlength=len(total))
    if not np.isfinite(x).all():
        np.add.at(total[:, 1:], near, x)
        return
    member = np.zeros((len(total), len(x)))
    member[near, np.arange(len(x))] = 1.0
    total[:, 1:] += member @ x


def _add_grid(total: np.ndarray, near: np.ndarray, x: np.ndarray, ends: np.ndarray) -> None:
    """`_add_members` for several clusterings (columns of `near`), whose clusters start at `ends` in `total`."""
    if not np.isfinite(x).all():
        for j, (a, b) in enumerate(zip(ends, ends[1:])):
            _add_members(total[a:b], near[:, j], x)
        return
    place, step = near + ends[:-1], max(1, 2_000_000 // max(len(total), 1))
    total[:, 0] += np.bincount(place.ravel(), minlength=len(total))
    for lo in range(0, len(x), step):
        own = place[lo:lo + step]
        member = np.zeros((len(own), len(total)))
        member[np.arange(len(own))[:, None], own] = 1.0
        total[:, 1:] += member.T @ x[lo:lo + step]


def lloyd_grid(df: DataFrame, vec: str, starts: Sequence[np.ndarray], max_iter: int = 500, tol: float = 1e-4) -> list[np.ndarray]:
    """Centres after Lloyd steps from every start; all starts advance in the same passes.

    A start has ended when no centre moves by more than `tol`. A centre without rows stays. Starts that `max_iter` passes
    did not end are named in a warning. `df` is read once per pass: hand in a checkpointed or written table.
    """
    centres, todo = [c.copy() for c in starts], list(range(len(starts)))
    rows = df.select(F.col(vec).cast("array<double>").alias("x"))
    tasks = rows.rdd.getNumPartitions()
    for _ in range(max_iter):
        if not todo:
            break
        shared = Shared(df.sparkSession, [centres[i] for i in todo])

        def sums(batches):
            own = shared.value
            ends = np.cumsum([0, *(len(c) for c in own)])
            total = np.zeros((ends[-1], own[0].shape[1] + 1))
            for b in batches:
                _add_grid(total, _nearest_grid(b["x"], own), b["x"], ends)
            yield total.ravel()

        width = sum(centres[i].size + len(centres[i]) for i in todo)
        got, lo, still = total_array(rows, sums, tasks, width), 0, []
        shared.unpersist()
        for i in todo:
            size = centres[i].shape[0] * (centres[i].shape[1] + 1)
            t = got[lo:lo + size].reshape(len(centres[i]), -1)
            lo += size
            new = np.where(t[:, :1] > 0, t[:, 1:] / np.maximum(t[:, :1], 1), centres[i])
            if ((new - centres[i]) ** 2).sum(1).max() > tol * tol:
                still.append(i)
            centres[i] = new
        todo = still
    if todo:
        warnings.warn(f"{len(todo)} of {len(starts)} clusterings still moved after {max_iter} passes", stacklevel=2)
    return centres


def kmeans_grid(df: DataFrame, vec: str, ks: Sequence[int], seeds: Sequence[int], max_iter: int = 500) -> list[np.ndarray]:
    """Centres of one clustering per (k, seed) pair, k-means++ starts on START_ROWS sampled rows, Lloyd steps on all."""
    n = max(1, min(START_ROWS, START_CELLS // max(1, df.select(F.size(vec)).first()[0])))
    cells = F.col(vec).cast("array<double>")
    sample = df.select(cells.alias("x")).orderBy(F.xxhash64("x"), "x").limit(n).toPandas()
    x = matrix(sample["x"])
    return lloyd_grid(df, vec, [_start(x, k, seed) for k, seed in zip(ks, seeds, strict=True)], max_iter)


def assign_grid(df: DataFrame, vec: str, centres: Sequence[np.ndarray], out: str = "clusters") -> DataFrame:
    """An array of the nearest centre's index in each set of centres."""
    shared = Shared(df.sparkSession, list(centres))

    @F.arrow_udf("array<int>")
    def place(col: pa.Array) -> pa.Array:
        x = matrix(col)
        return list_column(_nearest_grid(x, shared.value).astype("int32"))

    return df.withColumn(out, place(F.col(vec).cast("array<double>")))


def kmeans_runs(df: DataFrame, vec: str, k: int, seeds: Sequence[int], out: str = "cluster") -> DataFrame:
    """The rows of `df` once per seed, with `run` (0..) and the cluster of the row in it; one plan for all runs."""
    rows = cut_lineage(df)
    centres = kmeans_grid(rows, vec, [k] * len(seeds), list(seeds))
    placed = assign_grid(rows, vec, centres, "__all")
    return placed.select(*df.columns, F.posexplode("__all").alias("run", out))


def kmeans_sweep(df: DataFrame, key: str, vec: str, ks: Sequence[int] = tuple(range(2, 50)), seed: int = 0,
                 metric: str = "euclidean") -> DataFrame:
    """(k, silhouette, inertia, calinski_harabasz) for every k.

    All k advance in the same Lloyd passes, and their scores share one pass over the distances. A k above the number of
    distinct rows has as many clusters as these.
    """
    ks = list(ks)
    rows = cut_lineage(df.select(key, F.col(vec).cast("array<double>").alias(vec)))
    centres = kmeans_grid(rows, vec, ks, [seed] * len(ks))
    placed = cut_lineage(assign_grid(rows, vec, centres, "__all"))
    mean = [r[0] for r in rows.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
            .orderBy("pos").select("m").collect()]

    def sums(batches):
        total = [np.zeros((len(c), len(mean) + 1)) for c in centres]
        square = 0.0
        for b in batches:
            x, own = b[vec] - np.array(mean), b["__all"]
            square += (x * x).sum()
            for j, t in enumerate(total):
                _add_members(t, own[:, j], x)
        yield np.concatenate([[square], *(t.ravel() for t in total)])

    got, lo, scores = total_array(placed, sums), 1, []
    shapes = silhouettes(placed, key, vec, "__all", len(ks), metric)
    for k, c, shape in zip(ks, centres, shapes):
        t = got[lo:lo + len(c) * (len(mean) + 1)].reshape(len(c), -1)
        lo += t.size
        n, held = t[:, 0].sum(), int((t[:, 0] > 0).sum())
        between = float(((t[:, 1:] ** 2).sum(1) / np.maximum(t[:, 0], 1)).sum())
        within = max(float(got[0]) - between, 0.0)
        ch = float(between * (n - held) / (within * (held - 1))) if within > 0 and held > 1 else None
        scores.append((int(k), shape, within, ch))
    return df.sparkSession.createDataFrame(scores, "k int, silhouette double, inertia double, calinski_harabasz double")


class Palette(NamedTuple):
    fit: KMeansFit

    def codes(self, pixels: DataFrame) -> DataFrame:
        """Adds the colour code of every pixel."""
        rgb = pixels.withColumn("__rgb", F.array(*[F.col(c).cast("double") for c in "rgb"]))
        return self.fit.transform(rgb, "__rgb", "code").drop("__rgb")


def palette(pixels: DataFrame, k: int = 4, seed: int = 1) -> Palette:
    """k colours from all pixels; equal colours are clustered once, weighted by their count."""
    rgb = F.array(*[F.col(c).cast("double") for c in "rgb"])
    counted = pixels.groupBy(rgb.alias("__rgb")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    rows = counted.select(array_to_vector("__rgb").alias("features"), "w")
    model = KMeans(k=k, seed=seed, maxIter=500, weightCol="w").fit(rows)
    return Palette(KMeansFit(np.stack(model.clusterCenters()), float(model.summary.trainingCost)))


class NaiveBayesFit(NamedTuple):
    classes: list
    prior: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    def transform(self, df: DataFrame, vec: str, out: str = "prediction") -> DataFrame:
        shared = Shared(df.sparkSession, self)

        @F.arrow_udf("int")
        def best(col: pa.Array) -> pa.Array:
            m = shared.value
            x = matrix(col)
            score = np.stack([np.log(m.prior[i]) - 0.5 * (np.log(2 * np.pi * m.var[i]) + (x - m.mean[i]) ** 2 / m.var[i]).sum(1)
                              for i in range(len(m.classes))], axis=1)
            return pa.array(score.argmax(1).astype("int32"))

        names = F.array(*[F.lit(c) for c in self.classes])
        return df.withColumn(out, F.element_at(names, best(F.col(vec).cast("array<double>")) + 1))


def class_moments(df: DataFrame, vec: str, y: str) -> DataFrame:
    """(class, pos, n, mean, var): per-class means and population variances."""
    cells = df.select(F.col(y).alias("class"), F.posexplode(vec).alias("pos", "x"))
    return cells.groupBy("class", "pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


def gaussian_nb(df: DataFrame, vec: str, y: str, smoothing: float = 1e-9) -> NaiveBayesFit:
    """Gaussian naive Bayes; variances get `smoothing` times the largest column variance."""
    rows = class_moments(df, vec, y).toPandas()
    wide = df.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.var_pop("x").alias("v")).agg(F.max("v")).first()[0]
    classes = sorted(rows["class"].unique().tolist())
    pivot = {c: rows[rows["class"] == c].sort_values("pos") for c in classes}
    n = np.array([pivot[c]["n"].iloc[0] for c in classes], dtype=float)
    return NaiveBayesFit(classes, n / n.sum(), np.stack([pivot[c]["mean"].to_numpy() for c in classes]),
                         np.stack([pivot[c]["var"].to_numpy() for c in classes]) + smoothing * float(wide))
