"""Tree ensembles: a level-wise histogram grower, and the forests Spark ships.

The grower covers what the built-in trees lack: an L1 leaf penalty, random thresholds, and many
ensembles (penalty x fold, or all trees of a forest) growing in the same pass. One pass per level
sums gradient histograms per (tree, node, feature, bin) in the tasks; Spark adds them up in blocks, and the driver sees
only the sums and picks the splits. Of two siblings only the smaller is summed; the other is its parent less the
smaller. Rows are binned once to a byte per feature and kept in chunks beside the margins of all ensembles. Rows with the
same bins and fold always share their margins: where the bins of all features have few combinations, such rows become
one weighted row, and a pass costs the combinations there are, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Shared, cut_lineage, drop_path, new_path, stored
from .batches import list_column, map_batches, matrix
from .gram import _FLUSH_CELLS, total_array
from .stats import classes_of

# The L1 leaf penalties that are searched.
L1_GRID = (1e-5, 1e-2, 0.1, 1, 100)


class Tree(NamedTuple):
    """Nodes in heap order: children of i are 2i+1 and 2i+2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray  # bin of the threshold
    value: np.ndarray  # node x output


def _bins(df: DataFrame, vec: str, n_bins: int) -> list[np.ndarray]:
    """Bin edges per feature from approximate quantiles: one aggregate, d x n_bins numbers."""
    cells = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    probs = [i / n_bins for i in range(1, n_bins)]
    rows = cells.groupBy("pos").agg(F.percentile_approx("x", probs, 10_000).alias("e")).orderBy("pos").collect()
    return [np.unique(np.array(r["e"], dtype=float)) for r in rows]


def _digitize(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int8)


def _leaf_of(tree: Tree, bins: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(bins), dtype=np.int64)
    cells, start = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    for _ in range(depth):
        f = tree.feature.take(node)
        right = cells.take(start + np.maximum(f, 0)) > tree.cut.take(node)
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def _soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0) if alpha else g


class Spec(NamedTuple):
    """One ensemble or one tree of a forest."""

    l1: float = 0.0
    l2: float = 1.0
    fold: int = -1  # rows of this fold are left out
    seed: int = 0
    own: bool = False  # instead, only the rows of this fold are used

    def rows(self, fold: np.ndarray) -> np.ndarray:
        return fold == self.fold if self.own else fold != self.fold


def _gradient(loss: str, y: np.ndarray, margin: np.ndarray, n_out: int):
    """Gradient (rows x outputs) and hessian (rows) at the current margin."""
    if loss == "logistic":
        p = 1.0 / (1.0 + np.exp(-margin))
        return (p - y)[:, None], p * (1 - p)
    if loss == "squared":
        return (margin - y)[:, None], np.ones(len(y))
    g = np.zeros((len(y), n_out))  # 'classes': leaf values become class shares
    g[np.arange(len(y)), y.astype(int)] = -1.0
    return g, np.ones(len(y))


class Ensemble(NamedTuple):
    edges: list
    trees: list
    depth: int
    base: float
    eta: float
    kind: str  # 'sum' (boosting), 'mean' (forest regression), 'vote' (forest classes), 'logistic'
    classes: list | None = None

    def scores(self, bins: np.ndarray) -> np.ndarray:
        total = sum(t.value[_leaf_of(t, bins, self.depth)] for t in self.trees)
        return self.base + self.eta * total if self.kind in ("sum", "logistic") else total / len(self.trees)

    def transform(self, df: DataFrame, vec: str, out: str = "prediction", score: str | None = None) -> DataFrame:
        """Adds the prediction (a value or a class) and optionally the raw score of the last output."""
        shared = Shared(df.sparkSession, self)

        @F.arrow_udf("array<double>")
        def run(col: pa.Array) -> pa.Array:
            model = shared.value
            return list_column(model.scores(_digitize(matrix(col), model.edges)))

        scored = df.withColumn("__s", run(F.col(vec).cast("array<double>")))
        last = F.element_at("__s", -1)
        if self.kind == "logistic":
            value = F.when(last >= 0, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0]))
        elif self.kind == "vote":
            names = F.array(*[F.lit(c) for c in self.classes])
            value = F.element_at(names, F.array_position("__s", F.array_max("__s")).cast("int"))
        else:
            value = last
        scored = scored.withColumn(out, value)
        return (scored.withColumn(score, last) if score else scored).drop("__s")


# Trees grown between two writings of the margins, and rows of a chunk.
REFRESH, CHUNK_ROWS = 2, 8192
# Whether siblings come from their parents' sums where all features are tried at every node.
SUBTRACT = True
# Combinations of bins up to which equal rows are summed up first, and such sums a task holds.
COMBINATIONS, CELL_ROWS = 4_000_000, 10_000
CHUNK = T.StructType([T.StructField(name, T.BinaryType()) for name in ("b", "y", "fold", "n", "rest", "m")])


class _Chunk:
    """Rows side by side: bins (rows x features), targets, folds, margins (ensembles x rows).

    Rows that stand for several have their number in `n`, and in `rest` the squares of their targets about the mean.
    """

    def __init__(self, b: bytes, y: bytes, fold: bytes, n: bytes, rest: bytes, m: bytes):
        self.y, self.fold = np.frombuffer(y), np.frombuffer(fold, np.int32)
        self.bins = np.frombuffer(b, np.int8).reshape(len(self.y), -1)
        self.n, self.rest = (np.frombuffer(x) if len(x) else None for x in (n, rest))
        self.m = np.frombuffer(m).reshape(-1, len(self.y))

    @staticmethod
    def record(bins, y, fold, n, rest, m) -> pa.RecordBatch:
        none = np.zeros(0)
        parts = [np.ascontiguousarray(none if x is None else x).tobytes() for x in (bins, y, fold, n, rest, m)]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=CHUNK.names)


def _chunks(batches):
    for batch in batches:
        columns = [batch[name] for name in CHUNK.names]
        for k in range(len(batch)):
            yield _Chunk(*(c.iloc[k] for c in columns))


class _Grower:
    def __init__(self, df: DataFrame, vec: str, y: str, fold: str | None, loss: str, specs: Sequence[Spec],
                 depth: int, n_bins: int, n_out: int, eta: float, base: float, min_child: float,
                 features: int | None, random_cut: bool):
        self.loss, self.specs, self.depth, self.n_out = loss, list(specs), depth, n_out
        self.eta, self.base, self.min_child, self.random_cut = eta, base, min_child, random_cut
        if not 2 <= n_bins <= 127:
            raise ValueError("n_bins must fit a signed byte: 2 to 127")
        self.edges = _bins(df, vec, n_bins)
        self.d, self.n_bins = len(self.edges), max(len(e) for e in self.edges) + 1
        self.m = min(features or self.d, self.d)
        self.subtract = SUBTRACT and self.m == self.d
        self.done: list[list[Tree]] = [[] for _ in specs]  # finished trees per ensemble
        self.folded = 0  # trees already inside the stored margins
        self.path = ""
        edges = self.edges

        def binned(batches):
            for b in batches:
                bins, y, fold = _digitize(b["x"], edges), b["y"].to_numpy(float), b["fold"].to_numpy(np.int32)
                for lo in range(0, len(b), CHUNK_ROWS):
                    own = slice(lo, lo + CHUNK_ROWS)
                    yield _Chunk.record(bins[own], y[own], fold[own], None, None, None)

        rows = df.select(F.col(vec).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"),
                         (F.col(fold) if fold else F.lit(-2)).cast("int").alias("fold"))
        self.summed = math.prod(len(e) + 1 for e in edges) <= COMBINATIONS
        self.rows = self._cells(rows) if self.summed else cut_lineage(map_batches(stored(rows, "x", "y", "fold"), binned, CHUNK))
        self.tasks = self.rows.rdd.getNumPartitions()

    def _cells(self, rows: DataFrame) -> DataFrame:
        """Chunks of one weighted row per combination of bins and fold, and per target where the loss is not squared.

        A squared loss needs the mean of such rows' targets only, and for its value their squares about it.
        """
        edges, base, squared = self.edges, self.base, self.loss == "squared"
        radix = np.cumprod([1, *(len(e) + 1 for e in edges)])[:-1].astype(np.int64)

        def coded(batches):
            for b in batches:
                code = _digitize(b["x"], edges).astype(np.int64) @ radix
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(b["fold"].to_numpy(np.int32)),
                                                  pa.array(b["y"].to_numpy(float))], names=["code", "fold", "y"])

        def chunks(batches):
            for b in batches:
                code, n = b["code"].to_numpy(), b["n"].to_numpy(float)
                bins = np.stack([code // r % (len(e) + 1) for r, e in zip(radix, edges)], axis=1).astype(np.int8)
                y, rest = b["y"].to_numpy(float), None
                if squared:
                    rest = np.maximum(b["s"].to_numpy(float) - y * y / n, 0.0)
                    y = base + y / n
                yield _Chunk.record(bins, y, b["fold"].to_numpy(np.int32), n, rest, None)

        codes = map_batches(rows, coded, T.StructType([T.StructField("code", T.LongType()), T.StructField("fold", T.IntegerType()),
                                                       T.StructField("y", T.DoubleType())]))
        off = F.col("y") - F.lit(float(base))
        if squared:
            cells = codes.groupBy("code", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(off).alias("y"), F.sum(off * off).alias("s"))
        else:
            cells = codes.groupBy("code", "fold", "y").agg(F.count(F.lit(1)).alias("n"))
        cells = cut_lineage(cells)
        parts = max(1, min(-(-cells.count() // CELL_ROWS), max(cells.sparkSession.sparkContext.defaultParallelism,
                                                               cells.rdd.getNumPartitions())))
        return cut_lineage(map_batches(cells.repartition(parts, "code", "fold"), chunks, CHUNK))

    def _margins(self):
        """Function (chunk, ensemble) -> margin before the tree now growing."""
        base, eta, depth, start = self.base, self.eta, self.depth, self.folded
        later = [trees[start:] for trees in self.done]

        def margin(chunk, i):
            m = chunk.m[i] if start else np.full(len(chunk.y), base)
            for tree in later[i]:
                m = m + eta * tree.value[_leaf_of(tree, chunk.bins, depth), 0]
            return m

        return margin

    def _histograms(self, which: list[int], trees: list[Tree], slots: list[np.ndarray], picks: list[np.ndarray],
                    level: int) -> list[np.ndarray]:
        """Per ensemble the sums (asked node, feature, bin, output + 1) of one level: one pass for all."""
        margin, loss, n_out, m, n_bins = self._margins(), self.loss, self.n_out, self.m, self.n_bins
        specs, whole = [self.specs[i] for i in which], self.m == self.d
        boosted = loss != "classes"
        shared = Shared(self.rows.sparkSession, (trees, slots, picks))

        def sums(batches):
            grown, open_, chosen = shared.value
            total = [np.zeros((n_out + 1, len(o) * m * n_bins)) for o in open_]
            for chunk in _chunks(batches):
                places = chunk.bins + np.arange(m) * n_bins if whole else None  # of a row's cells, in a node's sums
                for k, i in enumerate(which):
                    slot_of = np.full(2 ** (level + 1) - 1, -1)
                    slot_of[open_[k]] = np.arange(len(open_[k]))
                    slot = slot_of[_leaf_of(grown[k], chunk.bins, level)]
                    use = np.flatnonzero((slot >= 0) & specs[k].rows(chunk.fold))
                    if not len(use):
                        continue
                    g, h = _gradient(loss, chunk.y, margin(chunk, i) if boosted else chunk.y, n_out)
                    if chunk.n is not None:
                        g, h = g * chunk.n[:, None], h * chunk.n
                    at = slot[use]
                    if whole:
                        flat = (places[use] + (at * (m * n_bins))[:, None]).ravel()
                    else:
                        cell = np.take_along_axis(chunk.bins[use], chosen[k][at], axis=1).astype(np.int64)
                        flat = ((at[:, None] * m + np.arange(m)[None]) * n_bins + cell).ravel()
                    width = total[k].shape[1]
                    for c in range(n_out):
                        total[k][c] += np.bincount(flat, weights=np.repeat(g[use, c], m), minlength=width)
                    counted = loss != "logistic" and chunk.n is None  # every row counts 1
                    weights = None if counted else np.repeat(h[use], m)
                    total[k][n_out] += np.bincount(flat, weights=weights, minlength=width)
            yield np.concatenate([t.ravel() for t in total])

        got = total_array(self.rows, sums, self.tasks, sum((n_out + 1) * len(o) * m * n_bins for o in slots))
        shared.unpersist()
        out, start = [], 0
        for o in slots:
            size = (n_out + 1) * len(o) * m * n_bins
            out.append(np.moveaxis(got[start:start + size].reshape(n_out + 1, len(o), m, n_bins), 0, -1))
            start += size
        return out

    def grow(self) -> None:
        """One more tree for every ensemble."""
        if len(self.done[0]) - self.folded >= (2 * REFRESH if self.summed else REFRESH):
            self.refresh()
        size = 2 ** (self.depth + 1) - 1
        new = [Tree(np.full(size, -1), np.zeros(size, dtype=int), np.zeros((size, self.n_out))) for _ in self.specs]
        open_ = [np.array([0]) for _ in self.specs]
        sums: list[dict] = [{} for _ in self.specs]  # of the nodes of the level above, where siblings are derived
        for level in range(self.depth):
            cell = self.m * self.n_bins * (self.n_out + 1)
            todo = [i for i in range(len(self.specs)) if len(open_[i])]
            while todo:
                which, held = [], 0
                while todo and (not which or held + len(open_[todo[0]]) * cell <= _FLUSH_CELLS):
                    held += len(open_[todo[0]]) * cell
                    which.append(todo.pop(0))
                draws = [np.random.default_rng([self.specs[i].seed, len(self.done[i]), level]) for i in which]
                picks = [np.stack([r.permutation(self.d)[:self.m] if self.m < self.d else np.arange(self.d)
                                   for _ in open_[i]]) for i, r in zip(which, draws)]
                asked = [self._asked(new[i], open_[i], sums[i]) for i in which]
                hists = self._histograms(which, [new[i] for i in which], asked, picks, level)
                for k, i in enumerate(which):
                    hist = self._all_sums(open_[i], asked[k], hists[k], sums[i])
                    nodes = open_[i]
                    open_[i] = self._split(new[i], hist, nodes, picks[k], self.specs[i], draws[k])
                    sums[i] = dict(zip(nodes.tolist(), hist, strict=True)) if self.subtract else {}
        for i, tree in enumerate(new):
            self.done[i].append(tree)

    @staticmethod
    def _asked(tree: Tree, nodes: np.ndarray, above: dict) -> np.ndarray:
        """The nodes whose sums are read from the rows: of two open siblings the smaller one, an only one itself."""
        if not above:
            return nodes
        there, out = set(nodes.tolist()), []
        for left in sorted({k if k % 2 else k - 1 for k in there}):
            if left in there and left + 1 in there:
                count = above[(left - 1) // 2][tree.feature[(left - 1) // 2], :, -1]
                out.append(left if 2 * count[:tree.cut[(left - 1) // 2] + 1].sum() <= count.sum() else left + 1)
            else:
                out.append(left if left in there else left + 1)
        return np.array(out)

    def _all_sums(self, nodes: np.ndarray, asked: np.ndarray, hists: np.ndarray, above: dict) -> np.ndarray:
        """Sums of all open nodes, in their order."""
        if not above:
            return hists
        known = dict(zip(asked.tolist(), hists, strict=True))
        return np.stack([known[k] if k in known else above[(k - 1) // 2] - known[k + 1 if k % 2 else k - 1]
                         for k in nodes.tolist()])

    def _split(self, tree: Tree, hist: np.ndarray, nodes: np.ndarray, picks: np.ndarray, spec: Spec, rng) -> np.ndarray:
        """Split the open nodes of one level in place; returns the nodes to try on the next."""
        left = hist.cumsum(axis=2)  # node, feature, bin, channel
        whole = left[:, :, -1:, :]
        right = whole - left

        def score(s):
            return (_soft(s[..., :-1], spec.l1) ** 2).sum(-1) / np.maximum(s[..., -1] + spec.l2, 1e-12)

        def value(s):
            return -_soft(s[..., :-1], spec.l1) / np.maximum(s[..., -1:] + spec.l2, 1e-12)

        gain = score(left) + score(right) - score(whole)
        gain[(left[..., -1] < self.min_child) | (right[..., -1] < self.min_child)] = -np.inf
        if self.random_cut:
            edges = np.stack([np.pad(e, (0, self.n_bins - 1 - len(e)), constant_values=np.inf) for e in self.edges])[picks]
            count = np.array([len(e) for e in self.edges])[picks]
            filled = hist[..., -1] > 0
            first = filled.argmax(2)
            last = self.n_bins - 1 - filled[..., ::-1].argmax(2)
            at = lambda i: np.take_along_axis(edges, i[..., None], axis=2)[..., 0]
            lo, hi = at(np.minimum(first, count - 1)), at(np.maximum(np.minimum(last, count) - 1, 0))
            wanted = lo + rng.random(lo.shape) * (hi - lo)
            cut = np.clip((edges < wanted[..., None]).sum(2), first, np.maximum(last - 1, first))
            drawn = np.arange(self.n_bins)[None, None] == cut[..., None]
            gain = np.where(drawn & (last > first)[..., None], gain, -np.inf)
        if nodes[0] == 0:
            tree.value[0] = value(whole[0, 0, 0])
        flat = gain.reshape(len(nodes), -1)
        best = flat.argmax(1)
        following = []
        for k in np.nonzero(flat[np.arange(len(nodes)), best] > 1e-12)[0]:
            j, cut = divmod(int(best[k]), self.n_bins)
            node = nodes[k]
            tree.feature[node], tree.cut[node] = picks[k, j], cut
            for child, s in ((2 * node + 1, left[k, j, cut]), (2 * node + 2, right[k, j, cut])):
                tree.value[child] = value(s)
                pure = self.loss == "classes" and np.abs(s[:-1]).max() >= s[-1]
                if s[-1] >= 2 * self.min_child and not pure:
                    following.append(child)
        return np.array(following, dtype=int)

    def refresh(self) -> None:
        """Write the margins, so that later passes evaluate recent trees only; the former table goes."""
        margin, n, spark = self._margins(), len(self.specs), self.rows.sparkSession

        def refreshed(batches):
            for chunk in _chunks(batches):
                yield _Chunk.record(chunk.bins, chunk.y, chunk.fold, chunk.n, chunk.rest, np.stack([margin(chunk, i) for i in range(n)]))

        path, former = new_path(spark, "margins"), self.path
        plain = {"compression": "none", "parquet.enable.dictionary": "false"}
        map_batches(self.rows, refreshed, CHUNK).write.options(**plain).parquet(path)
        self.rows, self.path, self.folded = spark.read.schema(CHUNK).parquet(path), path, len(self.done[0])
        self.tasks = self.rows.rdd.getNumPartitions()
        if former:
            drop_path(spark, former)

    def close(self) -> None:
        """Drops the written margins."""
        if self.path:
            drop_path(self.rows.sparkSession, self.path)

    def held_loss(self) -> list[float]:
        """Mean loss of every ensemble on its held-out fold: one pass."""
        margin, specs, loss = self._margins(), self.specs, self.loss

        def sums(batches):
            total = np.zeros((len(specs), 2))
            for chunk in _chunks(batches):
                for i, spec in enumerate(specs):
                    mine = chunk.fold == spec.fold
                    if spec.fold >= 0 and mine.any():
                        f = margin(chunk, i)[mine]
                        t = chunk.y[mine]
                        n = np.ones(len(t)) if chunk.n is None else chunk.n[mine]
                        rest = 0.0 if chunk.rest is None else chunk.rest[mine].sum()
                        each = (f - t) ** 2 if loss == "squared" else np.logaddexp(0, -(2 * t - 1) * f)
                        total[i] += ((each * n).sum() + rest, n.sum())
            yield total.ravel()

        got = total_array(self.rows, sums).reshape(-1, 2)
        return [float(a / n) if n else float("nan") for a, n in got]


class BoostResult(NamedTuple):
    fit: Ensemble
    best: float
    scores: dict


def _boost(df, vec, y, l1s, fold, loss, n_trees, depth, eta, l2, n_bins, base, classes=None) -> BoostResult:
    l1s = [float(a) for a in ([l1s] if isinstance(l1s, (int, float)) else l1s)]
    folds = classes_of(df, fold) if fold else []
    if len(l1s) > 1 and not folds:
        raise ValueError("a penalty grid needs a fold column")
    specs = [Spec(a, l2, f) for a in l1s for f in [-1, *(folds if len(l1s) > 1 else [])]]
    grower = _Grower(df, vec, y, fold, loss, specs, depth, n_bins, 1, eta, base, 1.0, None, False)
    for _ in range(n_trees):
        grower.grow()
    scores = {}
    if len(l1s) > 1:
        held = grower.held_loss()
        scores = {a: float(np.mean([v for s, v in zip(specs, held) if s.l1 == a and s.fold >= 0])) for a in l1s}
    grower.close()
    best = min(scores, key=scores.get) if scores else l1s[0]
    trees = grower.done[specs.index(Spec(best, l2, -1))]
    kind = "logistic" if loss == "logistic" else "sum"
    return BoostResult(Ensemble(grower.edges, trees, depth, base, eta, kind, classes), best, scores)


def boost_reg(df: DataFrame, vec: str, y: str, l1s: Sequence[float] = L1_GRID, fold: str | None = None,
              n_trees: int = 100, depth: int = 3, eta: float = 0.1, l2: float = 1.0, n_bins: int = 32,
              base: float | None = None) -> BoostResult:
    """Boosted regression trees with an L1 leaf penalty, leaf = -soft(G, l1) / (H + l2).

    Ensembles start from `base`, by default the mean of the target.

    The scores are held-out mean squared errors per penalty; all (penalty, fold) ensembles grow
    in the same passes.
    """
    if base is None:
        base = df.agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.0
    return _boost(df, vec, y, l1s, fold, "squared", n_trees, depth, eta, l2, n_bins, float(base))


def boost_clf(df: DataFrame, vec: str, y: str, fold: str | None = None, n_trees: int = 10, depth: int = 6,
              eta: float = 0.3, l2: float = 1.0, n_bins: int = 32) -> BoostResult:
    """Boosted trees with logistic loss for a 0/1 label."""
    return _boost(df, vec, y, 0.0, fold, "logistic", n_trees, depth, eta, l2, n_bins, 0.0, [0, 1])


def boost_folds(df: DataFrame, vec: str, y: str, fold: str, n_trees: int = 10, depth: int = 6, eta: float = 0.3,
                l2: float = 1.0, n_bins: int = 32, own_rows: bool = False) -> dict[int, Ensemble]:
    """One logistic ensemble per fold, all folds growing in the same passes.

    The rows of a fold are left out of its ensemble; with `own_rows` the column instead says
    which ensemble a row trains (see resample.smote_folds).
    """
    folds = classes_of(df, fold)
    specs = [Spec(0.0, l2, f, 0, own_rows) for f in folds]
    grower = _Grower(df, vec, y, fold, "logistic", specs, depth, n_bins, 1, eta, 0.0, 1.0, None, False)
    for _ in range(n_trees):
        grower.grow()
    grower.close()
    return {f: Ensemble(grower.edges, t, depth, 0.0, eta, "logistic", [0, 1]) for f, t in zip(folds, grower.done)}


def extra_trees_clf(df: DataFrame, vec: str, y: str, n_trees: int = 10, depth: int = 8, n_bins: int = 64,
                    features: int | None = None, seed: int = 0) -> Ensemble:
    """Extremely randomised trees (Geurts et al., 2006): one random cut per (node, candidate feature).

    Ten trees are the default of scikit-learn before release 0.22.
    """
    classes = classes_of(df, y)
    coded = df.withColumn("__y", F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(y)) - 1)
    d = df.select(F.size(vec)).first()[0]
    specs = [Spec(0.0, 0.0, -1, seed * 1_000_003 + i) for i in range(n_trees)]
    grower = _Grower(coded, vec, "__y", None, "classes", specs, depth, n_bins, len(classes), 1.0, 0.0, 1.0,
                     features or max(1, int(np.sqrt(d))), True)
    grower.grow()
    return Ensemble(grower.edges, [t[0] for t in grower.done], depth, 0.0, 1.0, "vote", classes)


def extra_trees_reg(df: DataFrame, vec: str, y: str, n_trees: int = 10, depth: int = 8, n_bins: int = 64,
                    features: int | None = None, seed: int = 0) -> Ensemble:
    """Extremely randomised regression trees with variance gain."""
    specs = [Spec(0.0, 0.0, -1, seed * 1_000_003 + i) for i in range(n_trees)]
    grower = _Grower(df, vec, y, None, "squared", specs, depth, n_bins, 1, 1.0, 0.0, 1.0, features, True)
    grower.grow()
    return Ensemble(grower.edges, [t[0] for t in grower.done], depth, 0.0, 1.0, "mean")


def _vectors(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("__features", array_to_vector(F.col(vec).cast("array<double>")))


class BuiltIn(NamedTuple):
    """A fitted Spark tree model; labels are class values for classifiers."""

    model: object
    classes: list | None

    def transform(self, df: DataFrame, vec: str, out: str = "prediction", score: str | None = None) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        raw = self.model.transform(_vectors(df, vec))
        keep = [F.col(c) for c in df.columns]
        value = F.col("__p")
        if self.classes is not None:
            value = F.element_at(F.array(*[F.lit(c) for c in self.classes]), (F.col("__p") + 1).cast("int"))
        if score:
            keep.append(F.element_at(vector_to_array("__probability"), -1).alias(score))
        return raw.select(*keep, value.alias(out))


def _classifier(est, df, vec, y, weight=None) -> BuiltIn:
    classes = classes_of(df, y)
    coded = _vectors(df, vec).withColumn(
        "__y", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(y)) - 1).cast("double"))
    est = est.setFeaturesCol("__features").setLabelCol("__y").setPredictionCol("__p")
    est = est.setProbabilityCol("__probability").setRawPredictionCol("__raw")
    return BuiltIn((est.setWeightCol(weight) if weight else est).fit(coded), classes)


def rf_clf(df: DataFrame, vec: str, y: str, weight: str | None = None, n_trees: int = 10, depth: int = 10,
           seed: int = 0) -> BuiltIn:
    """Random forest classifier, optionally with row weights."""
    return _classifier(RandomForestClassifier(numTrees=n_trees, maxDepth=depth, seed=seed), df, vec, y, weight)


def gbt_clf(df: DataFrame, vec: str, y: str, n_trees: int = 100, depth: int = 3, eta: float = 0.1, seed: int = 0) -> BuiltIn:
    """Gradient-boosted classifier for two classes."""
    return _classifier(GBTClassifier(maxIter=n_trees, maxDepth=depth, stepSize=eta, seed=seed), df, vec, y)


def rf_reg(df: DataFrame, vec: str, y: str, n_trees: int = 10, depth: int = 10, seed: int = 0) -> BuiltIn:
    """Random forest regressor."""
    est = RandomForestRegressor(numTrees=n_trees, maxDepth=depth, seed=seed, featuresCol="__features", labelCol=y,
                                predictionCol="__p")
    return BuiltIn(est.fit(_vectors(df, vec)), None)


def gbt_reg(df: DataFrame, vec: str, y: str, n_trees: int = 100, depth: int = 3, eta: float = 0.1, seed: int = 0) -> BuiltIn:
    """Gradient-boosted regressor."""
    est = GBTRegressor(maxIter=n_trees, maxDepth=depth, stepSize=eta, seed=seed, featuresCol="__features", labelCol=y,
                       predictionCol="__p")
    return BuiltIn(est.fit(_vectors(df, vec)), None)
