"""Counts, means and centred cross products of array columns: one scan, tree-merged.

Every least-squares fit here is solved from these d x d sums, so a whole grid of penalties and
folds costs one pass over the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import as_list, partitions_of
from .batches import Batch, map_batches

_FLUSH_CELLS = 16_000_000  # doubles kept per task before partial sums are passed on
_FAN_IN = 64  # partial records of one key that a task merges
BLOCK_CELLS = 125_000  # doubles of one record: a megabyte
_DRIVER_CELLS = 1_000_000  # doubles that the driver receives to add them up itself


def tree_merge(partials: DataFrame, by: list, merge: Callable[[pd.DataFrame], pd.DataFrame], tasks: int) -> DataFrame:
    """Merge the partial rows that `tasks` tasks made per key: rounds of _FAN_IN tasks' rows each, so no task receives
    the rows of all."""
    keys = [F.col(c) for c in by]
    schema = partials.schema
    while tasks > _FAN_IN:
        tagged = partials if "__task" in partials.columns else partials.withColumn("__task", F.spark_partition_id())
        tagged = tagged.withColumn("__task", F.floor(F.col("__task") / _FAN_IN).cast("int"))

        def one(part: pd.DataFrame) -> pd.DataFrame:
            return merge(part.drop(columns="__task")).assign(__task=part["__task"].iloc[0])

        partials = tagged.groupBy(*keys, "__task").applyInPandas(one, tagged.schema)
        tasks = -(-tasks // _FAN_IN)
    partials = partials.drop("__task")
    return partials.groupBy(*keys).applyInPandas(merge, schema)


def combine(a: tuple | None, b: tuple, first: int = 0) -> tuple:
    """Pairwise update of (n, mean, centred products), stable for large means (Chan et al., 1983).

    The products may be some rows of the matrix only, from row `first` on.
    """
    if a is None or a[0] == 0:
        return b
    if b[0] == 0:
        return a
    n = a[0] + b[0]
    d = b[1] - a[1]
    own = d[first:first + len(b[2])]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(own, d) * (a[0] * b[0] / n)


def of_rows(x: np.ndarray) -> tuple:
    mean = x.mean(0)
    c = x - mean
    return len(x), mean, c.T @ c


def _moment_blocks(df: DataFrame, vec: str, keys: list) -> DataFrame:
    """(keys.., block, n, mean, m2): `m2` holds as many rows of the centred products as fit in BLOCK_CELLS."""
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("block", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())),
                           T.StructField("m2", T.ArrayType(T.DoubleType()))])

    def frame(sums: dict) -> pd.DataFrame:
        rows = [(*k, i, int(n), m, s[lo:lo + _rows_of(len(m))].ravel()) for k, (n, m, s) in sums.items()
                for i, lo in enumerate(range(0, len(m), _rows_of(len(m))))]
        return pd.DataFrame(rows, columns=schema.names)

    def partial(batches: Iterable[Batch]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            x = batch[vec]
            for key, rows in batch.groups(keys):
                sums[key] = combine(sums.get(key), of_rows(x[rows]))
            if len(sums) * x.shape[1] ** 2 > _FLUSH_CELLS:
                yield frame(sums)
                sums = {}
        if sums:
            yield frame(sums)

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        total, block = None, int(part["block"].iloc[0])
        for n, m, s in zip(part["n"], part["mean"], part["m2"]):
            m = np.asarray(m)
            total = combine(total, (n, m, np.asarray(s).reshape(-1, len(m))), block * _rows_of(len(m)))
        head = {k: [part[k].iloc[0]] for k in [*keys, "block"]}
        return pd.DataFrame({**head, "n": [int(total[0])], "mean": [total[1]], "m2": [total[2].ravel()]})

    rows = df.select(*keys, F.col(vec).cast("array<double>").alias(vec)).filter(F.col(vec).isNotNull())
    # The rows may come from a plan that has not run: its tasks are taken to be the session's usual number.
    return tree_merge(map_batches(rows, partial, schema), [*keys, "block"], merge, partitions_of(df.sparkSession))


def _rows_of(d: int) -> int:
    """Rows of a d x d matrix in one record."""
    return max(1, BLOCK_CELLS // max(d, 1))


def moments(df: DataFrame, vec: str, by=None) -> DataFrame:
    """(by.., n, mean array, m2 flattened array) over the non-null arrays of `vec`, for the many keys of narrow arrays.

    An array too wide for one record has several rows a key: use `collect_moments` for these.
    """
    return _moment_blocks(df, vec, as_list(by)).drop("block")


def collect_moments(df: DataFrame, vec: str, by: str | None = None) -> dict:
    """{key: (n, mean, m2)} for a handful of keys such as folds; {None: ..} without keys."""
    found: dict = {}
    for r in _moment_blocks(df, vec, as_list(by)).collect():
        found.setdefault(r[by] if by else None, []).append(r)
    out = {}
    for key, rows in found.items():
        flat = np.concatenate([np.array(r["m2"]) for r in sorted(rows, key=lambda r: r["block"])])
        out[key] = (rows[0]["n"], np.array(rows[0]["mean"]), flat.reshape(-1, len(rows[0]["mean"])))
    return out


def merged(parts) -> tuple | None:
    total = None
    for p in parts:
        total = combine(total, p)
    return total


def total_array(rows: DataFrame, fn: Callable[[Iterable[Batch]], Iterator[np.ndarray]],
                tasks: int | None = None, width: int | None = None) -> np.ndarray:
    """Element-wise sum of the vectors that `fn` yields from the batches of each task; all have the same length.

    A vector travels in records of BLOCK_CELLS, which Spark sums in rounds of _FAN_IN; the driver receives the total,
    record by record, and nothing per task. Only where at most _FAN_IN tasks have vectors of one record, and these together
    _DRIVER_CELLS, the driver adds them up: a pass is one stage then. Hand in checkpointed rows; `tasks` is their number of partitions and `width`
    the length of a vector, for callers of many passes.
    """
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def records(batches: Iterable[Batch]) -> Iterator[pd.DataFrame]:
        for vector in fn(batches):
            for part, lo in enumerate(range(0, len(vector), BLOCK_CELLS)):
                yield pd.DataFrame({"part": [part], "sums": [vector[lo:lo + BLOCK_CELLS]]})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        total = np.array(part["sums"].iloc[0], float)
        for more in part["sums"].iloc[1:]:
            total += more
        return pd.DataFrame({"part": [part["part"].iloc[0]], "sums": [total]})

    tasks = rows.rdd.getNumPartitions() if tasks is None else tasks
    if width and tasks <= _FAN_IN and width <= BLOCK_CELLS and tasks * width <= _DRIVER_CELLS:
        def whole(batches: Iterable[Batch]) -> Iterator[pd.DataFrame]:
            total = np.zeros(width)
            for vector in fn(batches):
                total += vector
            yield pd.DataFrame({"part": [0], "sums": [total]})

        found = map_batches(rows, whole, schema).toArrow().column("sums")
        return sum((v.values.to_numpy() for v in found), np.zeros(width))
    done = tree_merge(map_batches(rows, records, schema), ["part"], merge, tasks).toArrow()
    order = np.argsort(done.column("part").to_numpy())
    parts = done.column("sums")
    return np.concatenate([parts[int(k)].values.to_numpy() for k in order]) if len(order) else np.zeros(0)
