"""Arrow batches to numpy and back without touching single rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def matrix(col) -> np.ndarray:
    """Rows x width matrix of an array column: Arrow list, pandas series of arrays, or a matrix."""
    if isinstance(col, np.ndarray) and col.ndim == 2:
        return col
    if isinstance(col, (pa.Array, pa.ChunkedArray)):
        flat = col.flatten() if isinstance(col, pa.Array) else pa.concat_arrays([c.flatten() for c in col.chunks])
        return flat.to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=float) for v in col]) if len(col) else np.zeros((0, 0))


def list_column(values: np.ndarray) -> pa.ListArray:
    """A matrix as an Arrow list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


class Batch:
    """One Arrow batch; array columns come as matrices, the others as pandas series."""

    def __init__(self, rows: pa.RecordBatch):
        self._rows = rows

    def __len__(self) -> int:
        return self._rows.num_rows

    def __getitem__(self, name: str):
        col = self._rows.column(self._rows.schema.get_field_index(name))
        return matrix(col) if pa.types.is_list(col.type) else col.to_pandas()

    def lists(self, name: str) -> list:
        """An array column as Python lists, for values that make no matrix of numbers."""
        return self._rows.column(self._rows.schema.get_field_index(name)).to_pylist()

    def columns(self) -> list[pa.Array]:
        return self._rows.columns

    def names(self) -> list[str]:
        return self._rows.schema.names

    def groups(self, keys: list) -> list[tuple]:
        """(key tuple, row numbers) per distinct key; one group without keys."""
        if not keys:
            return [((), np.arange(len(self)))]
        frame = pd.DataFrame({k: self[k] for k in keys})
        codes = frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order])) + 1
        return [(tuple(frame.iloc[part[0]]), part) for part in np.split(order, cuts)]


# Bytes of an Arrow batch where rows hold whole blocks of vectors.
BATCH_BYTES = 32 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with its session's Arrow batches at most about BATCH_BYTES long; lower settings stay. Read when a query runs."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", conf.get(key).lower()).groups()
    if not 0 < int(number) << (10 * " kmgtp".index(unit or " ")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def map_batches(df: DataFrame, fn: Callable[[Iterable[Batch]], Iterator], schema: T.StructType) -> DataFrame:
    """mapInArrow over non-empty `Batch` objects; fn yields Arrow batches or small pandas frames."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for out in fn(Batch(b) for b in batches if b.num_rows):
            yield pa.RecordBatch.from_pandas(out, arrow, preserve_index=False) if isinstance(out, pd.DataFrame) else out

    return df.mapInArrow(run, schema)
