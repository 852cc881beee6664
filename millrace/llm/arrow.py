"""Arrow batches in, the kept columns and new ones out."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and bytes of an Arrow batch on its way to Python: they bound a worker's memory. One longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1024, 32 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, with its session's Arrow batches at most BATCH_ROWS rows and about BATCH_BYTES long; lower settings stay.

    The setting is read when a query runs, so it holds for the rest of the session. Zero and negative values mean no limit.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", conf.get(key).lower()).groups()
        if not 0 < int(number) << (10 * " kmgtp".index(unit or " ")) <= most:
            conf.set(key, str(most))
    return df


def release() -> None:
    """Hands memory that Python and Arrow no longer use back to the system; reused workers would sit on it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def kept_row(docs: DataFrame, keep: Sequence[str] | None) -> Column:
    """The kept columns as one struct, so that new columns cannot clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep))).alias("row")


def extend(docs: DataFrame, keep: Sequence[str] | None, inputs: Sequence[Column], fields: Sequence[T.StructField],
           make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """`row` (struct of the `keep` columns) and the new `fields`, one output row per input row.

    `make()` runs once per task and returns a function from a batch (column 0 is `row`, then `inputs`) to the new
    columns' Arrow arrays.
    """
    rows = bounded_batches(docs).select(kept_row(docs, keep), *inputs)
    schema = T.StructType([rows.schema["row"], *fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, batch = make(), None
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *fn(batch)], names=names)
        fn = batch = None
        release()

    return rows.mapInArrow(run, schema)


def flat_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string array and the offsets of its values, without a copy. Null has no bytes."""
    if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type):
        kind = np.int64
    else:
        kind = np.int32
    if len(strings) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, kind)[strings.offset:strings.offset + len(strings) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0]:at[-1]], at - at[0]
