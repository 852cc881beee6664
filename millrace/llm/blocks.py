"""Blocks of texts that ask shards about their distinct values.

Texts are read in blocks. A block sends what it wants to know, once per distinct value, to the shard of the value's hash,
beside records that carry the block itself. Equal values of all blocks meet in their shard, which answers; answers and
carried records come together again by block. A frequent value is one entry per block, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import release

NAMES = ["shard", "block", "seq", "data", "rows"]
# Bytes of text whose distinct values one shard takes.
SHARD_BYTES = 64_000_000
ASK = -1  # `seq` of a question; carried records count from 0


def shards_for(docs: DataFrame, text_col: str, shard_bytes: int = SHARD_BYTES) -> int:
    """The session's shuffle partitions, or as many shards as the text's bytes call for: one pass over the texts' lengths."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))


def parts_schema(row_type: T.DataType) -> T.StructType:
    kinds = [T.IntegerType(), T.LongType(), T.IntegerType(), T.ArrayType(T.BinaryType()), T.ArrayType(row_type)]
    return T.StructType([T.StructField(name, kind) for name, kind in zip(NAMES, kinds, strict=True)])


def record(shard: int, block: int, seq: int, data: Sequence[bytes], rows: pa.Array) -> pa.RecordBatch:
    """One record; `rows` are the kept rows that it carries."""
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([seq], pa.int32()),
         pa.array([list(data)], pa.list_(pa.binary())),
         pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], names=NAMES)


def shard_ranges(shard_of: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(shard, its places in ascending order) for every shard that occurs."""
    order = np.argsort(shard_of, kind="stable")
    there, first = np.unique(shard_of[order], return_index=True)
    return list(zip(there.tolist(), np.split(order, first[1:]), strict=True)) if len(order) else []


def answer(parts: DataFrame, make: Callable[[], Callable[[list[list[bytes]]], list[list[bytes]]]]) -> DataFrame:
    """Every question of a shard gets its answer as new data; carried records pass unchanged.

    `make()` runs once per worker and returns a function from the data of all of a shard's questions to the answers.
    """
    own: dict = {}

    def run(group: pa.Table) -> pa.Table:
        release()
        if "reply" not in own:
            own["reply"] = make()
        asks = group.filter(pc.equal(group.column("seq"), ASK))
        if not asks.num_rows:
            return group
        replies = pa.chunked_array([pa.array(own["reply"](asks.column("data").to_pylist()), pa.list_(pa.binary()))])
        place = group.schema.get_field_index("data")
        asks = asks.set_column(place, "data", replies.cast(group.schema.field("data").type))
        rest = group.filter(pc.greater_equal(group.column("seq"), 0))
        return pa.concat_tables([rest, asks.select(rest.column_names)])

    return parts.groupBy("shard").applyInArrow(run, parts.schema)


def together(parts: DataFrame, schema: T.StructType,
             fn: Callable[[list[list[bytes]], list[tuple[list[bytes], pa.Array]]], list[pa.RecordBatch]]) -> DataFrame:
    """Per block: `fn(answers, carried)`, where carried are (data, rows) in the order of `seq`."""
    def run(group: pa.Table) -> pa.Table:
        release()
        seqs, data = group.column("seq").to_pylist(), group.column("data")
        answers = [data[k].as_py() for k, seq in enumerate(seqs) if seq == ASK]
        carried = [(data[k].as_py(), group.column("rows")[k].values)
                   for k in sorted(range(len(seqs)), key=seqs.__getitem__) if seqs[k] != ASK]
        return pa.Table.from_batches(fn(answers, carried))

    return parts.groupBy("block").applyInArrow(run, schema)
