"""Streaming forms of the daily post figures and of the smoothing filter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.forecast import KALMAN_JUMP, KALMAN_Q, KALMAN_R, _filter
from ..session import as_list


def daily_posts(stream: DataFrame, ts: str, is_positive: Column, is_tagged: Column, late: str = "1 day") -> DataFrame:
    """(day, n, score) per closed day: post volume and (positive - negative) share of tagged posts.

    Rows later than `late` behind the newest one are dropped by the watermark, and a day is
    emitted once, when the watermark passes its end. The time column is cast first, because a
    watermark needs a timestamp with a zone.
    """
    timed = stream.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late)
    days = timed.groupBy(F.window("__at", "1 day").alias("__w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(is_tagged, F.when(is_positive, 1.0).otherwise(-1.0))).alias("score"))
    return days.select(F.date_format("__w.start", "yyyyMMdd").cast("int").alias("day"), "n", "score")


def kalman_stream(stream: DataFrame, value: str, order_by: str, partition_by, q: float = KALMAN_Q,
                  r: float = KALMAN_R, jump: float = KALMAN_JUMP) -> DataFrame:
    """(key.., order, value, smooth): the filter with its two numbers of state kept per series."""
    keys = as_list(partition_by)
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    cols = [*keys, order_by, value]
    schema = ", ".join(f"{c} {fields[c]}" for c in cols) + ", smooth double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x, p = state.get if state.exists else (0.0, 1.0)
        rows = pd.concat(list(batches)).sort_values(order_by, kind="stable")
        done, x, p = _filter(rows[value].to_numpy(dtype=float), x, p, q, r, jump)
        state.update((float(x), float(p)))
        yield rows[cols].assign(smooth=done)

    return stream.select(*cols).groupBy(*keys).applyInPandasWithState(
        step, schema, "x double, p double", "append", GroupStateTimeout.NoTimeout)
