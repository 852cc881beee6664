"""Row-frame windows over one or many series: averages, lags, returns, lag vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import TASK_ROWS, as_list
from .joins import lookup_join
from .order import windowed


def moving_avg(df: DataFrame, value: str, n: int, order_by, partition_by=None, out: str = "ma",
               max_rows: int = TASK_ROWS) -> DataFrame:
    """Mean of the last n rows; null until n values exist."""
    rows, window, done = windowed(df, order_by, partition_by, before=n - 1, max_rows=max_rows)
    frame = window.rowsBetween(-(n - 1), 0)
    return done(rows.withColumn(out, F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))))


def rel_change(df: DataFrame, value: str, order_by, partition_by=None, lag: int = 1, out: str = "change",
               max_rows: int = TASK_ROWS) -> DataFrame:
    """(x - x[-lag]) / x[-lag]."""
    rows, window, done = windowed(df, order_by, partition_by, before=lag, max_rows=max_rows)
    old = F.lag(value, lag).over(window)
    return done(rows.withColumn(out, F.try_divide(F.col(value) - old, old)))


def vs_moving_avg(df: DataFrame, value: str, n: int, order_by, partition_by=None, out: str = "ratio",
                  max_rows: int = TASK_ROWS) -> DataFrame:
    """x over the mean of its last n rows."""
    averaged = moving_avg(df, value, n, order_by, partition_by, "__ma", max_rows)
    return averaged.withColumn(out, F.try_divide(F.col(value), F.col("__ma"))).drop("__ma")


def forward_return(df: DataFrame, value: str, horizons, order_by, partition_by=None, stem: str = "rt",
                   max_rows: int = TASK_ROWS) -> DataFrame:
    """Columns rt_h = (x[+h] - x) / x; null on the last h rows."""
    horizons = [horizons] if isinstance(horizons, int) else list(horizons)
    rows, window, done = windowed(df, order_by, partition_by, after=max(horizons), max_rows=max_rows)
    x = F.col(value)
    return done(rows.withColumns(
        {f"{stem}_{h}": F.try_divide(F.lead(value, h).over(window) - x, x) for h in horizons}))


def lag_windows(df: DataFrame, value: str, lookback: int, order_by, partition_by=None, out: str = "window",
                max_rows: int = TASK_ROWS) -> DataFrame:
    """The previous `lookback` values as an array beside each value; rows without a full one drop."""
    rows, window, done = windowed(df, order_by, partition_by, before=lookback, max_rows=max_rows)
    past = F.collect_list(value).over(window.rowsBetween(-lookback, -1))
    return done(rows.withColumn(out, past)).filter(F.size(out) == lookback)


def with_lags(df: DataFrame, value: str, lags, order_by, partition_by=None, stem: str = "lag",
              max_rows: int = TASK_ROWS) -> DataFrame:
    """Columns lag_k with the value k rows earlier."""
    lags = list(lags)
    rows, window, done = windowed(df, order_by, partition_by, before=max(lags), max_rows=max_rows)
    return done(rows.withColumns({f"{stem}_{k}": F.lag(value, k).over(window) for k in lags}))


def acf(df: DataFrame, value: str, max_lag: int, order_by, partition_by=None,
        max_rows: int = TASK_ROWS) -> DataFrame:
    """(partition.., n, lag, rho): sample autocorrelations, centred on the series mean.

    Lag products are plain grouped sums, combined on the map side, so a long series reaches the
    final aggregate as one row per task.
    """
    groups = as_list(partition_by)
    means = df.groupBy(*groups).agg(F.avg(value).alias("__mean"))
    if groups:
        centred = lookup_join(df, means, groups)
    else:
        centred = df.withColumn("__mean", F.lit(means.first()["__mean"]))
    centred = centred.withColumn("__x", F.col(value) - F.col("__mean"))
    lags = range(1, max_lag + 1)
    rows = with_lags(centred, "__x", lags, order_by, groups, "__lag", max_rows)
    sums = rows.groupBy(*groups).agg(
        F.count("__x").alias("n"), F.sum(F.col("__x") * F.col("__x")).alias("__c0"),
        *[F.coalesce(F.sum(F.col("__x") * F.col(f"__lag_{k}")), F.lit(0.0)).alias(f"__c{k}") for k in lags])
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"__c{k}"), F.col("__c0")).alias("rho"))
                      for k in lags])
    return sums.select(*groups, "n", F.inline(cells))
