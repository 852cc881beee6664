"""Lookup joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, TASK_ROWS, as_list, fits


def lookup_join(facts: DataFrame, dim: DataFrame, on, how: str = "inner",
                max_rows: int = BROADCAST_ROWS, hot_rows: int = TASK_ROWS) -> DataFrame:
    """Join a fact table to a keyed table.

    A `dim` of at most `max_rows` rows is broadcast. Above that both sides are shuffled, with
    every key of more than `hot_rows` facts spread over several salts; `dim` rows of such a key
    are repeated once per salt. Hot keys number at most facts / hot_rows, so their table is
    broadcast only when it passes the same check.
    """
    on = as_list(on)
    if fits(dim, max_rows):
        return facts.join(F.broadcast(dim), on, how)
    hot = (
        facts.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)
        .select(*on, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__salts"))
    )
    if fits(hot, max_rows):
        hot = F.broadcast(hot)
    salts = F.coalesce("__salts", F.lit(1))
    spread = facts.join(hot, on, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(*facts.columns), salts).cast("int")).drop("__salts")
    copies = dim.join(hot, on, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return spread.join(copies, [*on, "__salt"], how).drop("__salt")


def on_trading_days(posts: DataFrame, prices: DataFrame, day: str = "day", **kw) -> DataFrame:
    """Posts whose day occurs in the price table."""
    return lookup_join(posts, prices.select(day).distinct(), day, "left_semi", **kw)


def first_per_day(prices: DataFrame, day: str, order_by) -> DataFrame:
    """One price row per day: the first under `order_by`."""
    others = [c for c in prices.columns if c != day]
    pick = F.min_by(F.struct(*others), F.struct(*as_list(order_by))).alias("__row")
    return prices.groupBy(day).agg(pick).select(day, "__row.*")


def attach_labels(posts: DataFrame, prices: DataFrame, order_by, day: str = "day", **kw) -> DataFrame:
    """Inner join of posts to the labels of their day; the first price row of a day under `order_by` wins."""
    return lookup_join(posts, first_per_day(prices, day, order_by), day, **kw)


def name_features(stats: DataFrame, names: DataFrame, index: str = "idx") -> DataFrame:
    """Attach feature names to rows keyed by column index."""
    return lookup_join(stats, names, index)


def top_per_key(df: DataFrame, key, order_by, k: int) -> DataFrame:
    """The first k rows per key. Spark keeps k rows per key before the shuffle as well."""
    window = Window.partitionBy(*as_list(key)).orderBy(*as_list(order_by))
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
