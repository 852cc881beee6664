"""Positions, prefix sums, windows over long groups, folds and splits.

A plain window puts a whole group into one task, so it is used only behind a count of the
largest group. Beyond that, rows are range-partitioned by (group, order key), sorted inside
each partition and checkpointed once; a position is then the partition's offset plus the
index inside the partition, whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import TASK_ROWS, as_list, cut_lineage, largest_group, partitions_of
from .joins import lookup_join

_LOCAL_BITS = 33  # monotonically_increasing_id: partition number above, row index below


def _ranged(df: DataFrame, keys: list) -> DataFrame:
    """`df` sorted over range partitions, with the partition (`__slot`) and the index in it."""
    rows = (
        df.repartitionByRange(partitions_of(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__id", F.monotonically_increasing_id())
    )
    return (
        cut_lineage(rows)
        .withColumn("__slot", F.shiftright("__id", _LOCAL_BITS))
        .withColumn("__local", F.col("__id").bitwiseAND((1 << _LOCAL_BITS) - 1))
        .drop("__id")
    )


def _slot_offsets(rows: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Exclusive running totals of `cols` over the slots; one row per partition, so tiny."""
    totals = rows.groupBy("__slot").agg(*[c.alias(n) for n, c in cols.items()]).orderBy("__slot").collect()
    names = list(cols)
    schema = "__slot bigint, " + ", ".join(f"{n} {rows.select(c.alias(n)).schema[0].dataType.simpleString()}"
                                            for n, c in cols.items())
    running = [list(accumulate([r[n] for r in totals], initial=type(totals[0][n])(0))) if totals else []
               for n in names]
    data = [(r["__slot"], *[col[i] for col in running]) for i, r in enumerate(totals)]
    return F.broadcast(rows.sparkSession.createDataFrame(data, schema))


def with_position(df: DataFrame, order_by, partition_by=None, name: str = "pos",
                  max_rows: int = TASK_ROWS, longest: int | None = None) -> DataFrame:
    """0-based position of every row under a unique `order_by`, inside `partition_by`.

    `longest` is the size of the largest group, for a caller that has counted already.
    """
    order_by, groups = as_list(order_by), as_list(partition_by)
    if (largest_group(df, groups) if longest is None else longest) <= max_rows:
        window = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(*order_by)
        return df.withColumn(name, F.row_number().over(window).cast("long") - 1)
    rows = _ranged(df, groups + order_by)
    offsets = _slot_offsets(rows, {"__before": F.count(F.lit(1))})
    placed = rows.join(offsets, "__slot").withColumn("__global", F.col("__before") + F.col("__local"))
    if not groups:
        return placed.withColumn(name, F.col("__global")).drop("__slot", "__local", "__before", "__global")
    # First global position per (slot, group): at most slots + groups rows. Joining on both
    # keys keeps a hot group spread over all of its slots.
    firsts = placed.groupBy("__slot", *groups).agg(F.min("__global").alias("__first"))
    starts = firsts.join(firsts.groupBy(*groups).agg(F.min("__first").alias("__start")), groups)
    return (
        placed.join(starts.drop("__first"), ["__slot", *groups])
        .withColumn(name, F.col("__global") - F.col("__start"))
        .drop("__slot", "__local", "__before", "__global", "__start")
        .select(*df.columns, name)
    )


def prefix_sums(df: DataFrame, order_by, sums: dict[str, str], max_rows: int = TASK_ROWS) -> DataFrame:
    """Running totals (inclusive) of numeric columns over a unique global order.

    `sums` maps output name to input column. Nulls add nothing; the total before the first value is 0.
    """
    order_by = as_list(order_by)
    if largest_group(df, []) <= max_rows:
        window = Window.partitionBy(F.lit(0)).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.coalesce(F.sum(c).over(window), F.lit(0)).alias(o) for o, c in sums.items()])
    rows = _ranged(df, order_by)
    offsets = _slot_offsets(rows, {f"__{o}": F.coalesce(F.sum(c), F.lit(0)) for o, c in sums.items()})
    window = Window.partitionBy("__slot").orderBy("__local").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, "__slot").select(
        *df.columns, *[(F.coalesce(F.sum(c).over(window), F.lit(0)) + F.col(f"__{o}")).alias(o) for o, c in sums.items()]
    )


def windowed(df: DataFrame, order_by, partition_by=None, before: int = 0, after: int = 0,
             max_rows: int = TASK_ROWS) -> tuple[DataFrame, WindowSpec, Callable[[DataFrame], DataFrame]]:
    """A frame, a window over it and a finisher, for row frames reaching `before` / `after` rows.

    Groups up to `max_rows` use an ordinary window. Longer groups are cut by position into
    chunks of `max_rows`; each chunk also receives the neighbouring rows its frames reach, and
    the finisher keeps the rows a chunk owns.
    """
    order_by, groups = as_list(order_by), as_list(partition_by)
    longest = largest_group(df, groups)
    if longest <= max_rows:
        return df, Window.partitionBy(*(groups or [F.lit(0)])).orderBy(*order_by), lambda out: out
    placed = with_position(df, order_by, groups, "__pos", max_rows, longest)
    size = F.lit(max_rows).cast("long")
    chunk_of = lambda c: F.floor(c / size).cast("long")
    reach = F.sequence(chunk_of(F.greatest(F.col("__pos") - after, F.lit(0))), chunk_of(F.col("__pos") + before))
    cut = placed.withColumn("__chunk", F.explode(reach))
    window = Window.partitionBy(*groups, "__chunk").orderBy("__pos")

    def finish(out: DataFrame) -> DataFrame:
        return out.filter(F.col("__chunk") == chunk_of(F.col("__pos"))).drop("__pos", "__chunk")

    return cut, window, finish


def rows_at(df: DataFrame, order_by, positions: list[int]) -> DataFrame:
    """One row, one column `edges`: the order keys (structs) at the given 0-based positions of the whole frame, ascending.

    Only the keys are sorted, over range partitions; counts per partition lead to the positions. A position given twice
    has its key twice. The result is stored, so that it is found once.
    """
    order_by = as_list(order_by)
    rows = _ranged(df.select(*order_by), order_by)
    sizes = sorted((r["__slot"], r["count"]) for r in rows.groupBy("__slot").count().collect())
    times, before = F.lit(0), 0
    for slot, n in sizes:
        for at in sorted({p for p in positions if before <= p < before + n}):
            here = (F.col("__slot") == slot) & (F.col("__local") == at - before)
            times = F.when(here, F.lit(positions.count(at))).otherwise(times)
        before += n
    key = F.explode(F.array_repeat(F.struct(*order_by), "__times")).alias("edge")
    return cut_lineage(rows.withColumn("__times", times).filter("__times > 0").select(key).agg(
        F.array_sort(F.collect_list("edge")).alias("edges")))


def _edges_below(df: DataFrame, order_by, positions: list[int]) -> Column:
    """How many of the keys at `positions` are at or before a row's own key, as a projection."""
    key, edges = F.struct(*as_list(order_by)), rows_at(df, order_by, positions).scalar()
    below = [F.when(F.get(edges, F.lit(i)) <= key, 1).otherwise(0) for i in range(len(positions))]
    return reduce(Column.__add__, below)


def positional_split(df: DataFrame, order_by, n: int | None = None, frac: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Head (first `n` rows, or first `frac` of them) and the rest: disjoint and complete.

    `order_by` are columns whose values together are unique, ascending. Both parts are filters of `df` by the key of the
    first row of the rest.
    """
    if (n is None) == (frac is None):
        raise ValueError("give exactly one of n and frac")
    size = df.count()
    n = int(size * frac) if n is None else n
    if not 0 < n < size:
        return df.filter(F.lit(n > 0)), df.filter(F.lit(n <= 0))
    after = _edges_below(df, order_by, [n])
    return df.filter(after == 0), df.filter(after == 1)


def contiguous_folds(df: DataFrame, order_by, k: int, name: str = "fold") -> DataFrame:
    """Fold number 0..k-1 over contiguous blocks whose bounds are int(n / k * i).

    `order_by` are columns whose values together are unique, ascending. Only they are sorted, to find the k - 1 bounds; the
    rows get their fold by comparison with these.
    """
    n = df.count()
    if n == 0 or k == 1:
        return df.withColumn(name, F.lit(0))
    return df.withColumn(name, _edges_below(df, order_by, [i * n // k for i in range(1, k)]))


def complement(df: DataFrame, fold: str, held: int) -> DataFrame:
    """The rows outside one fold: what is trained on while that fold is held out. Rows without a fold stay."""
    return df.filter(~F.col(fold).eqNullSafe(F.lit(held)))


def hash_split(df: DataFrame, key: str, test_share: float, seed: int | Column, name: str = "is_test") -> DataFrame:
    """Seeded split by the hash of a key: the same rows whatever the partitioning."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), (F.lit(seed) if isinstance(seed, int) else seed).cast("string")))
    bound = int(test_share * 16 ** 8)
    if not 0 < bound < 16 ** 8:
        return df.withColumn(name, F.lit(int(bound > 0)))
    # eight lower-case hex digits are ordered as their number
    return df.withColumn(name, (F.substring(digest, 1, 8) < F.lit(f"{bound:08x}")).cast("int"))


def extend_history(train: DataFrame, test: DataFrame, lookback: int, order_by, partition_by=None) -> DataFrame:
    """The test rows of every series preceded by the `lookback` rows before them."""
    order_by, groups = as_list(order_by), as_list(partition_by)
    both = train.withColumn("is_test", F.lit(0)).unionByName(test.withColumn("is_test", F.lit(1)))
    placed = with_position(both, order_by, groups, "__at")
    counts = [F.count(F.lit(1)).alias("__n"), F.sum("is_test").alias("__t")]
    if groups:
        sized = lookup_join(placed, both.groupBy(*groups).agg(*counts), groups)
    else:
        total = both.agg(*counts).first()
        sized = placed.withColumns({"__n": F.lit(total["__n"]), "__t": F.lit(total["__t"] or 0)})
    return sized.filter(F.col("__at") >= F.col("__n") - F.col("__t") - lookback).drop("__at", "__n", "__t")
