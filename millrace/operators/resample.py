"""Synthetic minority rows and repeated runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import TASK_ROWS
from .neighbours import knn_join
from .order import hash_split, with_position
from .stats import classes_of, label_counts

COPIES = 10_000  # copies of one row made in one place; more are dealt to several tasks


def smote(df: DataFrame, key: str, vec: str, label: str, k: int = 5, seed: int = 0,
          max_rows: int = TASK_ROWS, **knn) -> DataFrame:
    """(key, vec, label, synthetic): the rows plus new minority rows up to the largest class.

    Every row of a class needing m more rows from n yields m // n of them, and the first m mod n
    rows one more. A new row lies between its base and one of the base's k neighbours of the same
    class; neighbour and gap come from the hash of (key, copy, seed). A class of one row is copied.
    """
    counts = label_counts(df, label)
    most = max(counts.values(), default=0)
    short = {c: (n, most - n) for c, n in counts.items() if n < most}
    return _resampled(df.select(key, vec, label), key, vec, label, short, k, seed, max_rows, knn)


def smote_folds(df: DataFrame, key: str, vec: str, label: str, fold: str, k: int = 5, seed: int = 0,
                out: str = "trains", max_rows: int = TASK_ROWS, **knn) -> DataFrame:
    """(key, vec, label, synthetic, trains): per fold, the resampled rows outside it.

    Resampling happens inside each training part, so no synthetic row is made from a held-out one. All parts are made in
    one plan: a row stands once in the part of every other fold, and a part's classes are groups of one k-NN join.
    """
    folds = classes_of(df, fold)
    other = F.filter(F.array(*[F.lit(f).cast("int") for f in folds]), lambda f: f != F.col(fold))
    rows = df.select(key, vec, label, F.explode(other).alias(out)).withColumn(
        "__group", F.to_json(F.struct(F.col(out).alias("p"), F.col(label).alias("c"))))
    counts = rows.filter(F.col(label).isNotNull()).groupBy(out, "__group").agg(F.count(F.lit(1)).alias("n")).collect()
    most: dict = {}
    for r in counts:
        most[r[out]] = max(most.get(r[out], 0), r["n"])
    short = {r["__group"]: (r["n"], most[r[out]] - r["n"]) for r in counts if r["n"] < most[r[out]]}
    return _resampled(rows, key, vec, "__group", short, k, seed, max_rows, knn).select(key, vec, label, "synthetic", out)


def _resampled(df: DataFrame, key: str, vec: str, group: str, short: dict, k: int, seed: int, max_rows: int,
               knn: dict) -> DataFrame:
    """`df` and the new rows of its groups in `short` ({group: (rows, rows to make)}); a key is unique in a group."""
    real = df.withColumn("synthetic", F.lit(0))
    if not short:
        return real
    lookup = lambda i: F.element_at(F.create_map(
        *[F.lit(x) for c, v in short.items() for x in (c, v[i])]), F.col(group))
    minority = df.filter(F.col(group).isin(list(short)))
    placed = with_position(minority, key, group, "__at", max_rows)
    size, need = lookup(0), lookup(1)
    copies = F.floor(need / size) + F.when(F.col("__at") < need % size, 1).otherwise(0)
    hashed = lambda what: F.pmod(F.xxhash64(key, "__copy", F.lit(what), F.lit(seed)), F.lit(2 ** 31))
    # A group of n rows offers min(k, n - 1) neighbours.
    reach = F.greatest(F.least(F.lit(k), size - 1), F.lit(1))
    drawn = (placed.withColumn("__copies", copies.cast("int")).filter(F.col("__copies") > 0)
             .withColumn("__from", F.explode(F.sequence(F.lit(1), F.col("__copies"), F.lit(COPIES))))
             .repartition(key, "__from")
             .withColumn("__copy", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + COPIES - 1, "__copies"))))
             .withColumn("rank", (F.pmod(hashed("which"), reach) + 1).cast("int"))
             .withColumn("__gap", hashed("gap") / F.lit(float(2 ** 31)))
             .drop("__at", "__copies", "__from"))
    near = knn_join(minority, minority, k, vec, key, by=group, exclude_same=key, carry=[vec], keep_by=True, **knn).select(
        key, group, "rank", F.col(vec).alias("__to"))
    between = F.when(F.col("__to").isNull(), F.col(vec)).otherwise(
        F.zip_with(vec, "__to", lambda a, b: a + F.col("__gap") * (b - a)))
    made = drawn.join(near, [key, group, "rank"], "left").select(
        *[between.alias(c) if c == vec else F.col(c) for c in df.columns], F.lit(1).alias("synthetic"))
    return real.unionByName(made)


def repeat(fn: Callable[[int], DataFrame], seeds: Iterable[int], name: str = "run") -> DataFrame:
    """The rows of fn(seed) for every seed, tagged with the run number."""
    runs = [fn(seed).withColumn(name, F.lit(i)) for i, seed in enumerate(seeds)]
    return reduce(DataFrame.unionByName, runs)


def repeat_splits(df: DataFrame, key: str, test_share: float, seeds: Iterable[int], run: str = "run",
                  name: str = "is_test") -> DataFrame:
    """Every row once per seed, with the run number and its side of that run's split: one scan for all runs."""
    seeds = list(seeds)
    rows = df.select("*", F.posexplode(F.array(*[F.lit(s) for s in seeds])).alias(run, "__seed"))
    return hash_split(rows, key, test_share, F.col("__seed"), name).drop("__seed")
