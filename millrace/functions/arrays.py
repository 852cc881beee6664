"""Column expressions over arrays and label tuples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of red, green and blue in a grayscale value.
GRAY_WEIGHTS = (0.2989, 0.5870, 0.1140)


def let(value: Column, fn) -> Column:
    """fn(value) with `value` computed once per row, however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def argmax(arr: Column) -> Column:
    """0-based index of the first largest element."""
    return let(arr, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def hamming_distance(a: Column, b: Column) -> Column:
    """Number of positions that differ; unequal lengths raise."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), differ).otherwise(F.raise_error(F.lit("sequences differ in length")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def plane(arr: Column, number: int, size: int) -> Column:
    """Plane `number` of a planar array."""
    return F.slice(arr, number * size + 1, size)


def gray(r: Column, g: Column, b: Column) -> Column:
    wr, wg, wb = GRAY_WEIGHTS
    return wr * r + wg * g + wb * b
