"""Planar pixel arrays: long pixel tables, grayscale, blocks, noise."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import gray, plane
from ..session import as_list

# The four levels noise may take, and the noisy positions per image.
NOISE_LEVELS = (0, 255, 96, 144)
NOISE_POSITIONS = 10


def check_planar(df: DataFrame, arr: str, length: int) -> DataFrame:
    """Fail on the first image whose array has another length."""
    ok = F.size(arr) == length
    return df.withColumn(arr, F.when(ok, F.col(arr)).otherwise(F.raise_error(F.lit("image array has a wrong length"))))


def pixels(df: DataFrame, key, arr: str, size: int) -> DataFrame:
    """(key.., pos, r, g, b): one row per pixel of arrays holding three planes of `size` values."""
    planes = [plane(F.col(arr), i, size).alias(n) for i, n in enumerate("rgb")]
    cells = df.select(*as_list(key), F.posexplode(F.arrays_zip(*planes)).alias("pos", "px"))
    return cells.select(*as_list(key), "pos", "px.r", "px.g", "px.b")


def grayscale(df: DataFrame, arr: str, size: int, out: str = "gray") -> DataFrame:
    """An array of `size` gray values per image."""
    rg = F.zip_with(plane(F.col(arr), 0, size), plane(F.col(arr), 1, size),
                    lambda r, g: F.struct(r.alias("r"), g.alias("g")))
    value = F.zip_with(rg, plane(F.col(arr), 2, size), lambda p, b: gray(p["r"], p["g"], b))
    return df.withColumn(out, value)


def scale_blocks(df: DataFrame, key, arr: str, factor: float, size: int) -> DataFrame:
    """(key.., block, values): the array divided by `factor`, cut into blocks of `size`."""
    scaled = F.transform(F.col(arr), lambda x: x / factor)
    starts = F.sequence(F.lit(0), F.ceil(F.size(arr) / size).cast("int") - 1)
    blocks = F.transform(starts, lambda b: F.struct(b.alias("block"), F.slice(scaled, b * size + 1, size).alias("values")))
    return df.select(*as_list(key), F.inline(blocks))


def inject_noise(df: DataFrame, key, arr: str, size: int, n: int = NOISE_POSITIONS, levels=NOISE_LEVELS,
                 seed: int = 0, out: str | None = None) -> DataFrame:
    """Give `n` positions per image a random level in all three planes.

    Position and level come from the md5 of (key, draw, what, seed), which other engines can repeat: the same noise on
    every run. Draws may repeat a position, as independent draws do; the first then counts.
    """
    name = [F.col(c).cast("string") for c in as_list(key)]
    draw = lambda i, what: F.conv(F.substring(F.md5(F.concat_ws(
        ":", *name, i.cast("string"), F.lit(what), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    draws = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        F.pmod(draw(i, "at"), F.lit(size)).cast("int").alias("at"),
        F.element_at(F.array(*[F.lit(x) for x in levels]), (F.pmod(draw(i, "lv"), F.lit(len(levels))) + 1).cast("int")).alias("level")))
    spots = F.map_from_entries(F.array_distinct(F.transform(F.col("__draws"), lambda d: F.struct(
        d["at"], F.filter("__draws", lambda e: e["at"] == d["at"])[0]["level"]))))
    noisy = F.transform(F.col(arr), lambda x, i: F.coalesce(
        F.try_element_at(F.col("__spots"), F.pmod(i, F.lit(size))).cast("double"), x.cast("double")))
    done = df.withColumn("__draws", draws).withColumn("__spots", spots)
    return done.withColumn(out or arr, noisy).drop("__draws", "__spots")


def patch_features(df: DataFrame, key, gray_arr: str, width: int, radius: int = 1, colours: str | None = None) -> DataFrame:
    """(key.., pos, patch): the gray values around every pixel, row by row, zero beyond the border.

    With `colours`, the column of planes, the pixel's r, g and b come along from the same row.
    """
    size = width * width
    offsets = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]

    def patch(arr, pos):
        y, x = F.floor(pos / width).cast("int"), pos % width
        cells = []
        for dy, dx in offsets:
            inside = (y + dy >= 0) & (y + dy < width) & (x + dx >= 0) & (x + dx < width)
            cells.append(F.when(inside, F.try_element_at(arr, pos + dy * width + dx + 1)).otherwise(F.lit(0.0)))
        return F.array(*cells)

    planes = [F.col(colours).alias("__c")] if colours else []
    spots = df.select(*as_list(key), F.col(gray_arr).alias("__g"), *planes,
                      F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("pos"))
    rgb = [F.get("__c", F.col("pos") + i * size).alias(n) for i, n in enumerate("rgb")] if colours else []
    return spots.select(*as_list(key), "pos", patch(F.col("__g"), F.col("pos")).alias("patch"), *rgb)


def colorize(df: DataFrame, key: str, arr: str, width: int, k: int = 4, radius: int = 1, seed: int = 1,
             test: str | None = None, max_iter: int = 200):
    """(key, pos, code, prediction): palette code of every pixel, predicted from its gray patch.

    Palette and classifier are fitted on the rows where `test` is 0 (all rows without it). The
    classifier is a multinomial logistic regression over the patch and its position. Patch and colour of a pixel come from
    its image's row, so no join is needed. A fit that `max_iter` steps did not end is told by a warning.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from ..session import cut_lineage
    from .cluster import palette

    size = width * width
    keys = [key] + ([test] if test else [])
    colours = palette(pixels(df.filter(F.col(test) == 0) if test else df, keys, arr, size), k, seed)
    grays = grayscale(df, arr, size, "__gray").withColumn("__gray", F.transform("__gray", lambda g: g / 255.0))
    patches = colours.codes(patch_features(grays, keys, "__gray", width, radius, arr)).drop(*"rgb")
    place = F.array((F.col("pos") % width) / float(width), F.floor(F.col("pos") / width) / float(width))
    rows = cut_lineage(patches.withColumn("__features", array_to_vector(F.concat("patch", place))))
    fit = LogisticRegression(featuresCol="__features", labelCol="code", predictionCol="prediction",
                             family="multinomial", maxIter=max_iter).fit(rows.filter(F.col(test) == 0) if test else rows)
    if fit.hasSummary and fit.summary.totalIterations >= max_iter:
        warnings.warn(f"the classifier still changed after {max_iter} steps", stacklevel=2)
    out = fit.transform(rows)
    return out.select(*keys, "pos", "code", F.col("prediction").cast("int").alias("prediction"))
