"""Scans: delimited text, posts as JSON, word lists, image arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed schema of a post: the fields the analyses read.
POST_SCHEMA = (
    "id bigint, created_at string, sentiment struct<class: string>, "
    "links array<struct<description: string>>, body string"
)
IMAGE_SCHEMA = "labels int, data array<int>"


def read_delimited(spark: SparkSession, path, schema, na: str | None = None, header: bool = False,
                   preamble: int = 0, sep: str = ",") -> DataFrame:
    """Delimited text with a declared schema; the token `na` reads as null.

    `preamble` lines at the top of every file are skipped before the optional header. Only the
    split at the start of a file holds them (a split is megabytes, see `spark.sql.files.openCostInBytes`
    and `maxPartitionBytes`), so long files still read in parallel.
    """
    if not preamble:
        reader = spark.read.schema(schema).option("sep", sep).option("header", header)
        return (reader.option("nullValue", na) if na is not None else reader).csv(path)
    if isinstance(schema, T.StructType):
        schema = schema.toDDL()
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    skip = preamble + int(header)

    def below_header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for batch in batches:
            top = batch[batch["start"] == 0]
            at = top.groupby("file").cumcount() + top["file"].map(seen).fillna(0)
            yield batch.drop(index=at.index[at < skip])[["value"]]
            for file, n in top.groupby("file").size().items():
                seen[file] = seen.get(file, 0) + int(n)

    # Only the first split of a file passes through Python; all others stay in the JVM.
    rows = (lines.filter("start = 0").mapInPandas(below_header, "value string")
            .unionByName(lines.filter("start > 0").select("value")).filter(F.length(F.trim("value")) > 0))
    options = {"sep": sep, **({"nullValue": na} if na is not None else {})}
    return rows.select(F.from_csv("value", schema, options).alias("r")).select("r.*")


def read_posts(spark: SparkSession, path, schema: str = POST_SCHEMA, lines: bool = False) -> DataFrame:
    """Posts from JSON: one array of objects per file, or one object per line."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def read_list(spark: SparkSession, path, sep: str | None = None, names=("word",)) -> DataFrame:
    """A text list: one word per line, or the first fields of each line split on `sep`."""
    rows = spark.read.text(path).select(F.trim("value").alias("value")).filter(F.col("value") != "")
    if sep is None:
        return rows.select(F.col("value").alias(names[0]))
    fields = F.split("value", re.escape(sep))
    return rows.select(*[F.try_element_at(fields, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def read_images(spark: SparkSession, path, schema: str = IMAGE_SCHEMA, label: int | None = None) -> DataFrame:
    """Image arrays from Parquet batches (a folder, a glob or a list); optionally one label only."""
    paths = path if isinstance(path, (list, tuple)) else [path]
    df = spark.read.schema(schema).parquet(*paths)
    return df if label is None else df.filter(F.col("labels") == label)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    """Write a table as Parquet, CSV or JSON; CSV carries a header unless told otherwise."""
    if fmt == "csv":
        options = {"header": True, **options}
    df.write.format(fmt).mode(mode).options(**options).save(path)
