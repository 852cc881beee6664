"""All named queries of the package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import closed, models, posts, series, streams, tabular  # noqa: F401
from .registry import ORACLES, QUERIES, Tables


def entry(spark: SparkSession, folder: str) -> DataFrame:
    """Which columns vary most after imputation."""
    return tabular.top_features(Tables(spark, folder))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
