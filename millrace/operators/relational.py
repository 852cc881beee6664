"""Projections, filters, recodes, top-k and reshaping of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import as_list


def split_features(df: DataFrame, start: int, stop: int | None, label: str) -> DataFrame:
    """Columns start..stop-1 by position plus the label column."""
    features = [c for c in df.columns[start:stop] if c != label]
    return df.select(*features, label)


def nullify(df: DataFrame, cols, token: str) -> DataFrame:
    """The missing-value token becomes null."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(token)) for c in as_list(cols)})


def recode(df: DataFrame, col: str, mapping: dict, out: str | None = None, default=None) -> DataFrame:
    """Replace the values of a column through a literal map; unknown values get `default`."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    value = F.try_element_at(F.create_map(*pairs), F.col(col))
    if default is not None:
        value = F.coalesce(value, F.lit(default))
    return df.withColumn(out or col, value)


def drop_missing(df: DataFrame, cols=None) -> DataFrame:
    """Rows without a null in `cols`."""
    return df.dropna(subset=as_list(cols) or None)


def sentiment_code(df: DataFrame, col: str, positive: str = "bullish", out: str = "code") -> DataFrame:
    """0 for a null struct, 1 for the positive class, 2 for any other."""
    code = F.when(F.col(col).isNull(), 0).when(F.col(col)["class"] == positive, 1).otherwise(2)
    return df.withColumn(out, code)


def day_key(df: DataFrame, col: str, fmt: str | None = None, out: str = "day") -> DataFrame:
    """yyyymmdd integer of a date, a timestamp, or a text in format `fmt`."""
    moment = F.to_date(F.col(col), fmt) if fmt else F.to_date(F.col(col))
    return df.withColumn(out, (F.year(moment) * 10000 + F.month(moment) * 100 + F.day(moment)).cast("int"))


def post_day(df: DataFrame, col: str = "created_at", out: str = "day") -> DataFrame:
    """yyyymmdd integer of a post's time text, such as 'Fri, 03 Jan 2014 09:00:00'."""
    date = F.substring_index(F.trim(F.split_part(F.col(col), F.lit(","), F.lit(2))), " ", 3)
    return day_key(df.withColumn("__date", date), "__date", "d MMM yyyy", out).drop("__date")


def round_cols(df: DataFrame, cols, digits: int = 2) -> DataFrame:
    """Round half to even."""
    return df.withColumns({c: F.bround(F.col(c), digits) for c in as_list(cols)})


def map_cols(df: DataFrame, cols, fn, suffix: str = "") -> DataFrame:
    """Apply one column function (F.log, F.exp, F.sqrt, F.abs, ...) to several columns."""
    return df.withColumns({c + suffix: fn(F.col(c)) for c in as_list(cols)})


def binarize(df: DataFrame, col: str, threshold: float = 0.5, absolute: bool = False, out: str = "hit") -> DataFrame:
    """1 where col >= threshold, or where abs(col) > threshold."""
    hit = (F.abs(F.col(col)) > threshold) if absolute else (F.col(col) >= threshold)
    return df.withColumn(out, F.when(hit, 1).otherwise(0))


def reindex_range(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows for the keys 0..n-1; a missing key gives a row of nulls."""
    return df.sparkSession.range(n).withColumnRenamed("id", key).join(df, key, "left")


def sign_labels(df: DataFrame, first: str, second: str, out: tuple[str, str] = ("up_1", "up_2")) -> DataFrame:
    """1 where a return is positive; both labels are 0 when either return is null."""
    known = F.col(first).isNotNull() & F.col(second).isNotNull()
    label = lambda c: F.when(known & (F.col(c) > 0), 1).otherwise(0)
    return df.withColumns({out[0]: label(first), out[1]: label(second)})


def top_features(stats: DataFrame, k: int, score: str = "cv", name: str = "feature") -> DataFrame:
    """The k features with the largest score; ties by name."""
    return stats.orderBy(F.col(score).desc_nulls_last(), name).limit(k)


def best_worst(df: DataFrame, score: str, n: int, key: str) -> DataFrame:
    """The n best and the n worst rows by score; ties by key."""
    best = df.orderBy(F.col(score).desc_nulls_last(), key).limit(n).withColumn("side", F.lit("best"))
    worst = df.orderBy(F.col(score).asc_nulls_last(), key).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def preview(df: DataFrame, order_by, n: int = 5) -> DataFrame:
    """The first n rows."""
    return df.orderBy(*as_list(order_by)).limit(n)


def best_param(scores: DataFrame, score: str = "score", param: str = "param") -> DataFrame:
    """The parameter with the largest score; ties to the smallest parameter."""
    return scores.orderBy(F.col(score).desc_nulls_last(), param).limit(1)


def count_by(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*as_list(keys)).count()


def json_field(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Fields of a JSON text column as columns."""
    return df.withColumn("__json", F.from_json(F.col(col), schema)).select("*", "__json.*").drop("__json")


def to_price(mean: Column, variance: Column | None = None) -> Column:
    """Price from a log forecast: exp(mean), or exp(mean - variance) when a variance is given."""
    return F.exp(mean if variance is None else mean - variance)
