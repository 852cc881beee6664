"""Samples of distinct texts with a strict bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, SPAN = -(1 << 63), 1 << 64


def distinct_texts(docs: DataFrame, n: int, text_col: str = "text", by: str | None = None) -> DataFrame:
    """(by, text): `n` distinct texts of each value of `by`, or all where there are fewer; one row for each.

    They are the texts of the smallest hashes, so copies neither crowd out others nor add rows. Only hashes reach the
    driver, about 2 n of them for each value.
    """
    group = F.lit("") if by is None else F.col(by)
    rows = docs.select(group.alias("by"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    sizes = rows.groupBy("by").agg(F.approx_count_distinct("hash", 0.02).alias("n")).collect()
    if not sizes:
        return rows.drop("hash")
    # Twice the share that is wanted leaves n of them but for a negligible chance.
    upto = {r["by"]: LEAST + min(SPAN - 1, SPAN * 2 * n // max(1, r["n"])) for r in sizes}

    def within(limits: dict) -> DataFrame:
        table = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
        return rows.filter(F.col("hash") <= table[F.col("by")])

    hashes: dict = {}
    for r in within(upto).select("by", "hash").distinct().collect():
        hashes.setdefault(r["by"], []).append(r["hash"])
    cut = {k: sorted(found)[min(n, len(found)) - 1] for k, found in hashes.items()}
    return within(cut).dropDuplicates(["by", "hash"]).drop("hash")
