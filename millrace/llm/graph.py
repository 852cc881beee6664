"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected links; a component's name is its smallest node.

    Alternates large-star and small-star steps (Kiveris et al. 2014): every node links its larger neighbours, then its
    smaller ones, to the smallest of them. A logarithmic number of rounds in practice; each shuffles the links, which
    never outnumber the input's, and is checkpointed. Null nodes, loops and repeated links are ignored.
    """
    edges = cut_lineage(links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
                        .filter("lo is not null and hi is not null and lo < hi").distinct())

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()

    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy(F.col("lo").alias("node")).agg(F.least(F.min("hi"), F.col("node")).alias("least"))
        large = (both.filter("hi > lo").join(least, F.col("lo") == F.col("node"))
                 .select(F.col("least").alias("lo"), "hi").filter("lo < hi").distinct())
        lowest = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
        small = large.join(lowest, F.col("hi") == F.col("node")).select(F.col("least").alias("lo"), F.col("lo").alias("mid"),
                                                                       "hi")
        edges = cut_lineage(small.select(F.explode(F.array(F.struct("lo", "hi"), F.struct("lo", F.col("mid").alias("hi"))))
                                         .alias("e")).select("e.*").filter("lo < hi").distinct())
        now = state(edges)
        if now == before:
            break
        before = now
    top = edges.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    stars = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
    return stars.unionByName(top.join(stars, "node", "left_anti"))
