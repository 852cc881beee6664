"""Scores of predictions and clusterings, each from one grouped aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import hamming_distance, squared_distance
from ..session import BROADCAST_ROWS, TASK_ROWS, as_list, cut_lineage
from .joins import lookup_join
from .order import prefix_sums
from .stats import group_mode


def _ratio(a: Column, b: Column) -> Column:
    """a / b with 0 where b is 0: the rule for classes without rows or predictions."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def mse(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    err = F.col(y) - F.col(p)
    return df.groupBy(*as_list(by)).agg(F.avg(err * err).alias("mse"))


def rmse(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    return mse(df, y, p, by).withColumn("rmse", F.sqrt("mse")).drop("mse")


def r2(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    err = F.col(y) - F.col(p)
    fit = 1 - F.try_divide(F.sum(err * err), F.count(p) * F.var_pop(F.when(F.col(p).isNotNull(), F.col(y))))
    return df.groupBy(*as_list(by)).agg(fit.alias("r2"))


def accuracy(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    return df.groupBy(*as_list(by)).agg(F.avg((F.col(y) == F.col(p)).cast("int")).alias("accuracy"))


def _cells(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, y: str, p: str, classes: list | None = None) -> DataFrame:
    """(y, p, n) over the full class grid, zeros included, for any number of classes.

    The driver holds the class names; the grid, their square, is laid out by Spark.
    """
    counts = cut_lineage(_cells(df, y, p))
    if classes is None:
        seen = counts.select(F.col("y").alias("c")).union(counts.select("p")).distinct().filter("c is not null")
        classes = sorted(r[0] for r in seen.collect())
    names = df.sparkSession.createDataFrame([(a,) for a in classes], T.StructType([counts.schema["y"]]))
    grid = names.repartition(max(1, len(classes) // 1000), "y").withColumn(
        "p", F.explode(F.array(*[F.lit(c) for c in classes]).cast(T.ArrayType(counts.schema["p"].dataType))))
    return grid.join(counts, ["y", "p"], "left").fillna(0, ["n"])


def class_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """(class, tp, support, predicted) per class seen in y or p."""
    counts = _cells(df, y, p)
    none = F.lit(0).cast("long")
    cell = lambda c, tp, sup, said: F.struct(
        c.alias("class"), tp.alias("tp"), sup.alias("support"), said.alias("predicted"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(none)
    rows = counts.select(F.inline(F.array(cell(F.col("y"), hit, F.col("n"), none), cell(F.col("p"), none, none, F.col("n")))))
    return rows.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """(class, precision, recall, f1, support) per class plus 'macro avg' and 'weighted avg' rows."""
    counts = class_counts(df, y, p)
    scored = counts.select(
        F.col("class").cast("string").alias("class"), _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2.0 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"), "support")
    measures = ["precision", "recall", "f1"]
    # Every class row counts three times, as itself and in both averages: one pass over the table makes all rows.
    line = lambda name, kind: F.struct(name.alias("class"), F.lit(kind).alias("kind"))
    lines = F.array(line(F.col("class"), "class"), line(F.lit("macro avg"), "macro"), line(F.lit("weighted avg"), "weighted"))
    each = scored.select(*measures, "support", F.inline(lines))
    means = [F.when(F.col("kind") == "weighted", _ratio(F.sum(F.col(m) * F.col("support")), F.sum("support"))).otherwise(F.avg(m)).alias(m)
             for m in measures]
    return each.groupBy("class", "kind").agg(*means, F.sum("support").alias("support")).drop("kind")


def macro_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    """(macro_precision, macro_recall); an absent class counts 0."""
    counts = class_counts(df, y, p)
    return counts.agg(F.avg(_ratio(F.col("tp"), F.col("predicted"))).alias("macro_precision"),
                      F.avg(_ratio(F.col("tp"), F.col("support"))).alias("macro_recall"))


def binary_scores(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """(precision, recall, f1) of class 1."""
    tp = F.count_if((F.col(y) == 1) & (F.col(p) == 1))
    said, real = F.count_if(F.col(p) == 1), F.count_if(F.col(y) == 1)
    return df.groupBy(*as_list(by)).agg(
        _ratio(tp, said).alias("precision"), _ratio(tp, real).alias("recall"), _ratio(2.0 * tp, said + real).alias("f1"))


def hamming_loss(df: DataFrame, ys, ps) -> DataFrame:
    """(label, loss) per label, and the mean over all label positions as 'all'."""
    ys, ps = as_list(ys), as_list(ps)
    wrong = {y: F.avg((F.col(y) != F.col(p)).cast("int")) for y, p in zip(ys, ps)}
    total = sum(wrong.values(), F.lit(0.0)) / len(ys)
    one = df.agg(*[e.alias(y) for y, e in wrong.items()], total.alias("all"))
    return one.unpivot([], [*ys, "all"], "label", "loss")


def auc(df: DataFrame, y: str, score: str, max_rows: int = TASK_ROWS) -> DataFrame:
    """Exact ROC AUC with ties averaged; null when one class is absent.

    Rows collapse to one row per distinct score before the order is needed, and the running
    total of negatives comes from range partitions when the distinct scores are many.
    """
    by_score = df.groupBy(F.col(score).alias("__s")).agg(
        F.count_if(F.col(y) == 1).alias("__pos"), F.count_if(F.col(y) == 0).alias("__neg"))
    below = prefix_sums(cut_lineage(by_score), "__s", {"__upto": "__neg"}, max_rows)
    won = F.sum(F.col("__pos") * (F.col("__upto") - F.col("__neg") / 2.0))
    return below.agg(F.try_divide(won, F.sum("__pos").cast("double") * F.sum("__neg")).alias("auc"))


def auc_hard(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """AUC of hard 0/1 predictions: the mean of the two recalls; null for one class."""
    hit = lambda c: F.try_divide(F.count_if((F.col(y) == c) & (F.col(p) == c)), F.count_if(F.col(y) == c))
    return df.groupBy(*as_list(by)).agg(((hit(1) + hit(0)) / 2).alias("auc"))


def auc_ovr(df: DataFrame, y: str, p: str) -> DataFrame:
    """Macro one-vs-rest AUC of predicted classes, from the class counts alone."""
    counts = class_counts(df, y, p)
    n = counts.agg(F.sum("support")).first()[0] or 0
    rest = F.lit(n) - F.col("support")
    tpr = F.try_divide(F.col("tp"), F.col("support"))
    tnr = F.try_divide(rest - (F.col("predicted") - F.col("tp")), rest)
    return counts.filter(F.col("support") > 0).agg(F.avg((tpr + tnr) / 2).alias("auc"))


def majority_hamming(df: DataFrame, cluster: str, labels) -> DataFrame:
    """(cluster, distance, loss): mean Hamming distance of members to their cluster's majority labels."""
    labels = as_list(labels)
    modes = group_mode(df, cluster, labels).withColumnsRenamed({c: f"__m_{c}" for c in labels})
    joined = lookup_join(df, modes, cluster)
    text = lambda cols: F.array(*[F.col(c).cast("string") for c in cols])
    apart = hamming_distance(text(labels), text([f"__m_{c}" for c in labels]))
    return joined.groupBy(cluster).agg(F.avg(apart).alias("distance"), F.avg(apart / len(labels)).alias("loss"))


def _centroids(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """(cluster, n, centre) with element-wise means; partial sums per (cluster, position)."""
    cells = df.select(cluster, F.posexplode(vec).alias("pos", "x")).groupBy(cluster, "pos").agg(
        F.avg("x").alias("m"), F.count("x").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    return cells.groupBy(cluster).agg(F.max("n").alias("n"), ordered.alias("centre"))


def inertia(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Sum of squared distances to the cluster means: n times the variances, from one aggregate."""
    cells = df.select(cluster, F.posexplode(vec).alias("pos", "x")).groupBy(cluster, "pos").agg(
        (F.var_pop("x") * F.count("x")).alias("ss"))
    return cells.agg(F.sum("ss").alias("inertia"))


def calinski_harabasz(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """(between / (k - 1)) / (within / (n - k))."""
    cells = df.select(cluster, F.posexplode(vec).alias("pos", "x")).groupBy(cluster, "pos").agg(
        F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("ss"))
    per_pos = cells.groupBy("pos").agg(
        F.sum("ss").alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("a"),
        F.sum(F.col("n") * F.col("m")).alias("b"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    between = F.col("a") - F.col("b") * F.col("b") / F.col("n")
    ch = F.try_divide(F.sum(between) * (F.max("n") - F.max("k")), F.sum("within") * (F.max("k") - 1))
    return per_pos.agg(ch.alias("calinski_harabasz"))


def silhouette(df: DataFrame, key: str, vec: str, cluster: str, metric: str = "euclidean",
               max_rows: int = TASK_ROWS) -> DataFrame:
    """(silhouette): mean over all points of (b - a) / max(a, b); single-member clusters score 0.

    metric='squared' needs only cluster counts, means and mean square norms, so it is linear in
    the rows. metric='euclidean' has no such form: see neighbours.cluster_distance_sums.
    """
    if metric == "squared":
        centres = _centroids(df, vec, cluster)
        norms = df.groupBy(cluster).agg(F.avg(_square(F.col(vec))).alias("q"))
        table = [(r[cluster], r["n"], r["centre"], r["q"]) for r in centres.join(norms, cluster).collect()]
        dists = F.array(*[F.struct(
            F.lit(c).alias("c"), F.lit(n).alias("n"),
            (squared_distance(F.col(vec), F.array(*[F.lit(float(x)) for x in m]))
             + F.lit(float(q) - sum(x * x for x in m))).alias("d")) for c, n, m, q in table])
        mean_to = df.select(F.col(cluster).alias("__own"), dists.alias("__d"))
    elif metric == "euclidean":
        from .neighbours import cluster_distance_sums

        return _from_sums(cluster_distance_sums(df, key, vec, cluster, max_rows=max_rows), []).select("silhouette")
    else:
        raise ValueError("metric is 'euclidean' or 'squared'")
    return mean_to.agg(F.avg(_shape()).alias("silhouette"))


def silhouettes(df: DataFrame, key: str, vec: str, clusters: str, n: int, metric: str = "euclidean",
                max_rows: int = BROADCAST_ROWS) -> list[float | None]:
    """The silhouette of each of `n` clusterings, whose cluster numbers (0..) stand in the array column `clusters`.

    Euclidean distances are computed once for all clusterings: where the rows pass a check of their number and bytes,
    tasks hold the table and return a sum per clustering. Otherwise they meet in blocks.
    """
    from .neighbours import cluster_distance_sums, silhouette_sums

    if metric != "euclidean":
        return [silhouette(df.withColumn("__own", F.get(clusters, F.lit(j))), key, vec, "__own", metric).first()[0]
                for j in range(n)]
    found = silhouette_sums(df, vec, clusters, n, max_rows)
    if found is None:
        found = []
        sums = cluster_distance_sums(df, key, vec, clusters, max_rows=max_rows, labelings=n)
        rows = {r["labeling"]: r["silhouette"] for r in _from_sums(sums, ["labeling"]).collect()}
        found = [rows.get(j) for j in range(n)]
    return found


def _from_sums(sums: DataFrame, by: list) -> DataFrame:
    """Mean silhouette from (by.., id, own, cluster, n, dist)."""
    mean_to = sums.groupBy(*by, "id", "own").agg(F.collect_list(F.struct(
        F.col("cluster").alias("c"), F.col("n"), (F.col("dist") / F.col("n")).alias("d"))).alias("__d")
    ).withColumnRenamed("own", "__own")
    return mean_to.groupBy(*by).agg(F.avg(_shape()).alias("silhouette"))


def _shape() -> Column:
    """(b - a) / max(a, b) from `__own` and `__d`, an array of (c, n, mean distance d)."""
    own = F.filter("__d", lambda s: s["c"] == F.col("__own"))[0]
    a = own["d"] * own["n"] / F.nullif(own["n"] - 1, F.lit(0))
    b = F.array_min(F.transform(F.filter("__d", lambda s: s["c"] != F.col("__own")), lambda s: s["d"]))
    score = F.when(own["n"] > 1, F.try_divide(b - a, F.greatest(a, b))).otherwise(0.0)
    return F.coalesce(score, F.lit(0.0))


def _square(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x)
