"""Column statistics: imputation, variation, correlation, quartiles, majority values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import let
from ..session import TASK_ROWS, as_list, fits
from .batches import map_batches
from .joins import lookup_join

WIDE = 24  # columns above which pairs are taken from one matrix instead of one expression each


def impute_mean(df: DataFrame, cols, fit_where: Column | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Fill nulls with column means taken over the fit rows (nulls ignored).

    `fit_on` is another frame to take the means from (the training part); `fit_where` limits
    the fit rows. One aggregate returns one row, which then enters the projection as literals.
    """
    cols = as_list(cols)
    source = df if fit_on is None else fit_on
    if fit_where is not None:
        source = source.filter(fit_where)
    means = source.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c]).cast("double")) for c in cols})


def coef_variation(df: DataFrame, cols) -> DataFrame:
    """(feature, cv): population standard deviation over the mean, null for a zero mean."""
    cols = as_list(cols)
    wide = df.agg(*[F.try_divide(F.stddev_pop(c), F.avg(c)).alias(c) for c in cols])
    return wide.unpivot([], cols, "feature", "cv")


def _pairwise(df: DataFrame, cols: list) -> DataFrame:
    """Pairwise complete correlations of many columns: six sums per pair, taken as matrix products of each batch."""
    # Deviations from the rough means keep the sums well conditioned.
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"{i}") for i, c in enumerate(cols)]).first()
    shift = np.array([0.0 if m is None else m for m in means])
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    size = len(cols)

    def sums(batches):
        total = np.zeros((6, size, size))
        for batch in batches:
            x = np.stack([batch[f"c{i}"].to_numpy(dtype=float, na_value=np.nan) for i in range(size)], 1) - shift
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            for k, (a, b) in enumerate(((there, there), (x, there), (there, x), (x * x, there), (there, x * x), (x, x))):
                total[k] += a.T @ b
        i, j = np.divmod(np.arange(size * size), size)
        yield pd.DataFrame({"i": i, "j": j, **{f"s{k}": total[k].ravel() for k in range(6)}})

    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("j", T.LongType()),
                           *[T.StructField(f"s{k}", T.DoubleType()) for k in range(6)]])
    got = map_batches(values, sums, schema).groupBy("i", "j").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(6)])
    n, x, y, xx, yy, xy = (F.col(f"s{k}") for k in range(6))
    left, right = xx - F.try_divide(x * x, n), yy - F.try_divide(y * y, n)
    r = F.when((left > 1e-12 * xx) & (right > 1e-12 * yy), F.try_divide(xy - F.try_divide(x * y, n), F.sqrt(left * right)))
    names = F.array(*[F.lit(c) for c in cols])
    return got.select(F.get(names, F.col("i").cast("int")).alias("f1"), F.get(names, F.col("j").cast("int")).alias("f2"),
                      r.alias("r"))


def corr_matrix(df: DataFrame, cols) -> DataFrame:
    """(f1, f2, r) for every ordered pair of columns, from one scan of the table.

    Each pair uses the rows where both values are present; a constant column gives null. Up to `WIDE`
    columns that is one aggregate of expressions, beyond it sums of cross products per batch.
    """
    cols = as_list(cols)
    if len(cols) > WIDE:
        return _pairwise(df, cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]

    def corr(a, b):  # null for a constant column, where the built-in one fails under ANSI rules
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    one = df.agg(*[corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("f1"), F.lit(y).alias("f2"), F.col(f"`{i}`").alias("r")))
    return one.select(F.inline(F.array(*cells)))


def unit_rows(df: DataFrame, vec: str, out: str = "__u") -> DataFrame:
    """Every row array centred on its own mean and scaled to length one (null if constant)."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    length = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    centred = let(F.struct(F.col(vec).alias("v"), (total(F.col(vec)) / F.size(vec)).alias("m")),
                  lambda r: F.transform(r["v"], lambda x: x - r["m"]))
    scaled = let(centred, lambda c: let(F.struct(c.alias("c"), length(c).alias("s")), lambda r: F.when(
        r["s"] > 0, F.transform(r["c"], lambda x: x / r["s"]))))
    return df.withColumn(out, scaled)


def row_correlation(df: DataFrame, key: str, vec: str, ids: list) -> DataFrame:
    """(id1, id2, r): Pearson correlation of every row with the rows named in `ids`.

    The list bounds the output: n x len(ids) cells, with the named rows broadcast.
    """
    rows = unit_rows(df, vec).select(key, "__u")
    chosen = rows.filter(F.col(key).isin(list(ids)))
    if not fits(chosen, len(ids)):
        raise ValueError("ids must name distinct rows")
    picked = chosen.collect()
    dots = F.array(*[
        F.struct(F.lit(p[key]).cast(df.schema[key].dataType).alias("id2"), F.aggregate(
            F.zip_with("__u", F.array(*[F.lit(float(x)) for x in p["__u"]]), lambda a, b: a * b),
            F.lit(0.0), lambda s, x: s + x).alias("r"))
        for p in picked if p["__u"] is not None])
    return rows.filter(F.col("__u").isNotNull()).select(F.col(key).alias("id1"), F.inline(dots))


def row_correlation_mean(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, mean_r): mean correlation of a row with all rows, itself included.

    mean_j(u_i . u_j) = u_i . mean(u), so the n x n matrix is never formed: one aggregate of
    the unit rows, then one projection.
    """
    rows = unit_rows(df, vec).filter(F.col("__u").isNotNull()).select(key, "__u")
    parts = rows.select(F.posexplode("__u")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()
    centre = F.array(*[F.lit(p["m"]) for p in parts])
    dot = F.aggregate(F.zip_with("__u", centre, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.select(F.col(key).alias("id"), dot.alias("mean_r"))


def group_mode(df: DataFrame, key, cols) -> DataFrame:
    """Majority value of every column per group; ties to the smallest value.

    Counts combine on the map side, so a hot group costs one row per distinct value.
    """
    keys, cols = as_list(key), as_list(cols)
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("__col"), F.col(c).alias("__value")) for c in cols])))
    counts = long.groupBy(*keys, "__col", "__value").count()
    best = F.min(F.when(F.col("__value").isNotNull(), F.struct(-F.col("count"), F.col("__value"))))["__value"]
    modes = counts.groupBy(*keys, "__col").agg(best.alias("__mode"))
    return modes.groupBy(*keys).agg(*[F.max(F.when(F.col("__col") == c, F.col("__mode"))).alias(c) for c in cols])


def sentiment_score(df: DataFrame, by, is_positive: Column, out: str = "score") -> DataFrame:
    """(positive - negative) / tagged posts per group."""
    return df.groupBy(*as_list(by)).agg(F.avg(F.when(is_positive, 1.0).otherwise(-1.0)).alias(out))


def repeat_stats(df: DataFrame, key, value: str) -> DataFrame:
    """Mean and population standard deviation over repeated runs, per group."""
    return df.groupBy(*as_list(key)).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def exact_quantiles(df: DataFrame, cols, probs, max_rows: int = TASK_ROWS, sketch: int = 10_000) -> dict:
    """Exact linear-interpolated quantiles {col: [..]} of large columns without a shuffle.

    Up to `max_rows` rows Spark's own exact percentile runs. Above that, each wanted order
    statistic is bracketed by an approximate percentile, counted, and bracketed again inside the
    bracket until few enough values remain; every pass is one scan with map-side aggregates.
    """
    cols, probs = as_list(cols), list(probs)
    n = {c: v for c, v in zip(cols, df.agg(*[F.count(c) for c in cols]).first())}
    if max(n.values(), default=0) <= max_rows:
        row = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in probs])).alias(c)
                       for c in cols]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}
    wanted = {(c, r) for c in cols if n[c] for p in probs
              for r in (math.floor((n[c] - 1) * p), math.ceil((n[c] - 1) * p))}
    ends = df.agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    limits = {c: (ends[2 * i], ends[2 * i + 1]) for i, c in enumerate(cols)}
    state = {(c, r): (float(limits[c][0]), float(limits[c][1])) for c, r in wanted}
    found: dict = {}
    while state:
        todo = list(state)
        exprs = []
        for c, r in todo:
            lo, hi = state[c, r]
            inside = F.when(F.col(c).between(lo, hi), F.col(c).cast("double"))
            exprs += [F.count_if(F.col(c) < lo), F.count(inside)]
        counts = df.agg(*[e.alias(str(i)) for i, e in enumerate(exprs)]).first()
        finals, narrow = [], []
        for i, key in enumerate(todo):
            below, held = counts[2 * i], counts[2 * i + 1]
            lo, hi = state[key]
            if lo == hi:
                found[key] = lo
            elif held <= max_rows:
                finals.append((key, (key[1] - below) / max(held - 1, 1)))
            else:
                step = 2.0 / sketch
                at = (key[1] - below) / (held - 1)
                narrow.append((key, [max(at - step, 0.0), min(at + step, 1.0)]))
        inside = {k: F.when(F.col(k[0]).between(*state[k]), F.col(k[0]).cast("double")) for k in todo}
        exprs = [F.percentile(inside[k], F.lit(p)).alias(f"f{i}") for i, (k, p) in enumerate(finals)]
        exprs += [F.percentile_approx(inside[k], ps, sketch).alias(f"n{i}") for i, (k, ps) in enumerate(narrow)]
        got = df.agg(*exprs).first() if exprs else {}
        found.update({k: got[f"f{i}"] for i, (k, _) in enumerate(finals)})
        following = {}
        for i, (k, _) in enumerate(narrow):
            lo, hi = got[f"n{i}"]
            if (lo, hi) == state[k]:
                # The sketch cannot narrow a bracket of heavy repeated values: count them exactly.
                return {**_counted_quantiles(df, cols, probs, n)}
            following[k] = (lo, hi)
        # A bracket must still hold its order statistic; widen to the previous one if it does not.
        if following:
            checks = df.agg(*[e.alias(str(i)) for i, e in enumerate(
                [x for k, (lo, hi) in following.items()
                 for x in (F.count_if(F.col(k[0]) < lo), F.count_if(F.col(k[0]) <= hi))])]).first()
            for i, k in enumerate(list(following)):
                if not checks[2 * i] <= k[1] < checks[2 * i + 1]:
                    return {**_counted_quantiles(df, cols, probs, n)}
        state = following
    out = {}
    for c in cols:
        out[c] = []
        for p in probs:
            if not n[c]:
                out[c].append(None)
                continue
            at = (n[c] - 1) * p
            lo, hi = found[c, math.floor(at)], found[c, math.ceil(at)]
            out[c].append(lo + (hi - lo) * (at - math.floor(at)))
    return out


def _counted_quantiles(df: DataFrame, cols, probs, n) -> dict:
    """Quantiles from value counts and their running totals over a range-partitioned order."""
    from .order import prefix_sums

    out = {}
    for c in cols:
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("v")).agg(
            F.count(F.lit(1)).alias("k"))
        upto = prefix_sums(counts, "v", {"upto": "k"})
        ranks = sorted({f((n[c] - 1) * p) for p in probs for f in (math.floor, math.ceil)}) if n[c] else []
        hit = [F.min(F.when(F.col("upto") > r, F.col("v"))) for r in ranks]
        row = upto.agg(*hit).first() if ranks else []
        at = dict(zip(ranks, row))
        out[c] = [None if not n[c] else at[math.floor((n[c] - 1) * p)] + (
            at[math.ceil((n[c] - 1) * p)] - at[math.floor((n[c] - 1) * p)]) * (
            (n[c] - 1) * p - math.floor((n[c] - 1) * p)) for p in probs]
    return out


def box_fences(df: DataFrame, cols, **kw) -> dict:
    """{col: (q1, median, q3, low fence, high fence)} with fences 1.5 IQR outside the box."""
    fences = {}
    for c, (q1, q2, q3) in exact_quantiles(df, cols, [0.25, 0.5, 0.75], **kw).items():
        spread = None if q1 is None else 1.5 * (q3 - q1)
        fences[c] = (q1, q2, q3, None if q1 is None else q1 - spread, None if q1 is None else q3 + spread)
    return fences


def box_stats(df: DataFrame, cols, **kw) -> DataFrame:
    """(feature, q1, median, q3, whisker_low, whisker_high, n_outliers)."""
    cols = as_list(cols)
    fences = box_fences(df, cols, **kw)
    exprs = []
    for c in cols:
        q1, q2, q3, low, high = (F.lit(x).cast("double") for x in fences[c])
        inside = F.when(F.col(c).between(low, high), F.col(c))
        exprs.append(F.struct(
            F.lit(c).alias("feature"), q1.alias("q1"), q2.alias("median"), q3.alias("q3"),
            F.min(inside).cast("double").alias("whisker_low"), F.max(inside).cast("double").alias("whisker_high"),
            F.count_if(~F.col(c).between(low, high)).alias("n_outliers")).alias(c))
    return df.agg(*exprs).select(F.inline(F.array(*[F.col(f"`{c}`") for c in cols])))


def box_outliers(df: DataFrame, key, cols, **kw) -> DataFrame:
    """(key.., feature, value) for the values beyond the whisker fences."""
    cols, keys = as_list(cols), as_list(key)
    fences = box_fences(df, cols, **kw)
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 (~F.col(c).between(F.lit(fences[c][3]).cast("double"), F.lit(fences[c][4]).cast("double"))).alias("__out"))
        for c in cols])
    return df.select(*keys, F.inline(cells)).filter("__out").drop("__out")


def chisq_uniform(df: DataFrame, vec: str) -> DataFrame:
    """(idx, chisq) per vector position: sum (x - mean)^2 / mean = n var_pop / mean."""
    cells = df.select(F.posexplode(vec).alias("idx", "x"))
    stat = F.try_divide(F.count("x") * F.var_pop("x"), F.avg("x"))
    return cells.groupBy("idx").agg(stat.alias("chisq"))


def scatter_points(df: DataFrame, cols, label: str) -> DataFrame:
    """(feature, x, y) for the named columns against the label."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in as_list(cols)])
    return df.select(F.inline(cells), F.col(label).alias("y")).select("feature", "x", "y")


def scatter_bins(df: DataFrame, cols, label: str, bins: int = 20) -> DataFrame:
    """(feature, bin, n, mean_y): the scatter data of a large table on a regular grid per feature."""
    cols = as_list(cols)
    ends = df.agg(*[f(c).cast("double").alias(f"{f.__name__}_{c}") for c in cols for f in (F.min, F.max)]).first()
    cells = []
    for c in cols:
        lo, hi = ends[f"min_{c}"], ends[f"max_{c}"]
        wide = lo is not None and hi > lo
        where = F.least(F.floor((F.col(c) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)) if wide else F.lit(0)
        cells.append(F.struct(F.lit(c).alias("feature"), F.when(F.col(c).isNotNull(), where.cast("int")).alias("bin")))
    rows = df.select(F.inline(F.array(*cells)), F.col(label).alias("__y")).filter(F.col("bin").isNotNull())
    return rows.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("mean_y"))


def minmax_fit(df: DataFrame, col: str, by=None, where: Column | None = None) -> DataFrame:
    """(by.., lo, hi) over the fit rows."""
    source = df if where is None else df.filter(where)
    return source.groupBy(*as_list(by)).agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))


def _with_range(df: DataFrame, params: DataFrame, by) -> DataFrame:
    if as_list(by):
        return lookup_join(df, params, by, "left")
    row = params.first()
    return df.withColumns({"lo": F.lit(row["lo"]), "hi": F.lit(row["hi"])})


def scale(df: DataFrame, col: str, params: DataFrame, by=None, out: str | None = None) -> DataFrame:
    """Map [lo, hi] of the fit rows to [0, 1]; a zero range is treated as one."""
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return _with_range(df, params, by).withColumn(out or col, (F.col(col) - F.col("lo")) / width).drop("lo", "hi")


def unscale(df: DataFrame, col: str, params: DataFrame, by=None, out: str | None = None) -> DataFrame:
    """Inverse of `scale`."""
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return _with_range(df, params, by).withColumn(out or col, F.col(col) * width + F.col("lo")).drop("lo", "hi")


def one_hot(df: DataFrame, col: str, classes: list, prefix: str | None = None) -> DataFrame:
    """One 0/1 column per class."""
    stem = prefix or col
    return df.withColumns({f"{stem}_{c}": F.coalesce((F.col(col) == F.lit(c)).cast("int"), F.lit(0)) for c in classes})


def indicator(df: DataFrame, col: str, classes: list, out: str = "indicator") -> DataFrame:
    """A 0/1 array over the class list."""
    hit = F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: F.coalesce((c == F.col(col)).cast("int"), F.lit(0)))
    return df.withColumn(out, hit)


def classes_of(df: DataFrame, col: str, limit: int = 10_000) -> list:
    """The sorted distinct values of a label column, refused above `limit`."""
    rows = df.select(col).filter(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} distinct values; it is not a label")
    return sorted(r[0] for r in rows)


def label_counts(df: DataFrame, label: str, limit: int = 10_000) -> dict:
    """Rows per class of a label column, refused above `limit` classes."""
    rows = df.groupBy(label).count().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{label} has more than {limit} distinct values; it is not a label")
    return {r[label]: r["count"] for r in rows}


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Row weight n / (classes * rows of the class), for any number of classes; null without a label."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__k"))
    total = counts.agg(F.sum("__k").alias("n"), F.count(F.lit(1)).alias("c")).first()
    weights = counts.select(label, (F.lit(float(total["n"] or 0)) / (F.col("__k") * total["c"])).alias(out))
    return lookup_join(df.drop(out), weights, label, "left").select(*[c for c in df.columns if c != out], out)
