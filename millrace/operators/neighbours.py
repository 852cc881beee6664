"""k-nearest-neighbour joins, distance sums and k-NN regression.

No pair table is ever built. A right side that passes a size check is broadcast as a matrix and
the left side streams past it. Otherwise the right side is cut into Voronoi cells around sampled
pivots, each group of rows (the value of `by`, the barred fold) into cells of its own, large cells into blocks; a left
row visits only cells of its groups whose distance bound allows a closer neighbour (triangle and hyperplane bounds, Lu et
al., VLDB 2012), and a task that holds one left block and one right block returns the best k per left row. The plan is
the same for any number of groups. Where the visits are many times the rows, as they are for vectors without structure, no
visit is written: rows of neighbouring cells are packed to records, and every task streams the right records past its left ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import BROADCAST_ROWS, Shared, as_list, cut_lineage, fits
from .batches import map_batches, matrix, small_batches
from .gram import total_array
from .joins import lookup_join, top_per_key

_TILE = 4_000_000  # cells of one distance tile
# Bytes of vectors that may be broadcast, and of sampled pivots; visits that the left rows of one task may list; left rows
# that an approximate join tries on all right rows.
BROADCAST_BYTES, PIVOT_BYTES, VISITS, TRIED = 256_000_000, 64_000_000, 2_000_000, 256
# Bounds of distances that a task compares at once.
BOUND_CELLS = 2_000_000
# Visits that are written at most: a number, or a multiple of the rows of both sides if that is more. Beyond, records are
# streamed; bytes of the vectors in one of these, and cells that the driver lists for their bounds.
VISIT_ROWS, VISIT_SHARE, RECORD_BYTES, CELLS_LISTED = 500_000, 8, 4_000_000, 20_000


def _keep_copies(right: pd.DataFrame, x: np.ndarray, keep: int, extra: str | None) -> np.ndarray:
    """Row numbers of the `keep` smallest ids of every distinct vector: the only copies that can rank."""
    tag = pd.DataFrame({"v": [r.tobytes() for r in x], "id": right["__rid"].to_numpy()})
    by = ["v"]
    if extra is not None:
        tag["e"] = right[extra].to_numpy()
        by.append("e")
    tag = tag.sort_values("id", kind="stable")
    return np.sort(tag.index[tag.groupby(by, sort=False, dropna=False).cumcount() < keep].to_numpy())


def _best_k(q: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int,
            banned: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, distance, rank) of the k nearest, ties by id. Distances are recomputed
    from differences for the candidates, so copies are at exactly zero."""
    rows_out, cols_out, dist_out, rank_out = [], [], [], []
    xx = (x * x).sum(1)
    step = max(1, _TILE // max(len(x), 1))
    for lo in range(0, len(q), step):
        part = q[lo:lo + step]
        qq = (part * part).sum(1)
        d2 = qq[:, None] + xx[None, :] - 2.0 * part @ x.T
        if banned is not None:
            mine = banned[0][lo:lo + step]
            d2[(mine[:, None] == banned[1][None, :]) & ~pd.isna(mine)[:, None]] = np.inf
        kk = min(k, d2.shape[1])
        kth = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
        slack = 1e-10 * (qq + xx.max(initial=0.0)) + 1e-300
        rows, cols = np.nonzero((d2 <= np.where(np.isfinite(kth), kth, np.finfo(float).max)[:, None] + slack[:, None])
                                & np.isfinite(d2))
        exact = np.sqrt(((part[rows] - x[cols]) ** 2).sum(1))
        order = np.lexsort((xid[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = rank < k
        rows_out.append(rows[keep] + lo)
        cols_out.append(cols[keep])
        dist_out.append(exact[keep])
        rank_out.append((rank[keep] + 1).astype("int32"))
    if not rows_out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, "int32")
    return np.concatenate(rows_out), np.concatenate(cols_out), np.concatenate(dist_out), np.concatenate(rank_out)


def knn_join(left: DataFrame, right: DataFrame, k: int, vec: str, key: str, by: str | None = None,
             exclude_same: str | None = None, carry=(), approx: bool = False, probes: int | None = None,
             recall: float = 0.95, max_rows: int = BROADCAST_ROWS, block_rows: int = 20_000, pivots: int | None = None,
             keep_by: bool = False) -> DataFrame:
    """(key, neighbour, dist, rank, carry..): the k nearest right rows of every left row.

    Euclidean, exact, ties by key. `by` limits neighbours to rows with the same value of that
    column; `exclude_same` bars rows that share that column's value (the key itself, or a fold). A null `by` has no
    neighbours; a null `exclude_same` bars nobody. `carry` names right columns to bring along; `keep_by` adds `by`, and
    a key may then occur once per value of it.

    `approx` visits the `probes` nearest cells only, which hold about sqrt(n) / 2 rows each. By default `probes` is found
    from the data: TRIED left rows are compared with every right row, and as many cells are visited as hold `recall` of
    their neighbours. Where vectors have structure these are few, and candidates grow as n ** 1.5 in all; where they have
    none, they are most cells. A cell that holds more than its share is cut into blocks, not dropped.
    """
    carry = as_list(carry)
    barred = exclude_same if exclude_same not in (None, key) else None
    wanted = list(dict.fromkeys([c for c in (by, barred) if c]))
    lcols = left.select(key, F.col(vec).cast("array<double>").alias(vec), *wanted)
    rcols = right.select(F.col(key).alias("__rid"), F.col(vec).cast("array<double>").alias("__rvec"),
                         *[F.col(c).alias(f"__r_{c}") for c in wanted],
                         *[F.col(c).alias(f"__c_{c}") for c in carry])
    fields = [T.StructField(key, left.schema[key].dataType), T.StructField("neighbour", right.schema[key].dataType),
              T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    fields += [T.StructField(c, right.schema[c].dataType) for c in carry]
    if by:
        lcols = lcols.filter(F.col(by).isNotNull())
        fields += [T.StructField("__by", left.schema[by].dataType)]
    schema = T.StructType(fields)
    if not approx and _small(right, rcols, max_rows):
        # Every left row meets the whole right side in one task: its rank is final.
        out = _broadcast_knn(lcols, rcols, k, vec, key, by, exclude_same, carry, schema)
    else:
        found = _cell_knn(lcols, rcols, k, vec, key, by, barred, exclude_same == key, carry, schema, approx, probes,
                          recall, block_rows, pivots)
        out = top_per_key(found.drop("rank"), [key, "__by"] if by else key, ["dist", "neighbour"], k)
    names = [key, "neighbour", "dist", "rank", *carry]
    return out.select(*names, F.col("__by").alias(by)) if by and keep_by else out.select(*names)


def _small(right: DataFrame, columns: DataFrame, max_rows: int) -> bool:
    """Whether the right side may be broadcast: by its rows and by the bytes of its vectors."""
    size = columns.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(F.size("__rvec"))).first()
    return size[0] <= max_rows and 8 * (size[1] or 0) <= BROADCAST_BYTES


def _broadcast_knn(left, right, k, vec, key, by, exclude_same, carry, schema) -> DataFrame:
    spark = left.sparkSession
    table = right.toPandas()
    x = matrix(table["__rvec"])
    extra = f"__r_{exclude_same}" if exclude_same not in (None, key) else None
    groups = {}
    for value, rows in ([(None, np.arange(len(table)))] if by is None
                        else table.groupby(f"__r_{by}", sort=False).indices.items()):
        part = table.iloc[rows].reset_index(drop=True)
        chosen = _keep_copies(part, x[rows], k + 1, extra)
        part = part.iloc[chosen].reset_index(drop=True)
        groups[value] = (x[rows][chosen], part["__rid"].to_numpy(),
                         part[extra].to_numpy() if extra else part["__rid"].to_numpy(),
                         part[[f"__c_{c}" for c in carry]])
    shared = Shared(spark, groups)

    def match(batches):
        for batch in batches:
            q, ids_left = batch[vec], batch[key].to_numpy()
            for value, rows in batch.groups([by] if by else []):
                if (value[0] if by else None) not in shared.value:
                    continue
                xs, ids, bans, extras = shared.value[value[0] if by else None]
                banned = None if exclude_same is None else (batch[exclude_same].to_numpy()[rows], bans)
                at, to, dist, rank = _best_k(q[rows], xs, ids, k, banned)
                out = pd.DataFrame({key: ids_left[rows][at], "neighbour": ids[to], "dist": dist, "rank": rank})
                for c in carry:
                    out[c] = extras[f"__c_{c}"].to_numpy()[to]
                if by:
                    out["__by"] = value[0]
                yield out

    return map_batches(left, match, schema)


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    if x.shape[0] * p.shape[0] * x.shape[1] < _TILE:
        return np.sqrt(((x[:, None, :] - p[None]) ** 2).sum(2))
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))


def _pivots(rows: DataFrame, n: int, d: int, approx: bool, pivots: int | None, block_rows: int) -> np.ndarray:
    """Sampled rows: 256 at most for exact joins; for approximate ones 2 sqrt(n), bounded by PIVOT_BYTES."""
    most = max(1, PIVOT_BYTES // (8 * max(d, 1)))
    wanted = pivots or (int(2 * np.sqrt(n)) if approx else min(256, n // max(block_rows // 8, 1)))
    chosen = rows.orderBy(F.xxhash64("__rid"), "__rid").limit(max(1, min(wanted, most, n))).select("__rvec").toPandas()
    return matrix(chosen["__rvec"])


def _chain(p: np.ndarray) -> np.ndarray:
    """An order of the pivots in which neighbours in it are near: each is followed by the nearest that is left."""
    order, open_ = [0], np.ones(len(p), bool)
    for _ in range(len(p) - 1):
        open_[order[-1]] = False
        order.append(int(np.where(open_, ((p - p[order[-1]]) ** 2).sum(1), np.inf).argmin()))
    return np.array(order)


def _probes(left, cells, centres: Shared, k, vec, key, by, barred, skip_self, recall) -> int:
    """How many of its nearest cells a left row has to visit for `recall` of its neighbours, from TRIED left rows."""
    name = [key, *(c for c in (by, barred) if c)]
    # Pivots are the first rows in the order of the plain hash: those lie nearer to their neighbours' cells than others do.
    order = F.xxhash64(F.lit("tried"), *name)
    tried = left.select(*dict.fromkeys([*name, vec])).orderBy(order).limit(TRIED).toPandas()
    if tried.empty:
        return 1
    sent = Shared(left.sparkSession, (tried, matrix(tried[vec])))

    def nearest(batches):
        rows, q = sent.value
        for b in batches:
            d = _distances(q, matrix(b["__rvec"]))
            for mine, its, same in ((by, f"__r_{by}", False), (barred, f"__r_{barred}", True),
                                    (key if skip_self else None, "__rid", True)):
                if mine:
                    equal = rows[mine].to_numpy()[:, None] == b[its].to_numpy()[None]
                    d[equal if same else ~equal] = np.inf
            kk = min(k, d.shape[1])
            at = np.argpartition(d, kk - 1, axis=1)[:, :kk]
            row, col = np.repeat(np.arange(len(q)), kk), at.ravel()
            ok = np.isfinite(d[row, col])
            yield pd.DataFrame({"row": row[ok].astype("int32"), "dist": d[row, col][ok],
                                "pivot": b["pivot"].to_numpy()[col[ok]], "used": b["__p"].to_numpy()[col[ok]]})

    found = cells.mapInPandas(nearest, "row int, dist double, pivot int, used int")
    found = top_per_key(found, "row", ["dist", "pivot"], k).toPandas()
    if found.empty:
        return 1
    d = _distances(sent.value[1][found["row"]], centres.value)
    own = d[np.arange(len(d)), found["pivot"]]
    nearer = ((d < own[:, None]) & (np.arange(d.shape[1])[None] < found["used"].to_numpy()[:, None])).sum(1)
    return int(np.sort(nearer)[int(np.ceil(recall * len(nearer))) - 1]) + 1


def _cell_knn(left, right, k, vec, key, by, barred, skip_self, carry, schema, approx, probes, recall, block_rows,
              pivots) -> DataFrame:
    """Candidates (schema) of every left row: at least its k nearest where the join is exact."""
    spark = left.sparkSession
    need = k + 1 if skip_self else k
    group = [F.col(f"__r_{c}") for c in (by, barred) if c]
    # Only the `need` smallest ids among equal vectors of a group can rank, so a mass of copies collapses here.
    copies = ["__rvec", *(f"__r_{c}" for c in (by, barred) if c)]
    slim = cut_lineage(top_per_key(right if by is None else right.filter(F.col(f"__r_{by}").isNotNull()), copies, "__rid",
                                   need + 1).drop("rank"))
    n = slim.count()
    if n == 0:
        return spark.createDataFrame([], schema)
    points = _pivots(slim, n, slim.select(F.size("__rvec")).first()[0], approx, pivots, block_rows)
    if by is None:
        points = points[_chain(points)]
    centres = Shared(spark, points)
    # A group uses as many of the pivots as its size calls for: a small one is a single cell.
    share = F.greatest(F.least(F.ceil(F.col("__n") * len(points) / n).cast("int"), F.lit(len(points))), F.lit(1))
    if by:
        sizes = slim.groupBy(f"__r_{by}").agg(F.count(F.lit(1)).alias("__n"))
        slim = lookup_join(slim, sizes.select(f"__r_{by}", share.alias("__p")), f"__r_{by}")
    else:
        slim = slim.withColumn("__p", F.lit(len(points)))
    cell_schema = T.StructType([*slim.schema.fields, T.StructField("pivot", T.IntegerType()),
                                T.StructField("off", T.DoubleType())])

    def to_cells(batches):
        p = centres.value
        for b in batches:
            x, used = matrix(b["__rvec"]), b["__p"].to_numpy()
            pivot, off = np.zeros(len(b), "int32"), np.zeros(len(b))
            for size in np.unique(used):
                rows = np.flatnonzero(used == size)
                for lo in range(0, len(rows), 1024):
                    own = rows[lo:lo + 1024]
                    d = _distances(x[own], p[:size])
                    pivot[own] = d.argmin(1)
                    off[own] = d[np.arange(len(own)), pivot[own]]
            yield b.assign(pivot=pivot, off=off)

    cells = cut_lineage(slim.mapInPandas(to_cells, cell_schema).withColumn(
        "cell", F.to_json(F.struct(*[g.alias(f"g{i}") for i, g in enumerate(group)], "pivot"))))
    keys = ["cell", "pivot", "__p", *(f"__r_{c}" for c in (by, barred) if c)]
    near = top_per_key(cells.select("cell", "off", "__rid"), "cell", ["off", "__rid"], need).groupBy("cell").agg(
        F.sort_array(F.collect_list("off")).alias("near"))
    stats = cut_lineage(cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("r")).join(near, "cell"))
    if approx and probes is None:
        probes = _probes(left, cells, centres, k, vec, key, by, barred, skip_self, recall)
    if by is None:
        listed = stats.toPandas() if fits(stats, CELLS_LISTED) else None
        limits = None if listed is None else _Limits(listed, points, need, barred, probes if approx else None)
        n_left = left.count()
        if _many_visits(left, limits, n_left, n, vec, barred, block_rows, approx):
            return _streamed(left.filter(F.col(key).isNotNull()), cells, centres, limits, k, vec, key, barred, skip_self, carry,
                             schema, approx, block_rows, n_left, n, points.shape)
    went = cut_lineage(_visits(left, stats, centres, need, vec, key, by, barred, approx, probes, block_rows))
    heavy = went.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("chunks")).filter("chunks > 1")
    chunk = F.coalesce("chunks", F.lit(1))
    # A left row is named by its key, and by its group where a key may occur once in each.
    name = [key, by] if by else [key]
    lhs = lookup_join(went, heavy, ["cell", "sub"], "left").withColumn(
        "chunk", F.pmod(F.xxhash64(*name), chunk).cast("int")).drop("chunks").join(left.select(vec, *name), name)
    subs = F.ceil(F.col("n") / block_rows).cast("int")
    dealt = lookup_join(cells.drop("pivot", "off", "__p"), stats.select("cell", subs.alias("subs")), "cell").withColumn(
        "sub", F.pmod(F.xxhash64("__rid"), F.col("subs")).cast("int")).drop("subs")
    rhs = lookup_join(dealt, heavy, ["cell", "sub"], "left").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), chunk - 1))).drop("chunks")
    names = schema.fieldNames()

    def best(lpart: pd.DataFrame, rpart: pd.DataFrame) -> pd.DataFrame:
        if not len(lpart) or not len(rpart):
            return pd.DataFrame(columns=names)
        ids = rpart["__rid"].to_numpy()
        banned = (lpart[key].to_numpy(), ids) if skip_self else None
        at, to, dist, rank = _best_k(matrix(lpart[vec]), matrix(rpart["__rvec"]), ids, k, banned)
        out = pd.DataFrame({key: lpart[key].to_numpy()[at], "neighbour": ids[to], "dist": dist, "rank": rank})
        for c in carry:
            out[c] = rpart[f"__c_{c}"].to_numpy()[to]
        if by:
            out["__by"] = lpart[by].to_numpy()[at]
        return out

    block = ["cell", "sub", "chunk"]
    return lhs.groupBy(*block).cogroup(rhs.groupBy(*block)).applyInPandas(best, schema)


def _visits(left, stats, centres: Shared, need, vec, key, by, barred, approx, probes, block_rows) -> DataFrame:
    """(key, by, cell, sub): the blocks of cells that a left row has to see. Rows of a group meet the list of its cells.

    Left rows of a group are dealt in parts, each of which gets the list once and has VISITS rows to give at most.
    """
    name = [key, by] if by else [key]
    blocks = F.sum(F.ceil(F.col("n") / block_rows))
    if by:
        met = stats.groupBy(F.col(f"__r_{by}").alias(by)).agg(blocks.alias("__blocks"))
        sizes = left.groupBy(by).agg(F.count(F.lit(1)).alias("__rows")).join(met, by).select(
            by, F.ceil(F.col("__rows") * F.col("__blocks") / VISITS).cast("int").alias("__parts"))
        rows = lookup_join(left, sizes, by)
        listed = lookup_join(stats.withColumnRenamed(f"__r_{by}", by), sizes, by)
        group = [F.col(by)]
    else:
        parts = max(1, -(-left.count() * int(stats.agg(blocks).first()[0] or 0) // VISITS))
        rows, listed, group = left.withColumn("__parts", F.lit(parts)), stats.withColumn("__parts", F.lit(parts)), []
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(key), F.col("__parts")).cast("int")).drop("__parts")
    listed = listed.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    schema = T.StructType([*(left.schema[c] for c in name), T.StructField("cell", T.StringType()),
                           T.StructField("sub", T.IntegerType())])

    def visits(lpart: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=schema.fieldNames())
        if not len(lpart) or not len(cells):
            return empty
        cells = cells.sort_values("cell", ignore_index=True)
        p = centres.value[:int(cells["__p"].iloc[0])]
        pivot, radius = cells["pivot"].to_numpy(), cells["r"].to_numpy()
        subs = np.ceil(cells["n"].to_numpy() / block_rows).astype(int)
        near_of = np.repeat(np.arange(len(cells)), [len(x) for x in cells["near"]])
        near_off = np.concatenate([np.asarray(x, float) for x in cells["near"]])
        between = None if approx else _distances(p, p)
        out = []
        step = max(1, min(1024, BOUND_CELLS // max(len(near_of), 1)))
        for lo in range(0, len(lpart), step):
            part = lpart.iloc[lo:lo + step]
            d = _distances(matrix(part[vec]), p)
            to = d[:, pivot]
            allowed = np.ones(to.shape, bool)
            if barred:
                mine, its = part[barred].to_numpy(), cells[f"__r_{barred}"].to_numpy()
                allowed = (mine[:, None] != its[None]) | pd.isna(mine)[:, None] | pd.isna(its)[None]
            if approx:
                go = allowed & (np.where(allowed, to, np.inf).argsort(1, kind="stable").argsort(1) < probes)
            else:
                reach = np.where(allowed[:, near_of], to[:, near_of] + near_off[None], np.inf)
                theta = np.partition(reach, need - 1, axis=1)[:, need - 1] if reach.shape[1] >= need else np.full(len(part), np.inf)
                slack = 1e-9 * (1 + d.max(1))
                gap = between[d.argmin(1)][:, pivot]
                plane = np.divide(to ** 2 - d.min(1)[:, None] ** 2, 2 * gap, out=np.zeros_like(to), where=gap > 0)
                go = allowed & (np.maximum(to - radius[None], plane) <= (theta + slack)[:, None])
            at, cell = np.nonzero(go)
            times = subs[cell]
            sub = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            at, cell = np.repeat(at, times), np.repeat(cell, times)
            out.append(part.iloc[at][name].assign(cell=cells["cell"].to_numpy()[cell], sub=sub.astype("int32")))
        return pd.concat(out, ignore_index=True)

    keys = [*group, F.col("__part")]
    return rows.groupBy(*keys).cogroup(listed.groupBy(*keys)).applyInPandas(visits, schema)


class _Limits:
    """How far from a left row its neighbours can be: by the listed cells of the right side.

    Without `probes` that is the distance of the `need`-th of the near rows of its nearest cells, which none of its
    neighbours exceeds; with `probes` the distance of the last pivot that it visits.
    """

    NEAREST = 32

    def __init__(self, cells: pd.DataFrame, points: np.ndarray, need: int, barred: str | None, probes: int | None):
        self.points, self.need, self.probes = points, need, probes
        self.pivot, self.radius, self.n = cells["pivot"].to_numpy(), cells["r"].to_numpy(), cells["n"].to_numpy()
        self.bans = cells[f"__r_{barred}"].to_numpy() if barred else None
        self.near = np.full((len(cells), need), np.inf)
        for row, offs in zip(self.near, cells["near"]):
            row[:len(offs)] = offs

    def of(self, q: np.ndarray, mine: np.ndarray | None):
        """Pieces of (limits, cells in reach: rows x cells) for the rows of q; `mine`: their values of the barred column."""
        step = max(1, min(1024, BOUND_CELLS // max(len(self.pivot), self.NEAREST * self.need)))
        for lo in range(0, len(q), step):
            part = q[lo:lo + step]
            to = _distances(part, self.points)[:, self.pivot]
            if mine is not None:
                own = mine[lo:lo + step]
                to[(own[:, None] == self.bans[None]) & ~pd.isna(own)[:, None] & ~pd.isna(self.bans)[None]] = np.inf
            if self.probes:
                limit = (np.partition(to, self.probes - 1, axis=1)[:, self.probes - 1] if to.shape[1] > self.probes
                         else np.full(len(part), np.inf))
                yield limit, np.isfinite(to) & (to <= _loose(limit)[:, None])
                continue
            few = min(self.NEAREST, to.shape[1])
            at = np.argpartition(to, few - 1, axis=1)[:, :few]
            reach = (np.take_along_axis(to, at, 1)[:, :, None] + self.near[at]).reshape(len(part), -1)
            limit = (np.partition(reach, self.need - 1, axis=1)[:, self.need - 1] if reach.shape[1] >= self.need
                     else np.full(len(part), np.inf))
            yield limit, np.isfinite(to) & (to - self.radius[None] <= _loose(limit)[:, None])


def _loose(limit: np.ndarray) -> np.ndarray:
    """A limit with room for the rounding of distances."""
    return limit + 1e-9 * (1 + limit)


def _many_visits(left, limits: _Limits | None, n_left: int, n_right: int, vec, barred, block_rows, approx: bool) -> bool:
    """Whether the visits of the left rows are too many to be written, judged from TRIED rows."""
    if limits is None:
        return not approx  # more cells than are listed: an exact join goes past all of them
    most, subs = max(VISIT_ROWS, VISIT_SHARE * (n_left + n_right)), np.ceil(limits.n / block_rows)
    if n_left * subs.sum() <= most:
        return False
    tried = left.orderBy(F.xxhash64(vec)).limit(TRIED).toPandas()
    mine = tried[barred].to_numpy() if barred else None
    seen = sum(float((go @ subs).sum()) for _, go in limits.of(matrix(tried[vec]), mine))
    return n_left * seen / max(len(tried), 1) > most


class _Nearest:
    """The k nearest rows seen so far of the left rows of one record."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, bans: np.ndarray | None, limit: np.ndarray, points: np.ndarray,
                 between: np.ndarray | None, k: int, skip_self: bool, block_rows: int):
        self.ids, self.q, self.bans, self.limit, self.k, self.block_rows = ids, q, bans, limit, k, block_rows
        self.skip_self, self.between = skip_self, between
        self.norm, self.wide = (q * q).sum(1), np.hstack([q, np.ones((len(q), 1))])
        self.to = _distances(q, points)
        self.own, self.least = self.to.argmin(1), self.to.min(1)
        # Distance of the k-th row so far.
        self.kth, self.found, self.fresh = np.full(len(q), np.inf), [], 0

    def see(self, ids: np.ndarray, x: np.ndarray, pivot: np.ndarray, off: np.ndarray, bans: np.ndarray | None, carry: list) -> None:
        """Takes the rows of a right record, which stand in the order of their cells."""
        cut = np.diff(pivot) != 0
        if bans is not None:
            cut |= np.diff(pd.factorize(bans)[0]) != 0
        ends = np.flatnonzero(np.append(cut, True)) + 1
        same = self._same(ids) if self.skip_self else None
        for a, b in zip(np.append(0, ends[:-1]), ends):
            rows = np.flatnonzero(self._go(pivot[a], off[a:b].max(), None if bans is None else bans[a]))
            for lo in range(a, b, self.block_rows) if len(rows) else ():
                self._add(rows, x, ids, carry, lo, min(lo + self.block_rows, b), same)

    def _same(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of equal ids, by column."""
        mine = pd.DataFrame({"id": self.ids, "row": np.arange(len(self.ids))})
        its = pd.DataFrame({"id": ids, "col": np.arange(len(ids))}).dropna()
        both = mine.merge(its, on="id").sort_values("col")
        return both["row"].to_numpy(), both["col"].to_numpy()

    def _go(self, pivot: int, radius: float, ban) -> np.ndarray:
        """Which left rows have to see a cell."""
        to = self.to[:, pivot]
        if self.between is None:
            go = to <= _loose(self.limit)
        else:
            gap = self.between[self.own, pivot]
            plane = np.divide(to ** 2 - self.least ** 2, 2 * gap, out=np.zeros_like(to), where=gap > 0)
            go = np.maximum(to - radius, plane) <= _loose(np.minimum(self.limit, self.kth))
        if self.bans is not None and not pd.isna(ban):
            go &= (self.bans != ban) | pd.isna(self.bans)
        return go

    def _add(self, rows: np.ndarray, x: np.ndarray, ids, carry, lo: int, hi: int, same) -> None:
        k, part = self.k, x[lo:hi]
        norm = (part * part).sum(1)
        turned = np.hstack([-2.0 * part, norm[:, None]]).T
        step, width = max(1, _TILE // (hi - lo)), hi - lo
        for at in range(0, len(rows), step):
            own = rows[at:at + step]
            d2 = self.wide[own] @ turned  # short of the left row's square
            if same is not None:
                a, b = np.searchsorted(same[1], [lo, hi])
                place = np.searchsorted(own, same[0][a:b])
                held = place < len(own)
                held[held] = own[place[held]] == same[0][a:b][held]
                d2[place[held], same[1][a:b][held] - lo] = np.inf
            slack = 1e-10 * (self.norm[own] + norm.max()) + 1e-300
            most = self.kth[own] ** 2 - self.norm[own] + slack
            new = np.flatnonzero(np.isinf(most))
            if len(new) and width > k:
                most[new] = np.partition(d2[new], k - 1, axis=1)[:, k - 1] + slack[new]
            row, col = np.divmod(np.flatnonzero((d2 <= most[:, None]).ravel()), width)
            real = np.isfinite(d2[row, col])
            row, col = own[row[real]], col[real] + lo
            dist = np.empty(len(row))
            for i in range(0, len(row), 50_000):
                dist[i:i + 50_000] = np.sqrt(((self.q[row[i:i + 50_000]] - x[col[i:i + 50_000]]) ** 2).sum(1))
            self.found.append([row, dist, ids[col], *(c[col] for c in carry)])
            self.fresh += len(row)
            if self.fresh > k * len(self.q) // 2:
                self._keep()

    def _keep(self) -> None:
        """Drops all but the k nearest of every left row, ties by id."""
        if not self.found:
            return
        columns = [np.concatenate(c) for c in zip(*self.found)]
        order = np.lexsort((columns[2], columns[1], columns[0]))
        row = columns[0][order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row, side="left") < self.k]
        self.found, self.fresh = [[c[order] for c in columns]], 0
        row, dist = self.found[0][:2]
        n = np.bincount(row, minlength=len(self.q))
        full = np.flatnonzero(n >= self.k)
        self.kth[full] = dist[np.cumsum(n)[full] - 1]

    def rows(self) -> list[np.ndarray] | None:
        """(left row, distance, id, carried..) of the nearest."""
        self._keep()
        return self.found[0] if self.found else None


def _pack(rows: DataFrame, key: str, barred: str | None, n: int, size: int, columns: dict, schema: T.StructType, add=None) -> DataFrame:
    """Records of `size` rows of neighbouring cells at most: `columns` as lists, the vectors `__x` and offsets `off` as bytes.

    `rows` has `pivot`, `off` and `__x`; `add` gives further fields of a record from its rows.
    """
    arrow = to_arrow_schema(schema)
    by = ["pivot", *([barred] if barred else [])]
    parts = rows.repartitionByRange(max(1, -(-n // size)), "pivot", F.xxhash64(key)).sortWithinPartitions(*by)

    def run(batches):
        held, made = [], 0

        def record(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            made += 1
            x = matrix(table.column("__x"))
            row = {"record": f"{TaskContext.get().partitionId()}-{made}", "x": x.tobytes(), "width": x.shape[1]}
            for name, source in columns.items():
                row[name] = pa.concat_arrays(table.column(source).chunks)
            row |= add(x, table) if add else {"off": table.column("off").to_numpy().astype(float).tobytes(),
                                              "has": np.unique(table.column("pivot").to_numpy())}
            arrays = []
            for f in arrow:
                value = row[f.name]
                if pa.types.is_list(f.type):
                    ends = pa.array([0, len(value)], pa.int32())
                    arrays.append(pa.ListArray.from_arrays(ends, pa.array(value).cast(f.type.value_type), type=f.type))
                else:
                    arrays.append(pa.array([value], f.type))
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            while batch.num_rows:
                room = size - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == size:
                    yield record(pa.Table.from_batches(held))
                    held = []
        if held:
            yield record(pa.Table.from_batches(held))

    return small_batches(parts).mapInArrow(run, schema)


def _streamed(left, cells, centres: Shared, limits: _Limits | None, k, vec, key, barred, skip_self, carry, schema, approx,
              block_rows, n_left: int, n_right: int, shape: tuple) -> DataFrame:
    """(schema): the k nearest of every left row, from the right rows of all cells that it has to see.

    Both sides are packed to records of RECORD_BYTES of vectors. A task holds one left part and streams all right records past
    it, so what is written is each side once, and memory holds a record of either side and the rows found.
    """
    spark, (pivots, width) = left.sparkSession, shape
    most = max(1, RECORD_BYTES // (8 * max(width, 1)))
    cores = spark.sparkContext.defaultParallelism
    size = max(1, min(most, _TILE // pivots, max(256, -(-n_left // (4 * cores)))))
    sent = Shared(spark, limits)

    left = left.select(F.col(key).alias("__key"), F.col(vec).alias("__x"), *([F.col(barred).alias("__ban")] if barred else []))

    def places(batches):
        for b in batches:
            x = b["__x"]
            near = np.concatenate([_distances(x[lo:lo + 1024], centres.value).argmin(1) for lo in range(0, len(x), 1024)])
            yield pa.RecordBatch.from_arrays([*b.columns(), pa.array(near.astype("int32"))], names=[*b.names(), "pivot"])

    placed = map_batches(left, places, T.StructType([*left.schema.fields, T.StructField("pivot", T.IntegerType())]))
    head = [T.StructField("record", T.StringType()), T.StructField("x", T.BinaryType()), T.StructField("width", T.IntegerType())]

    def listed(name: str, kind) -> T.StructField:
        return T.StructField(name, T.ArrayType(kind))

    def reach(x: np.ndarray, table: pa.Table) -> dict:
        """Limits of the rows of a left record, and the pivots that any of them has to see."""
        if sent.value is None:
            return {"limit": np.full(len(x), np.inf).tobytes(), "goes": np.arange(pivots)}
        mine = table.column("__ban").to_pandas().to_numpy() if barred else None
        found = list(sent.value.of(x, mine))
        goes = np.unique(sent.value.pivot[np.any([go.any(0) for _, go in found], axis=0)])
        return {"limit": np.concatenate([limit for limit, _ in found]).tobytes(), "goes": goes}

    lhs = {"key": "__key", **({"bans": "__ban"} if barred else {})}
    lschema = T.StructType([*head, *(listed(a, left.schema[b].dataType) for a, b in lhs.items()),
                            T.StructField("limit", T.BinaryType()), listed("goes", T.IntegerType())])
    lrecords = _pack(placed, "__key", "__ban" if barred else None, n_left, size, lhs, lschema, reach)
    rhs = {"ids": "__rid", "pivots": "pivot", **({"r_bans": f"__r_{barred}"} if barred else {}),
           **{f"c{i}": f"__c_{c}" for i, c in enumerate(carry)}}
    rschema = T.StructType([*head, *(listed(a, cells.schema[b].dataType) for a, b in rhs.items()),
                            T.StructField("off", T.BinaryType()), listed("has", T.IntegerType())])
    rrecords = cut_lineage(_pack(cells.withColumnRenamed("__rvec", "__x"), "__rid", f"__r_{barred}" if barred else None,
                                 n_right, most, rhs, rschema))
    rrecords = rrecords.withColumnsRenamed({"record": "r_record", "x": "r_x"}).drop("width")
    # The right records are one partition that every task reads as a stream; the left parts are the tasks.
    pairs = rrecords.coalesce(1).hint("shuffle_replicate_nl").join(lrecords, F.arrays_overlap("goes", "has"))
    arrow, names = to_arrow_schema(schema), schema.fieldNames()

    def match(batches):
        blocks: dict[str, _Nearest] = {}
        between = None if approx else _distances(centres.value, centres.value)
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}

            def values(name: str, i: int) -> np.ndarray:
                return col[name][i].values.to_pandas().to_numpy()

            def numbers(name: str, i: int) -> np.ndarray:
                return np.frombuffer(col[name][i].as_buffer())

            for i in range(batch.num_rows):
                record, d = col["record"][i].as_py(), col["width"][i].as_py()
                if record not in blocks:
                    blocks[record] = _Nearest(
                        values("key", i), numbers("x", i).reshape(-1, d).copy(), values("bans", i) if barred else None,
                        numbers("limit", i).copy(), centres.value, between, k, skip_self, block_rows)
                blocks[record].see(values("ids", i), numbers("r_x", i).reshape(-1, d), values("pivots", i), numbers("off", i),
                                   values("r_bans", i) if barred else None, [values(f"c{j}", i) for j in range(len(carry))])
        for block in blocks.values():
            found = block.rows()
            if found is not None:
                out = pd.DataFrame(dict(zip([key, "dist", "neighbour", *carry], [block.ids[found[0]], *found[1:]])))
                yield pa.RecordBatch.from_pandas(out.assign(rank=np.int32(0))[names], arrow, preserve_index=False)

    return small_batches(pairs).mapInArrow(match, schema)


def _shape_sums(x: np.ndarray, own: np.ndarray, tags: np.ndarray, table: np.ndarray, sizes: list[np.ndarray]) -> np.ndarray:
    """Sums of silhouettes over the rows of x, one per clustering; `own`, `tags`: cluster numbers (rows x clusterings).

    The distances to a piece of the table are summed per cluster, of all clusterings, by one matrix product.
    """
    ends = np.cumsum([0, *(len(n) for n in sizes)])
    step = max(1, min(2048, _TILE // max(int(ends[-1]), 1)))
    total, square = np.zeros(len(sizes)), (table * table).sum(1)
    for lo in range(0, len(x), step):
        q = x[lo:lo + step]
        sums, norm, at = np.zeros((len(q), ends[-1])), (q * q).sum(1), np.arange(len(q))
        for first in range(0, len(table), step):
            part, place = table[first:first + step], tags[first:first + step] + ends[:-1]
            d = np.sqrt(np.maximum(norm[:, None] + square[first:first + step][None] - 2 * q @ part.T, 0.0))
            hot = np.zeros((len(part), ends[-1]))
            hot[np.arange(len(part))[:, None], place] = 1.0
            sums += d @ hot
        for j, n in enumerate(sizes):
            to, mine = sums[:, ends[j]:ends[j + 1]], own[lo:lo + step, j]
            a = to[at, mine] / np.maximum(n[mine] - 1, 1)
            to = np.where(n > 0, to / np.maximum(n, 1), np.inf)
            to[at, mine] = np.inf
            b = to.min(1)
            ok = (n[mine] > 1) & np.isfinite(b) & (np.maximum(a, b) > 0)
            total[j] += ((b - a)[ok] / np.maximum(a, b)[ok]).sum()
    return total


def silhouette_sums(df: DataFrame, vec: str, clusters: str, n: int, max_rows: int) -> list[float | None] | None:
    """Mean silhouettes of the `n` clusterings in the array column `clusters`; None when the table is too large to send."""
    rows = df.select(F.col(vec).cast("array<double>").alias("__rvec"), F.col(clusters).alias("own"))
    if not _small(rows, rows, max_rows):
        return None
    table = rows.toPandas()
    if not len(table):
        return [None] * n
    x, tags = matrix(table["__rvec"]), matrix(table["own"]).astype(np.int64)
    sizes = [np.bincount(tags[:, j]) for j in range(n)]
    shared = Shared(df.sparkSession, (x, tags, sizes))

    def sums(batches):
        table, tags, sizes = shared.value
        total = np.zeros(len(sizes))
        for b in batches:
            total += _shape_sums(b["__rvec"], b["own"].astype(np.int64), tags, table, sizes)
        yield total

    return (total_array(cut_lineage(rows), sums) / len(table)).tolist()


def cluster_distance_sums(df: DataFrame, key: str, vec: str, cluster: str, max_rows: int = BROADCAST_ROWS,
                          block_rows: int = 20_000, labelings: int | None = None) -> DataFrame:
    """(id, own, cluster, n, dist): sum of Euclidean distances from every row to every cluster.

    With `labelings` the column `cluster` is an array of that many labels, `labeling` is their place, and the distances
    of a block are computed once for all of them. The work is quadratic by definition; the output is rows x clusters. A
    table that passes the size check is broadcast; a larger one meets itself block by block.
    """
    spark = df.sparkSession
    tags = F.col(cluster) if labelings else F.array(cluster)
    rows = df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"), tags.alias("own"))
    kind = rows.schema["own"].dataType.elementType
    out_type = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("labeling", T.IntegerType()),
                             T.StructField("own", kind), T.StructField("cluster", kind), T.StructField("n", T.LongType()),
                             T.StructField("dist", T.DoubleType())])

    def columns(lists) -> list[np.ndarray]:
        return [np.array([tags[j] for tags in lists]) for j in range(labelings or 1)]

    def sums(ids, own, q: np.ndarray, x: np.ndarray, others) -> pd.DataFrame:
        own, others, pieces = columns(own), columns(others), []
        step = max(1, _TILE // max(len(x), 1))
        coded = [np.unique(tags, return_inverse=True) for tags in others]
        for lo in range(0, len(q), step):
            a = q[lo:lo + step]
            d = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * a @ x.T, 0.0))
            for j, (labels, code) in enumerate(coded):
                hot = np.zeros((len(x), len(labels)))
                hot[np.arange(len(x)), code] = 1.0
                m = len(labels)
                pieces.append(pd.DataFrame({
                    "id": np.repeat(ids[lo:lo + step], m), "labeling": np.int32(j), "own": np.repeat(own[j][lo:lo + step], m),
                    "cluster": np.tile(labels, len(a)), "n": np.tile(hot.sum(0).astype("int64"), len(a)),
                    "dist": (d @ hot).ravel()}))
        return pd.concat(pieces, ignore_index=True)

    names = [c for c in out_type.fieldNames() if labelings or c != "labeling"]
    if _small(rows, rows.withColumnRenamed("v", "__rvec"), min(max_rows, BROADCAST_ROWS)):
        table = rows.toPandas()
        shared = Shared(spark, (matrix(table["v"]), table["own"].tolist()))

        def stream(batches):
            for b in batches:
                yield sums(b["id"].to_numpy(), b.lists("own"), b["v"], *shared.value)

        return map_batches(rows, stream, out_type).select(*names)
    blocks = int(np.ceil(rows.count() / block_rows))
    placed = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    lhs = placed.withColumn("other", every)
    rhs = placed.withColumnRenamed("mine", "other").withColumn("mine", every)

    def grid(lpart, rpart):
        if not len(lpart) or not len(rpart):
            return pd.DataFrame(columns=out_type.fieldNames())
        return sums(lpart["id"].to_numpy(), lpart["own"], matrix(lpart["v"]), matrix(rpart["v"]), rpart["own"])

    keys = ["mine", "other"]
    partial = lhs.groupBy(*keys).cogroup(rhs.groupBy(*keys)).applyInPandas(grid, out_type)
    return partial.groupBy("id", "labeling", "own", "cluster").agg(
        F.sum("n").alias("n"), F.sum("dist").alias("dist")).select(*names)


def knn_regress(train: DataFrame, test: DataFrame, ks, vec: str, y: str, key: str, **kw) -> DataFrame:
    """(key, k, prediction): mean label of the k nearest training rows, for every k from one join."""
    ks = [ks] if isinstance(ks, int) else list(ks)
    near = knn_join(test, train, max(ks), vec, key, carry=[y], **kw)
    window = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    running = near.withColumn("prediction", F.avg(y).over(window))
    return running.filter(F.col("rank").isin(ks)).select(key, F.col("rank").alias("k"), "prediction")


def row_correlation_top(df: DataFrame, key: str, vec: str, k: int, **kw) -> DataFrame:
    """(key, neighbour, rank, r): the k rows most correlated with every row.

    Centred unit rows have squared distance 2 (1 - r), so this is the k-NN join.
    """
    from .stats import unit_rows

    rows = unit_rows(df, vec).filter(F.col("__u").isNotNull()).select(key, "__u")
    near = knn_join(rows, rows, k, "__u", key, exclude_same=key, **kw)
    return near.select(key, "neighbour", "rank", (1 - F.col("dist") * F.col("dist") / 2).alias("r"))
