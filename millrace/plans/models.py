"""Queries over vectors and images: neighbours, resampling, clustering, regression, classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cluster as cl
from ..operators import evaluate as ev
from ..operators import images as im
from ..operators import joins as jn
from ..operators import linear as ln
from ..operators import margin as mg
from ..operators import neighbours as nb
from ..operators import order as od
from ..operators import relational as rl
from ..operators import resample as rs
from ..operators import search as sh
from ..operators import stats as st
from ..operators import text as tx
from ..operators import trees as tr
from ..session import cut_lineage, new_path, stored
from ..sources import readers as rd
from . import posts
from .registry import Tables, query
from .tabular import FEATURES, ORDER, _round, imputed, vectors

VECS = "v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
_DIST = "sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
PAIRS = f"{VECS}, d AS MATERIALIZED (SELECT a.vec_id, b.vec_id AS neighbour, a.label, b.label AS other, {_DIST} AS dist FROM v a CROSS JOIN v b)"
NEAR = PAIRS + """, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) AS rank FROM d WHERE vec_id <> neighbour)"""


def images(t: Tables) -> DataFrame:
    """8 x 8 images in three planes from the whole vector: it, its reverse, its negative."""
    level = lambda x: F.floor((x + 1) * 127.5).cast("int")
    rows = vectors(t)
    planes = F.concat(F.transform("embedding", level), F.transform(F.reverse("embedding"), level),
                      F.transform("embedding", lambda x: level(-x)))
    return rows.select("vec_id", "label", planes.alias("data"))


IMAGES = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
im AS (SELECT vec_id, label, list_transform(e, lambda x: CAST(floor((x + 1) * 127.5) AS INT)) AS r,
   list_transform(list_reverse(e), lambda x: CAST(floor((x + 1) * 127.5) AS INT)) AS g,
   list_transform(e, lambda x: CAST(floor((-x + 1) * 127.5) AS INT)) AS b FROM e),
px AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(r) AS r, unnest(g) AS g, unnest(b) AS b FROM im)"""


def halves(t: Tables, folds: int = 5) -> DataFrame:
    """Vectors with three label columns, a 30 % test mark and contiguous folds, written once."""
    rows = vectors(t).withColumns({"mod5": F.col("label") % 5, "odd": F.col("label") % 2,
                                   "zero": (F.col("label") == 0).cast("int")})
    marked = od.hash_split(rows, "vec_id", 0.3, 1)
    return stored(od.contiguous_folds(marked, "vec_id", folds), "vec_id")


def table_vectors(t: Tables) -> DataFrame:
    """The imputed feature table as arrays, with three contiguous folds, written once."""
    rows = imputed(t).withColumn("price", F.col("price") / 1000)
    folded = od.contiguous_folds(rows.withColumn("x", F.array(*FEATURES)), ORDER, 3)
    return stored(folded.select("x", "price", "fold", *ORDER), *ORDER)


def _scores(out: DataFrame, y: str, p: str = "prediction") -> DataFrame:
    return ev.class_report(out, y, p)


# --- images -------------------------------------------------------------------------------


@query("scan_images", f"WITH {IMAGES} SELECT label AS labels, count(*) AS n, CAST(sum(list_sum(r) + list_sum(g) + list_sum(b)) AS BIGINT) AS total FROM im GROUP BY 1")
def _(t):
    path = new_path(t.spark, "batches")
    images(t).select(F.col("label").alias("labels"), "data").repartition(5).write.parquet(path)
    back = rd.read_images(t.spark, f"{path}/*.parquet")
    total = F.aggregate("data", F.lit(0), lambda s, x: s + x)
    return back.groupBy("labels").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"))


@query("pixels", f"WITH {IMAGES} SELECT vec_id, CAST(pos AS INT) AS pos, r, g, b FROM px")
def _(t):
    return im.pixels(im.check_planar(images(t), "data", 192), "vec_id", "data", 64)


@query("grayscale", f"WITH {IMAGES} SELECT vec_id, CAST(pos AS INT) AS pos, round(0.2989::DOUBLE * r + 0.5870::DOUBLE * g + 0.1140::DOUBLE * b, 5) AS gray FROM px")
def _(t):
    return im.grayscale(images(t), "data", 64).select("vec_id", F.posexplode("gray").alias("pos", "gray")).withColumn(
        "gray", F.round("gray", 5))


@query("scale_blocks", f"""WITH {IMAGES}, a AS (SELECT vec_id, unnest(range(192)) AS i, unnest(list_concat(list_concat(r, g), b)) AS x FROM im)
   SELECT vec_id, CAST(i // 64 AS INT) AS block, CAST(i % 64 AS INT) AS pos, round(x / 255.0, 6) AS x FROM a""")
def _(t):
    blocks = im.scale_blocks(images(t), "vec_id", "data", 255.0, 64)
    return blocks.select("vec_id", "block", F.posexplode("values").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("inject_noise", f"""WITH {IMAGES}, k AS (SELECT vec_id, r.i AS i,
      ('0x' || substr(md5(vec_id || ':' || r.i || ':at:7'), 1, 8))::BIGINT % 64 AS pos,
      ('0x' || substr(md5(vec_id || ':' || r.i || ':lv:7'), 1, 8))::BIGINT % 4 AS lv FROM im, range(10) r(i)),
   d AS (SELECT vec_id, pos, [0, 255, 96, 144][arg_min(lv, i) + 1] AS level FROM k GROUP BY 1, 2)
   SELECT vec_id, CAST(sum((r <> level)::INT + (g <> level)::INT + (b <> level)::INT) AS INT) AS changed
   FROM px JOIN d USING (vec_id, pos) GROUP BY 1""")
def _(t):
    noisy = im.inject_noise(images(t), "vec_id", "data", 64, seed=7, out="noisy")
    changed = F.size(F.filter(F.zip_with("data", "noisy", lambda a, b: a.cast("double") != b), lambda x: x))
    return noisy.select("vec_id", changed.alias("changed"))


@query("palette")
def _(t):
    px = im.pixels(images(t), "vec_id", "data", 64)
    return cl.palette(px, 4).codes(px).groupBy("code").count()


@query("colorize")
def _(t):
    marked = od.hash_split(images(t), "vec_id", 0.3, 1)
    return ev.accuracy(im.colorize(marked, "vec_id", "data", 8, test="is_test"), "code", "prediction", "is_test")


# --- neighbours and resampling --------------------------------------------------------------


@query("knn_join", f"WITH {NEAR} SELECT vec_id, neighbour, CAST(rank AS INT) AS rank, round(dist, 6) AS dist FROM r WHERE rank <= 5")
def _(t):
    return _round(nb.knn_join(vectors(t), vectors(t), 5, "embedding", "vec_id", exclude_same="vec_id"), "dist")


@query("knn_join_cells", f"WITH {NEAR} SELECT vec_id, neighbour, CAST(rank AS INT) AS rank, round(dist, 6) AS dist FROM r WHERE rank <= 5")
def _(t):
    out = nb.knn_join(vectors(t), vectors(t), 5, "embedding", "vec_id", exclude_same="vec_id", max_rows=0, block_rows=400)
    return _round(out, "dist").select("vec_id", "neighbour", "rank", "dist")


@query("knn_join_approx")
def _(t):
    out = nb.knn_join(vectors(t), vectors(t), 5, "embedding", "vec_id", exclude_same="vec_id", approx=True, block_rows=400)
    return out.select("vec_id", "neighbour", "rank", "dist")


@query("row_correlation_top", f"""WITH {VECS}, c AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x - list_avg(e)) AS u FROM v),
   z AS MATERIALIZED (SELECT vec_id, list_transform(u, lambda x: x / sqrt(list_inner_product(u, u))) AS u FROM c),
   p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_inner_product(a.u, b.u) AS r FROM z a CROSS JOIN z b WHERE a.vec_id <> b.vec_id),
   k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, neighbour) AS rank FROM p)
   SELECT vec_id, neighbour, CAST(rank AS INT) AS rank, round(r, 6) AS r FROM k WHERE rank <= 3""")
def _(t):
    return _round(nb.row_correlation_top(vectors(t), "vec_id", "embedding", 3), "r")


_SPLIT = "CAST(substr(md5(CAST(vec_id AS VARCHAR) || ':' || '1'), 1, 8) < '4ccccccc' AS INT)"


@query("knn_recall", "SELECT 5 AS k, CAST(5 * count(*) AS BIGINT) AS wanted, true AS recalled FROM embeddings")
def _(t):
    """Whether the approximate join finds nine of ten exact neighbours."""
    rows = vectors(t)
    exact = nb.knn_join(rows, rows, 5, "embedding", "vec_id", exclude_same="vec_id").select("vec_id", "neighbour")
    near = nb.knn_join(rows, rows, 5, "embedding", "vec_id", exclude_same="vec_id", approx=True).select("vec_id", "neighbour")
    counts = exact.join(near.withColumn("hit", F.lit(1)), ["vec_id", "neighbour"], "left").agg(
        F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("hits"))
    return counts.select(F.lit(5).alias("k"), "wanted", (F.col("hits") >= 0.9 * F.col("wanted")).alias("recalled"))


@query("row_correlation", """WITH x AS (SELECT vec_id, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
   c AS (SELECT * FROM x WHERE vec_id IN (5, 50, 123))
   SELECT x.vec_id AS id1, c.vec_id AS id2, round(corr(x.x, c.x), 6) AS r FROM x JOIN c ON x.pos = c.pos GROUP BY 1, 2""")
def _(t):
    return _round(st.row_correlation(vectors(t), "vec_id", "embedding", [5, 50, 123]), "r")


@query("knn_regress", f"""WITH {VECS}, s AS MATERIALIZED (SELECT *, {_SPLIT} AS is_test FROM v), d AS (SELECT a.vec_id, b.label,
   row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rank FROM s a JOIN s b ON a.is_test = 1 AND b.is_test = 0)
   SELECT vec_id, CAST(k AS INT) AS k, round(avg(label), 6) AS prediction FROM d JOIN (SELECT unnest(range(5, 31)) AS k) g ON rank <= k GROUP BY 1, 2""")
def _(t):
    rows = od.hash_split(vectors(t), "vec_id", 0.3, 1)
    out = nb.knn_regress(rows.filter("is_test = 0"), rows.filter("is_test = 1"), range(5, 31), "embedding", "label", "vec_id")
    return _round(out, "prediction")


@query("knn_regress_search")
def _(t):
    """R2 per k over five folds, from one join that bars neighbours of the same fold."""
    rows = halves(t)
    out = nb.knn_regress(rows, rows, range(5, 31), "embedding", "label", "vec_id", exclude_same="fold")
    scored = out.join(rows.select("vec_id", "fold", "label"), "vec_id")
    per_fold = ev.r2(scored, "label", "prediction", ["k", "fold"])
    return rl.best_param(per_fold.groupBy(F.col("k").alias("param")).agg(F.avg("r2").alias("score")))


@query("smote", """WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
   SELECT label, (SELECT max(n) FROM n) AS rows, CAST((SELECT max(n) FROM n) - n AS BIGINT) AS made FROM n""")
def _(t):
    out = rs.smote(vectors(t), "vec_id", "embedding", "label", 5, seed=3)
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum("synthetic").alias("made"))


# --- clustering -----------------------------------------------------------------------------

# Two fixed centres: the constant vectors at +0.02 and -0.02 in every place.
CENTRES = [[0.02] * 64, [-0.02] * 64]
_SIDE = "CASE WHEN list_sum(list_transform(e, lambda x: (0.02 - x) * (0.02 - x))) <= list_sum(list_transform(e, lambda x: (-0.02 - x) * (-0.02 - x))) THEN 0 ELSE 1 END"


@query("assign_centres", f"WITH {VECS} SELECT vec_id, {_SIDE} AS cluster FROM v")
def _(t):
    return cl.assign(vectors(t), "embedding", CENTRES).select("vec_id", "cluster")


@query("lloyd_step", f"""WITH {VECS}, a AS (SELECT {_SIDE} AS cluster, unnest(range(64)) AS pos, unnest(e) AS x FROM v)
   SELECT cluster, CAST(pos AS INT) AS pos, count(*) AS n, round(avg(x), 6) AS mean FROM a GROUP BY 1, 2""")
def _(t):
    return _round(cl.lloyd_step(vectors(t), "embedding", CENTRES), "mean")


@query("silhouette", f"""WITH {PAIRS}, m AS (SELECT vec_id, label, other, sum(dist) AS s, count(*) AS n FROM d GROUP BY 1, 2, 3),
   ab AS (SELECT vec_id, max(s / (n - 1)) FILTER (label = other) AS a, min(s / n) FILTER (label <> other) AS b FROM m GROUP BY 1)
   SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab""")
def _(t):
    return _round(ev.silhouette(vectors(t), "vec_id", "embedding", "label"), "silhouette")


@query("silhouette_squared", f"""WITH {PAIRS}, m AS (SELECT vec_id, label, other, sum(dist * dist) AS s, count(*) AS n FROM d GROUP BY 1, 2, 3),
   ab AS (SELECT vec_id, max(s / (n - 1)) FILTER (label = other) AS a, min(s / n) FILTER (label <> other) AS b FROM m GROUP BY 1)
   SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab""")
def _(t):
    return _round(ev.silhouette(vectors(t), "vec_id", "embedding", "label", "squared"), "silhouette")


_CELLS = f"""{VECS}, x AS (SELECT label, unnest(range(64)) AS pos, unnest(e) AS x FROM v), c AS (SELECT label, pos, count(*) AS n,
   avg(x) AS m, var_pop(x) * count(*) AS ss FROM x GROUP BY 1, 2)"""


@query("inertia", f"WITH {_CELLS} SELECT round(sum(ss), 6) AS inertia FROM c")
def _(t):
    return _round(ev.inertia(vectors(t), "embedding", "label"), "inertia")


@query("calinski_harabasz", f"""WITH {_CELLS}, g AS (SELECT pos, avg(x) AS m, count(*) AS n FROM x GROUP BY 1), k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM v)
   SELECT round((SELECT sum(c.n * (c.m - g.m) * (c.m - g.m)) FROM c JOIN g USING (pos)) / ((SELECT k FROM k) - 1)
     / ((SELECT sum(ss) FROM c) / ((SELECT n FROM k) - (SELECT k FROM k))), 6) AS calinski_harabasz""")
def _(t):
    return _round(ev.calinski_harabasz(vectors(t), "embedding", "label"), "calinski_harabasz")


@query("kmeans")
def _(t):
    rows = cut_lineage(vectors(t))
    fit = cl.kmeans(rows, "embedding", 4, seed=1)
    return ev.majority_hamming(fit.transform(rows, "embedding").withColumns(
        {"mod5": F.col("label") % 5, "odd": F.col("label") % 2}), "cluster", ["label", "mod5", "odd"])


@query("kmeans_sweep")
def _(t):
    return cl.kmeans_sweep(vectors(t), "vec_id", "embedding", range(2, 50), seed=1)


@query("silhouette_grid", f"""WITH {VECS}, l AS MATERIALIZED (SELECT vec_id, e, j AS labeling,
      CASE j WHEN 0 THEN label WHEN 1 THEN label % 5 ELSE label % 2 END AS c FROM v, range(3) r(j)),
   d AS (SELECT a.vec_id, a.labeling, a.c, b.c AS other, {_DIST} AS dist FROM l a JOIN l b ON a.labeling = b.labeling),
   m AS (SELECT vec_id, labeling, c, other, sum(dist) AS s, count(*) AS n FROM d GROUP BY 1, 2, 3, 4),
   ab AS (SELECT vec_id, labeling, max(s / (n - 1)) FILTER (c = other) AS a, min(s / n) FILTER (c <> other) AS b FROM m GROUP BY 1, 2)
   SELECT CAST(labeling AS INT) AS labeling, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab GROUP BY 1""")
def _(t):
    """Three clusterings scored on one computation of the distances."""
    rows = vectors(t).withColumn("tags", F.array("label", F.col("label") % 5, F.col("label") % 2))
    found = ev.silhouettes(rows, "vec_id", "embedding", "tags", 3)
    return t.spark.createDataFrame([(j, round(v, 6)) for j, v in enumerate(found)], "labeling int, silhouette double")


@query("kmeans_repeat")
def _(t):
    """Mean and deviation of the cluster Hamming distance over repeated seeded runs."""
    rows = vectors(t).withColumns({"mod5": F.col("label") % 5, "odd": F.col("label") % 2})
    placed = cl.kmeans_runs(rows, "embedding", 4, seeds=range(50))
    far = ev.majority_hamming(placed.withColumn("place", F.col("run") * 4 + F.col("cluster")), "place", ["label", "mod5", "odd"])
    return st.repeat_stats(far.withColumn("cluster", F.col("place") % 4), "cluster", "distance")


# --- regression ------------------------------------------------------------------------------


@query("ols_simple", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def _(t):
    fit = ln.ols(t.lineitem.select(F.array("l_quantity").alias("x"), "l_extendedprice"), "x", "l_extendedprice")
    return t.spark.createDataFrame([(round(float(fit.coef[0]), 4), round(fit.intercept, 3))], "slope double, intercept double")


@query("ols")
def _(t):
    rows = table_vectors(t)
    head, tail = rows.filter("fold < 2"), rows.filter("fold = 2")
    return ev.mse(ln.ols(head, "x", "price").predict(tail, "x"), "price", "prediction")


def _regression(t, fitter):
    rows = table_vectors(t)
    result = fitter(rows.filter("fold < 2"))
    fit = result.fit if hasattr(result, "fit") else result
    return ev.mse(fit.predict(rows.filter("fold = 2"), "x"), "price", "prediction")


@query("ridge")
def _(t):
    return _regression(t, lambda rows: ln.ridge(rows, "x", "price", fold="fold"))


@query("lasso")
def _(t):
    return _regression(t, lambda rows: ln.lasso(rows, "x", "price", fold="fold"))


@query("pcr")
def _(t):
    return _regression(t, lambda rows: ln.pcr(rows, "x", "price", [1, 2, 3], "fold"))


@query("pca")
def _(t):
    fit = ln.pca(vectors(t), "embedding", 3)
    cells = fit.transform(vectors(t), "embedding").select(F.posexplode("scores").alias("axis", "x"))
    return cells.groupBy("axis").agg(F.var_samp("x").alias("variance"))


@query("select_pca_k")
def _(t):
    best, scores = ln.select_pca_k(halves(t), "embedding", range(0, 64), "fold")
    return t.spark.createDataFrame([(k, s, k == best) for k, s in scores.items()], "k int, score double, best boolean")


@query("boost_reg")
def _(t):
    rows = table_vectors(t)
    head = stored(od.contiguous_folds(rows.filter("fold < 2").drop("fold"), ORDER, 5), *ORDER)
    found = tr.boost_reg(head, "x", "price", fold="fold", n_trees=100)
    return ev.mse(found.fit.transform(rows.filter("fold = 2"), "x"), "price", "prediction")


@query("rf_reg")
def _(t):
    rows = halves(t)
    out = tr.rf_reg(rows.filter("is_test = 0"), "embedding", "odd").transform(rows.filter("is_test = 1"), "embedding")
    return _scores(rl.binarize(out, "prediction", 0.5, absolute=True), "odd", "hit")


@query("extra_trees_reg")
def _(t):
    rows = halves(t)
    out = tr.extra_trees_reg(rows.filter("is_test = 0"), "embedding", "odd").transform(rows.filter("is_test = 1"), "embedding")
    return _scores(rl.binarize(out, "prediction", 0.5, absolute=True), "odd", "hit")


@query("gbt_reg")
def _(t):
    rows = halves(t)
    out = tr.gbt_reg(rows.filter("is_test = 0"), "embedding", "odd", n_trees=100).transform(rows.filter("is_test = 1"), "embedding")
    return _scores(rl.binarize(out, "prediction", 0.5, absolute=True), "odd", "hit")


@query("rbf_svr")
def _(t):
    rows = halves(t)
    found = mg.rbf_svr(rows.filter("is_test = 0"), "embedding", "odd", fold="fold", n_features=256)
    out = found.transform(rows.filter("is_test = 1"), "embedding")
    return _scores(rl.binarize(out, "prediction", 0.5, absolute=True), "odd", "hit")


# --- classification ----------------------------------------------------------------------------


@query("class_moments", f"""WITH {VECS}, x AS (SELECT label, unnest(range(64)) AS pos, unnest(e) AS x FROM v)
   SELECT label AS class, CAST(pos AS INT) AS pos, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM x GROUP BY 1, 2""")
def _(t):
    return _round(cl.class_moments(vectors(t), "embedding", "label"), ["mean", "var"])


def _classified(t, y, fitter, folds=5):
    rows = halves(t, folds)
    result = fitter(rows.filter("is_test = 0"))
    fit = result.fit if isinstance(result, (mg.SearchResult, tr.BoostResult)) else result
    return _scores(fit.transform(rows.filter("is_test = 1"), "embedding"), y)


@query("gaussian_nb")
def _(t):
    return _classified(t, "label", lambda rows: cl.gaussian_nb(rows, "embedding", "label"))


@query("logistic")
def _(t):
    return _classified(t, "odd", lambda rows: mg.logistic(rows, "embedding", "odd", fold="fold"))


@query("linear_svm_l1")
def _(t):
    return _classified(t, "label", lambda rows: mg.linear_svm_l1(rows, "embedding", "label", (0.5, 1.0, 1.5), "fold"))


@query("rbf_svm")
def _(t):
    return _classified(t, "mod5", lambda rows: mg.rbf_svm(rows, "embedding", "mod5", mg.C_GRID, mg.GAMMA_GRID, "fold", 256),
                       folds=10)


@query("classifier_chain")
def _(t):
    rows = halves(t)
    chain = mg.classifier_chain(rows.filter("is_test = 0"), "embedding", ["odd", "mod5", "label"], n_features=256)
    out = chain.transform(rows.filter("is_test = 1"), "embedding")
    return ev.hamming_loss(out, ["odd", "mod5", "label"], ["p_odd", "p_mod5", "p_label"])


@query("rf_clf")
def _(t):
    return _classified(t, "label", lambda rows: tr.rf_clf(rows, "embedding", "label"))


@query("rf_clf_balanced")
def _(t):
    return _classified(t, "zero", lambda rows: tr.rf_clf(st.balanced_weights(rows, "zero"), "embedding", "zero", "weight"))


@query("extra_trees_clf")
def _(t):
    return _classified(t, "label", lambda rows: tr.extra_trees_clf(rows, "embedding", "label"))


@query("gbt_clf")
def _(t):
    return _classified(t, "odd", lambda rows: tr.gbt_clf(rows, "embedding", "odd", n_trees=100))


@query("boost_clf_folds")
def _(t):
    """Accuracy and AUC of hard predictions per held-out fold; a one-class fold has a null AUC."""
    rows = halves(t, 10)
    return _held_out(rows, tr.boost_folds(rows, "embedding", "zero", "fold", n_trees=10, depth=6))


def _held_out(rows: DataFrame, fits: dict) -> DataFrame:
    out = None
    for fold, fit in fits.items():
        part = fit.transform(rows.filter(F.col("fold") == fold), "embedding")
        out = part if out is None else out.unionByName(part)
    return ev.accuracy(out, "zero", "prediction", "fold").join(ev.auc_hard(out, "zero", "prediction", "fold"), "fold")


@query("boost_smote_folds")
def _(t):
    """The same scores with the minority class resampled inside every training part."""
    rows = halves(t, 10)
    made = rs.smote_folds(rows, "vec_id", "embedding", "zero", "fold", 5, seed=3)
    fits = tr.boost_folds(made, "embedding", "zero", "trains", n_trees=10, depth=6, own_rows=True)
    return _held_out(rows, fits)


@query("boost_smote_before_folds")
def _(t):
    """The same scores with resampling before the folds are cut: synthetic rows leak, as the scores show."""
    made = cut_lineage(rs.smote(halves(t), "vec_id", "embedding", "zero", 5, seed=3))
    rows = stored(od.contiguous_folds(made, ["synthetic", "vec_id", "embedding"], 10), "vec_id")
    return _held_out(rows, tr.boost_folds(rows, "embedding", "zero", "fold", n_trees=10, depth=6))


@query("linear_svm_l1_smote")
def _(t):
    """The L1 linear classifier searched and fitted on resampled training rows; each class is dealt over ten folds."""
    def fit(rows):
        made = cut_lineage(rs.smote(rows, "vec_id", "embedding", "mod5", 5, seed=3))
        dealt = od.with_position(made, ["synthetic", "vec_id", "embedding"], "mod5", "__at")
        folded = stored(dealt.withColumn("fold", F.pmod("__at", F.lit(10)).cast("int")).drop("__at"), "vec_id")
        return mg.linear_svm_l1(folded, "embedding", "mod5", mg.C_GRID, "fold")

    return _classified(t, "mod5", fit)


# --- from posts to a forecast of the direction ---------------------------------------------------


def post_vectors(t: Tables) -> DataFrame:
    """(doc_id, day, vec, up_3, up_5, part): the selected tf-idf values of the posts and the labels
    of their day, the first 70 % of the posts marked as training rows."""
    rows = posts.clean(t, passes=2)
    words = posts.vocab(t, rows)
    scores = tx.chisq_words(rows, "doc_id", "clean", words, tx.tf(rows, "doc_id", "clean", words))
    vecs = tx.select_top(rows, "doc_id", "clean", words, scores, 100).join(rows.select("doc_id", "day"), "doc_id")
    table = posts.labelled(t).filter(F.col("rt_5").isNotNull()).select("day", "close", "up_3", "up_5")
    joined = cut_lineage(jn.attach_labels(vecs, table, "close").drop("close"))
    head, tail = od.positional_split(joined, ["day", "doc_id"], frac=0.7)
    return stored(head.withColumn("is_test", F.lit(0)).unionByName(tail.withColumn("is_test", F.lit(1))), "doc_id")


@query("post_direction")
def _(t):
    """Scores on the training and held-out posts of eleven models for the direction of the price.

    The penalties and the number of neighbours are searched on the five-day label over five folds. Bayes, logistic and
    L1 linear models also get the three-day label, the last two with the C found for the five-day one.
    """
    rows = post_vectors(t)
    train = stored(od.contiguous_folds(rows.filter("is_test = 0"), ["day", "doc_id"], 5), "doc_id")
    logistic = mg.logistic(train, "vec", "up_5", mg.C_GRID, "fold")
    svm = mg.linear_svm_l1(train, "vec", "up_5", mg.C_GRID_SMALL, "fold")
    fits = [("up_3", "gaussian_nb", cl.gaussian_nb(train, "vec", "up_3")),
            ("up_5", "gaussian_nb", cl.gaussian_nb(train, "vec", "up_5")),
            ("up_3", "logistic", mg.logistic(train, "vec", "up_3", logistic.best).fit), ("up_5", "logistic", logistic.fit),
            ("up_3", "linear_svm_l1", mg.linear_svm_l1(train, "vec", "up_3", svm.best).fit),
            ("up_5", "linear_svm_l1", svm.fit),
            ("up_5", "rf_clf", tr.rf_clf(train, "vec", "up_5")),
            ("up_5", "extra_trees_clf", tr.extra_trees_clf(train, "vec", "up_5")),
            ("up_5", "gbt_clf", tr.gbt_clf(train, "vec", "up_5"))]
    regressions = [("rbf_svr", mg.rbf_svr(train, "vec", "up_5", mg.C_GRID_SMALL, fold="fold")),
                   ("rf_reg", tr.rf_reg(train, "vec", "up_5")), ("extra_trees_reg", tr.extra_trees_reg(train, "vec", "up_5")),
                   ("gbt_reg", tr.gbt_reg(train, "vec", "up_5"))]

    def sides(done, label, name, hit):
        return done.select(F.lit(label).alias("label"), F.lit(name).alias("model"), "is_test",
                           F.col(label).alias("y"), F.col(hit).alias("p"))

    parts = [sides(fit.transform(rows, "vec"), label, name, "prediction") for label, name, fit in fits]
    parts += [sides(rl.binarize(fit.transform(rows, "vec"), "prediction", 0.5, absolute=True), "up_5", name, "hit")
              for name, fit in regressions]
    near = nb.knn_regress(train, train, range(5, 31), "vec", "up_5", "doc_id", exclude_same="fold")
    per_fold = ev.r2(near.join(train.select("doc_id", "fold", "up_5"), "doc_id"), "up_5", "prediction", ["k", "fold"])
    k = rl.best_param(per_fold.groupBy(F.col("k").alias("param")).agg(F.avg("r2").alias("score"))).first()["param"]
    means = nb.knn_regress(train, rows, k, "vec", "up_5", "doc_id").select("doc_id", "prediction")
    parts.append(sides(rl.binarize(rows.join(means, "doc_id"), "prediction", 0.5, absolute=True), "up_5", "knn_regress", "hit"))
    done = cut_lineage(reduce(DataFrame.unionByName, parts))
    by = ["label", "model", "is_test"]
    cell = lambda y, p: F.count_if((F.col("y") == y) & (F.col("p") == p))
    cells = done.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    return cells.join(ev.accuracy(done, "y", "p", by), by).join(ev.auc_hard(done, "y", "p", by), by).join(
        ev.binary_scores(done, "y", "p", by), by)


class SmoothedMean:
    """Predicts the mean of a group, drawn towards the mean of all by `weight` rows."""

    def __init__(self, rows: DataFrame, group: str, y: str, weight: float):
        mean = rows.agg(F.avg(y)).first()[0]
        self.group, self.default = group, mean
        self.table = rows.groupBy(group).agg(((F.sum(y) + weight * mean) / (F.count(y) + weight)).alias("prediction"))

    def transform(self, rows: DataFrame) -> DataFrame:
        return jn.lookup_join(rows, self.table, self.group, "left").fillna(self.default, ["prediction"])


@query("grid_search", """WITH b AS (SELECT l_suppkey AS g, l_extendedprice / 1000 AS y, CAST(l_orderkey % 3 AS INT) AS fold FROM lineitem),
   h AS (SELECT unnest(range(3)) AS held), w AS (SELECT unnest([1.0, 10.0, 1000.0])::DOUBLE AS weight),
   o AS (SELECT held, avg(y) AS m FROM b JOIN h ON fold <> held GROUP BY held),
   s AS (SELECT held, g, sum(y) AS s, count(*) AS n FROM b JOIN h ON fold <> held GROUP BY ALL),
   e AS (SELECT weight, held, avg((y - CASE WHEN n IS NULL THEN m ELSE (s + weight * m) / (n + weight) END) ** 2) AS mse
         FROM b JOIN o ON b.fold = o.held LEFT JOIN s USING (held, g) CROSS JOIN w GROUP BY ALL),
   a AS (SELECT weight, avg(mse) AS score FROM e GROUP BY weight)
   SELECT weight, round(score, 6) AS score, score = min(score) OVER () AS best FROM a""")
def _(t):
    rows = t.lineitem.select("l_suppkey", (F.col("l_extendedprice") / 1000).alias("y"),
                             F.pmod("l_orderkey", F.lit(3)).cast("int").alias("fold"))
    found = sh.grid_search(rows, lambda part, weight: SmoothedMean(part, "l_suppkey", "y", weight),
                           [{"weight": w} for w in (1.0, 10.0, 1000.0)], lambda part: ev.mse(part, "y", "prediction"), "fold")
    table = [(p["weight"], round(score, 6), p == found.best) for p, score, _ in found.scores]
    return t.spark.createDataFrame(table, "weight double, score double, best boolean")
