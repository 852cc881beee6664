"""Models in sizes that have a closed form, so that SQL gives the same fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import cluster as cl
from ..operators import forecast as fc
from ..operators import images as im
from ..operators import linear as ln
from ..operators import trees as tr
from ..session import cut_lineage
from .models import IMAGES, VECS, images
from .registry import Tables, query
from .series import BY, DAILY, daily, split_daily
from .tabular import vectors

_TWO = """z AS (SELECT l_quantity AS u, l_discount * 100 AS v, l_extendedprice / 1000 AS y, l_orderkey % 2 AS f FROM lineitem)"""


def two_columns(t: Tables):
    return t.lineitem.select(F.array("l_quantity", F.col("l_discount") * 100).alias("x"),
                             (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_orderkey") % 2).cast("int").alias("f"))


def _row(t: Tables, schema: str, *values):
    return t.spark.createDataFrame([tuple(round(float(v), 6) + 0.0 for v in values)], schema)


@query("ridge_two", f"""WITH {_TWO}, s AS (SELECT count(*) * var_pop(u) + 1000 AS a, count(*) * var_pop(v) + 1000 AS b,
      count(*) * covar_pop(u, v) AS c, count(*) * covar_pop(u, y) AS p, count(*) * covar_pop(v, y) AS q,
      avg(u) AS mu, avg(v) AS mv, avg(y) AS my FROM z),
   w AS (SELECT (p * b - q * c) / (a * b - c * c) AS w1, (a * q - c * p) / (a * b - c * c) AS w2, mu, mv, my FROM s)
   SELECT round(w1, 6) AS w1, round(w2, 6) AS w2, round(my - w1 * mu - w2 * mv, 6) AS intercept FROM w""")
def _(t):
    fit = ln.ridge(two_columns(t), "x", "y", 1000.0).fit
    return _row(t, "w1 double, w2 double, intercept double", *fit.coef, fit.intercept)


@query("lasso_one", f"""WITH {_TWO}, w AS (SELECT sign(covar_pop(u, y)) * greatest(abs(covar_pop(u, y)) - 3, 0) / var_pop(u) AS w,
      avg(u) AS mu, avg(y) AS my FROM z) SELECT round(w, 6) AS w, round(my - w * mu, 6) AS intercept FROM w""")
def _(t):
    rows = two_columns(t).select(F.slice("x", 1, 1).alias("x"), "y")
    fit = ln.lasso(rows, "x", "y", 3.0).fit
    return _row(t, "w double, intercept double", fit.coef[0], fit.intercept)


_AXES = """a AS (SELECT *, (p + r) / 2 + sqrt((p - r) * (p - r) / 4 + q * q) AS l1, (p + r) / 2 - sqrt((p - r) * (p - r) / 4 + q * q) AS l2 FROM m),
   e AS (SELECT *, q / sqrt(q * q + (l1 - p) * (l1 - p)) AS c1, (l1 - p) / sqrt(q * q + (l1 - p) * (l1 - p)) AS c2 FROM a)"""


@query("pca_two", f"""WITH {_TWO}, m AS (SELECT var_samp(u) AS p, covar_samp(u, v) AS q, var_samp(v) AS r FROM z), {_AXES}
   SELECT round(l1, 6) AS l1, round(l2, 6) AS l2, round(abs(c1), 6) AS c1, round(abs(c2), 6) AS c2 FROM e""")
def _(t):
    fit = ln.pca(two_columns(t), "x", 2)
    return _row(t, "l1 double, l2 double, c1 double, c2 double", *fit.variances, *np.abs(fit.components[0]))


@query("select_pca_two", f"""WITH {_TWO}, m AS (SELECT f, var_samp(u) AS p, covar_samp(u, v) AS q, var_samp(v) AS r, avg(u) AS mu, avg(v) AS mv
      FROM z GROUP BY 1), {_AXES},
   h AS (SELECT e.*, (SELECT avg((u - mu) * (u - mu)) FROM z WHERE z.f <> e.f) AS su, (SELECT avg((v - mv) * (v - mv)) FROM z WHERE z.f <> e.f) AS sv,
      (SELECT avg((u - mu) * (v - mv)) FROM z WHERE z.f <> e.f) AS sc FROM e),
   g AS (SELECT *, c1 * c1 * su + 2 * c1 * c2 * sc + c2 * c2 * sv AS t1 FROM h),
   s AS (SELECT -0.5 * (2 * ln(2 * pi()) + 2 * ln((l1 + l2) / 2) + (su + sv) / ((l1 + l2) / 2)) AS k0,
      -0.5 * (2 * ln(2 * pi()) + ln(l1) + ln(l2) + t1 / l1 + (su + sv - t1) / l2) AS k1 FROM g)
   SELECT round(avg(k0), 6) AS k0, round(avg(k1), 6) AS k1 FROM s""")
def _(t):
    """The likelihood criterion for no axis and for one."""
    _, scores = ln.select_pca_k(two_columns(t), "x", [0, 1], "f")
    return _row(t, "k0 double, k1 double", scores[0], scores[1])


@query("gaussian_nb_predictions", f"""WITH {VECS}, x AS (SELECT vec_id, label, unnest(range(64)) AS pos, unnest(e) AS x FROM v),
   c AS MATERIALIZED (SELECT label AS k, pos, avg(x) AS m, var_pop(x) + 1e-9::DOUBLE * (SELECT max(s) FROM (SELECT var_pop(x) AS s FROM x GROUP BY pos)) AS s
      FROM x GROUP BY 1, 2), n AS (SELECT label AS k, ln(count(*) / (SELECT count(*) FROM v)::DOUBLE) AS prior FROM v GROUP BY 1),
   s AS (SELECT vec_id, k, prior - 0.5 * sum(ln(2 * pi() * s) + (x - m) * (x - m) / s) AS score FROM x JOIN c USING (pos) JOIN n USING (k)
      GROUP BY vec_id, k, prior)
   SELECT vec_id, CAST(arg_max(k, score) AS INT) AS prediction FROM s GROUP BY 1""")
def _(t):
    rows = vectors(t)
    out = cl.gaussian_nb(rows, "embedding", "label").transform(rows, "embedding")
    return out.select("vec_id", F.col("prediction").cast("int").alias("prediction"))


@query("boost_stump", """WITH z AS (SELECT l_quantity AS u, l_extendedprice / 1000 AS y FROM lineitem), b AS (SELECT avg(y) AS base FROM z),
   g AS (SELECT u, sum(base - y) AS g, count(*) AS n FROM z, b GROUP BY 1),
   s AS (SELECT u, sum(g) OVER (ORDER BY u) AS gl, sum(n) OVER (ORDER BY u) AS nl, sum(g) OVER () AS g, sum(n) OVER () AS n FROM g),
   best AS (SELECT * FROM s WHERE nl < n ORDER BY gl * gl / (nl + 1) + (g - gl) * (g - gl) / (n - nl + 1) DESC, u LIMIT 1)
   SELECT round(u, 6) AS cut, round(-gl / (nl + 1), 6) AS low, round(-(g - gl) / (n - nl + 1), 6) AS high FROM best""")
def _(t):
    """One boosted tree of one split: the cut of the largest gain and its leaves."""
    rows = t.lineitem.select(F.array("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    fit = tr.boost_reg(rows, "x", "y", [0.0], n_trees=1, depth=1, eta=1.0, l2=1.0, n_bins=127).fit
    tree = fit.trees[0]
    return _row(t, "cut double, low double, high double", fit.edges[0][tree.cut[0]], tree.value[1, 0], tree.value[2, 0])


@query("palette_codes", f"""WITH {IMAGES}, c AS (SELECT * FROM (VALUES (0, 20.0, 200.0, 90.0), (1, 128.0, 128.0, 128.0), (2, 220.0, 60.0, 150.0),
      (3, 90.0, 110.0, 250.0)) c(code, cr, cg, cb)),
   d AS (SELECT vec_id, pos, arg_min(code, (r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb)) AS code FROM px, c GROUP BY 1, 2)
   SELECT CAST(code AS INT) AS code, count(*) AS n FROM d GROUP BY 1""")
def _(t):
    """The colours of a given palette that all pixels get."""
    centres = np.array([[20.0, 200.0, 90.0], [128.0, 128.0, 128.0], [220.0, 60.0, 150.0], [90.0, 110.0, 250.0]])
    px = im.pixels(images(t), "vec_id", "data", 64)
    return cl.Palette(cl.KMeansFit(centres, 0.0)).codes(px).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("lag_forecast_one", f"""WITH {DAILY}, w AS (SELECT o_orderpriority, day, close AS y, lag(close) OVER (PARTITION BY o_orderpriority ORDER BY day) AS x FROM daily),
   f AS (SELECT o_orderpriority, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM w WHERE day < 20010101 GROUP BY 1)
   SELECT o_orderpriority, day, round(a * x + b, 3) AS prediction FROM w JOIN f USING (o_orderpriority) WHERE day >= 20010101 AND x IS NOT NULL""")
def _(t):
    out = fc.lag_forecast(cut_lineage(split_daily(t)), "close", 1, "day", "is_test", BY)
    return out.select(BY, "day", F.round("prediction", 3).alias("prediction"))


@query("arma_order_one", f"""WITH {DAILY}, w AS (SELECT o_orderpriority, x AS y, lag(x) OVER o AS x, row_number() OVER o AS i FROM daily
      WINDOW o AS (PARTITION BY o_orderpriority ORDER BY day)),
   s AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, var_pop(y) AS s0, var_pop(y) - covar_pop(y, x) * covar_pop(y, x) / var_pop(x) AS s1
      FROM w WHERE i > 21 GROUP BY 1),
   r AS (SELECT o_orderpriority, p, n, n * ln(CASE p WHEN 0 THEN s0 ELSE s1 END) AS base, p + 2 AS k FROM s, range(2) q(p))
   SELECT o_orderpriority, CAST(p AS INT) AS p, 0 AS q, round(base + 2 * k, 4) AS aic, round(base + k * ln(n), 4) AS bic,
      round(base + 2 * k * ln(ln(n)), 4) AS hqic FROM r""")
def _(t):
    scores = fc.arma_order(daily(t), "x", 1, 0, "day", BY)
    return scores.select(BY, "p", "q", *(F.round(c, 4).alias(c) for c in ("aic", "bic", "hqic")))
