"""Models and forecasts against plain numpy on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cluster as cl
from millrace.operators import evaluate as ev
from millrace.operators import forecast as fc
from millrace.operators import images as im
from millrace.operators import linear as ln
from millrace.operators import margin as mg
from millrace.operators import order as od
from millrace.operators import stats as st
from millrace.operators import trees as tr


@pytest.fixture(scope="module")
def reg(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 5)) * [1, 2, 0.5, 1, 3] + 100
    y = x @ [1.0, -2, 0, 0.5, 0] + 3 + rng.normal(size=240)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(240)],
                               "id long, x array<double>, y double").repartition(6)
    return od.contiguous_folds(df, "id", 3).cache(), x, y


def test_ols(reg):
    df, x, y = reg
    fit = ln.ols(df, "x", "y")
    want = np.linalg.lstsq(np.c_[x, np.ones(240)], y, rcond=None)[0]
    assert np.allclose(np.r_[fit.coef, fit.intercept], want, atol=1e-7)
    got = {r["id"]: r["prediction"] for r in fit.predict(df, "x").collect()}
    assert np.allclose([got[i] for i in range(240)], x @ want[:-1] + want[-1], atol=1e-7)


def _ridge(x, y, a):
    m, c = x.mean(0), y.mean()
    w = np.linalg.solve((x - m).T @ (x - m) + a * np.eye(x.shape[1]), (x - m).T @ (y - c))
    return w, c - m @ w


def test_ridge_grid(reg):
    df, x, y = reg
    found = ln.ridge(df, "x", "y", [0.01, 1.0, 50.0], "fold")
    fold = np.arange(240) // 80
    for a, got in found.scores.items():
        r2 = []
        for f in range(3):
            w, b = _ridge(x[fold != f], y[fold != f], a)
            t = y[fold == f]
            r2.append(1 - ((t - x[fold == f] @ w - b) ** 2).sum() / ((t - t.mean()) ** 2).sum())
        assert abs(got - np.mean(r2)) < 1e-8
    assert found.best == max(found.scores, key=found.scores.get)
    assert np.allclose(found.fit.coef, _ridge(x, y, found.best)[0], atol=1e-8)


def test_penalties_match_spark(reg):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    df, x, y = reg
    rows = df.withColumn("f", array_to_vector("x"))
    base = dict(featuresCol="f", labelCol="y", standardization=False, tol=1e-12, maxIter=2000)
    ridge = LinearRegression(elasticNetParam=0.0, regParam=3.0 * y.std() / 240, solver="normal", **base).fit(rows)
    assert np.allclose(ridge.coefficients, ln.ridge(df, "x", "y", 3.0).fit.coef, atol=1e-6)
    lasso = LinearRegression(elasticNetParam=1.0, regParam=0.2, **base).fit(rows)
    assert np.allclose(lasso.coefficients, ln.lasso(df, "x", "y", 0.2).fit.coef, atol=1e-6)


def test_lasso_optimal(reg):
    df, x, y = reg
    fit = ln.lasso(df, "x", "y", 0.3).fit
    grad = (x - x.mean(0)).T @ (y - x @ fit.coef - fit.intercept) / 240
    assert np.allclose(grad[fit.coef != 0], 0.3 * np.sign(fit.coef[fit.coef != 0]), atol=1e-7)
    assert (np.abs(grad[fit.coef == 0]) <= 0.3 + 1e-9).all()


def test_pca_and_likelihood(reg):
    df, x, _ = reg
    fit = ln.pca(df, "x", 2)
    c = x - x.mean(0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(fit.variances, s[:2] ** 2 / 239)
    assert np.allclose(np.abs(fit.components), np.abs(v[:2]), atol=1e-8)
    got = {r["id"]: r["scores"] for r in fit.transform(df, "x").collect()}
    assert np.allclose(np.abs(np.array([got[i] for i in range(240)])), np.abs(c @ v[:2].T), atol=1e-7)
    best, scores = ln.select_pca_k(df, "x", range(6), "fold")
    fold = np.arange(240) // 80
    for k in (0, 2, 5):
        ll = []
        for f in range(3):
            a, b = x[fold != f], x[fold == f]
            values, vec = np.linalg.eigh(np.cov(a.T))
            values, vec = values[::-1], vec[:, ::-1]
            noise = values[k:].mean() if k < 5 else 0
            cov = vec[:, :k] @ np.diag(values[:k] - noise) @ vec[:, :k].T + noise * np.eye(5)
            d = b - a.mean(0)
            ll.append(-0.5 * (5 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d).mean()))
        assert abs(scores[k] - np.mean(ll)) < 1e-7
    assert best == max(scores, key=scores.get)


def test_pcr(reg):
    df, x, y = reg
    fit = ln.pcr(df, "x", "y", [5], "fold", [1e-6])
    err = ev.mse(fit.predict(df, "x"), "y", "prediction").first()[0]
    want = np.linalg.lstsq(np.c_[x, np.ones(240)], y, rcond=None)[1][0] / 240
    assert abs(err - want) < 1e-4


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[2, 0, 0, 1], [0, 2, 0, -1], [0, 0, 2, 0]])
    y = np.arange(240) % 3
    x = centres[y] + rng.normal(scale=0.7, size=(240, 4))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(y[i]), int(y[i] == 0), float((x[i] ** 2).sum()))
                                for i in range(240)], "id long, x array<double>, y int, first int, size double").repartition(5)
    return od.hash_split(od.contiguous_folds(df, "id", 4), "id", 0.3, 2).cache(), x, y


def test_logistic_optimal(blobs):
    df, x, y = blobs
    found = mg.logistic(df, "x", "first", [2.0])
    w = found.fit.weights[0]
    t = np.where(y == 0, 1, -1)
    f = x @ w[:-1] + w[-1]
    slope = -t / (1 + np.exp(t * f))
    assert np.allclose(w[:-1] + 2 * slope @ x, 0, atol=1e-4)
    assert abs(2 * slope.sum()) < 1e-4


def test_logistic_search(blobs):
    df, _, _ = blobs
    found = mg.logistic(df, "x", "first", [0.1, 1.0, 9.0], "fold")
    assert set(found.scores) == {0.1, 1.0, 9.0} and min(found.scores.values()) > 0.85
    out = found.fit.transform(df, "x")
    assert ev.accuracy(out, "first", "prediction").first()[0] > 0.85


def test_svm_l1_optimal(blobs):
    df, x, y = blobs
    found = mg.linear_svm_l1(df, "x", "y", [0.05])
    z = np.c_[x, np.ones(240)]
    for c, w in zip(found.fit.classes, found.fit.weights):
        t = np.where(y == c, 1, -1)
        grad = 0.05 * (-2 * t * np.maximum(1 - t * (z @ w), 0)) @ z
        live = np.abs(w) > 1e-6
        assert np.allclose(grad[live], -np.sign(w[live]), atol=1e-3)
        assert (np.abs(grad[~live]) <= 1 + 1e-3).all()
    assert ev.accuracy(found.fit.transform(df, "x"), "y", "prediction").first()[0] > 0.85


def test_random_features_error_falls(blobs):
    df, x, _ = blobs
    want = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(2))
    errors = []
    for n in (16, 256, 4096):
        got = {r["id"]: r["rff"] for r in mg.random_features(df, "x", 0.2, n, 1).select("id", "rff").collect()}
        z = np.array([got[i] for i in range(240)])
        errors.append(np.abs(z @ z.T - want).mean())
    assert errors[0] > errors[1] > errors[2] and errors[2] < 0.02


def test_rbf_models(blobs, spark):
    rng = np.random.default_rng(4)
    pts = rng.uniform(-1, 1, size=(300, 2))
    ring = ((pts ** 2).sum(1) < 0.5).astype(int)
    df = spark.createDataFrame([(i, [float(a), float(b)], int(c), i % 3) for i, ((a, b), c) in enumerate(zip(pts, ring))],
                               "id long, x array<double>, y int, fold int").cache()
    found = mg.rbf_svm(df, "x", "y", [1.0, 9.0], [0.01, 3.0], "fold", n_features=128)
    assert found.gamma == 3.0 and found.scores[3.0, found.c] > 0.9
    assert ev.accuracy(found.transform(df, "x"), "y", "prediction").first()[0] > 0.93
    svr = mg.rbf_svr(df, "x", "y", [1.5], [3.0], None, n_features=128)
    assert ev.r2(svr.transform(df, "x"), "y", "prediction").first()[0] > 0.6


def test_classifier_chain(blobs):
    df, _, _ = blobs
    chain = mg.classifier_chain(df, "x", ["first", "y"], c=6.0, gamma=0.3, n_features=128)
    loss = {r["label"]: r["loss"] for r in ev.hamming_loss(chain.transform(df, "x"), ["first", "y"], ["p_first", "p_y"]).collect()}
    assert loss["first"] < 0.1 and loss["y"] < 0.12


def test_boosting(blobs):
    df, x, _ = blobs
    loss = [ev.mse(tr.boost_reg(df, "x", "size", [0.0], n_trees=n, eta=0.3).fit.transform(df, "x"), "size", "prediction").first()[0]
            for n in (1, 4, 12)]
    assert loss[0] > loss[1] > loss[2] and loss[2] < 0.4 * (x ** 2).sum(1).var()
    flat = tr.boost_reg(df, "x", "size", [1e9], n_trees=2).fit.transform(df, "x").agg(F.countDistinct("prediction")).first()[0]
    assert flat == 1  # the penalty zeroes every leaf


def test_boosting_single_split(spark):
    rows = [(float(i), 1.0 if i < 10 else 5.0) for i in range(30)]
    df = spark.createDataFrame([([a], b) for a, b in rows], "x array<double>, y double")
    fit = tr.boost_reg(df, "x", "y", [2.0], n_trees=1, depth=1, eta=1.0, n_bins=64, base=0.5).fit
    got = {r["x"][0]: r["prediction"] for r in fit.transform(df, "x").collect()}
    # leaf = -soft(G, 2) / (H + 1) around the base 0.5
    assert abs(got[0.0] - (0.5 + (10 * 0.5 - 2) / 11)) < 1e-9
    assert abs(got[20.0] - (0.5 + (20 * 4.5 - 2) / 21)) < 1e-9


def test_boost_search_and_folds(blobs):
    df, _, _ = blobs
    found = tr.boost_reg(df, "x", "size", [0.0, 500.0], "fold", n_trees=5, eta=0.5)
    assert found.best == 0.0 and found.scores[0.0] < found.scores[500.0]
    fits = tr.boost_folds(df, "x", "first", "fold", n_trees=5)
    assert sorted(fits) == [0, 1, 2, 3]
    held = fits[2].transform(df.filter("fold = 2"), "x")
    assert ev.accuracy(held, "first", "prediction").first()[0] > 0.8
    clf = tr.boost_clf(df, "x", "first", n_trees=5).fit.transform(df, "x", score="s")
    assert ev.auc(clf, "first", "s").first()[0] > 0.95


@pytest.mark.parametrize("fitter", [tr.extra_trees_clf, tr.rf_clf])
def test_forest_classifiers(blobs, fitter):
    df, _, _ = blobs
    out = fitter(df.filter("is_test = 0"), "x", "y").transform(df.filter("is_test = 1"), "x")
    assert ev.accuracy(out, "y", "prediction").first()[0] > 0.8


@pytest.mark.parametrize("fitter", [tr.extra_trees_reg, tr.rf_reg, tr.gbt_reg])
def test_forest_regressors(blobs, fitter):
    df, x, _ = blobs
    kw = {"n_trees": 15} if fitter is tr.gbt_reg else {}
    out = fitter(df.filter("is_test = 0"), "x", "size", **kw).transform(df.filter("is_test = 1"), "x")
    assert ev.r2(out, "size", "prediction").first()[0] > 0.4


def test_weighted_forest_and_gbt(blobs):
    df, _, _ = blobs
    weighted = st.balanced_weights(df, "first")
    total = weighted.groupBy("first").agg(F.sum("weight").alias("w")).collect()
    assert np.allclose([r["w"] for r in total], 120.0)
    out = tr.rf_clf(weighted, "x", "first", "weight").transform(df, "x", score="s")
    assert ev.auc(out, "first", "s").first()[0] > 0.95
    out = tr.gbt_clf(df, "x", "first", n_trees=5).transform(df, "x")
    assert ev.accuracy(out, "first", "prediction").first()[0] > 0.9


def test_gaussian_nb(blobs):
    df, x, y = blobs
    got = {r["id"]: r["prediction"] for r in cl.gaussian_nb(df, "x", "y").transform(df, "x").collect()}
    smooth = 1e-9 * x.var(0).max()
    score = np.stack([np.log((y == c).mean()) - 0.5 * (np.log(2 * np.pi * (x[y == c].var(0) + smooth))
                      + (x - x[y == c].mean(0)) ** 2 / (x[y == c].var(0) + smooth)).sum(1) for c in range(3)], axis=1)
    assert [got[i] for i in range(240)] == score.argmax(1).tolist()


def test_kmeans_and_indices(blobs):
    df, x, y = blobs
    fit = cl.kmeans(df, "x", 3, seed=1)
    placed = fit.transform(df, "x").cache()
    got = {r["id"]: r["cluster"] for r in placed.collect()}
    lab = np.array([got[i] for i in range(240)])
    dist = ((x[:, None] - fit.centres[None]) ** 2).sum(2)
    assert (lab == dist.argmin(1)).all()
    within = sum(((x[lab == c] - x[lab == c].mean(0)) ** 2).sum() for c in range(3))
    between = sum((lab == c).sum() * ((x[lab == c].mean(0) - x.mean(0)) ** 2).sum() for c in range(3))
    assert abs(ev.inertia(placed, "x", "cluster").first()[0] - within) < 1e-8
    assert abs(ev.calinski_harabasz(placed, "x", "cluster").first()[0] - between / 2 / (within / 237)) < 1e-6
    sweep = cl.kmeans_sweep(df, "id", "x", [2, 3], seed=1).collect()
    assert [r["k"] for r in sweep] == [2, 3] and sweep[1]["inertia"] < sweep[0]["inertia"]


def _series(spark, **named):
    rows = [(s, i, float(v)) for s, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "s string, t int, x double").repartition(4)


def _adf(x, lag):
    d = np.diff(x)
    z = np.array([[x[t], *[d[t - k] for k in range(1, lag + 1)], 1.0] for t in range(lag, len(d))])
    t = d[lag:]
    w, *_ = np.linalg.lstsq(z, t, rcond=None)
    ssr = ((t - z @ w) ** 2).sum()
    err = np.sqrt(ssr / (len(t) - z.shape[1]) * np.linalg.inv(z.T @ z)[0, 0])
    return w[0] / err, ssr, len(t)


def test_adf(spark):
    rng = np.random.default_rng(6)
    walk, noise = rng.normal(size=400).cumsum() + 50, rng.normal(size=250)
    ar = np.zeros(300)
    for i in range(2, 300):
        ar[i] = 0.5 * ar[i - 1] + 0.3 * ar[i - 2] + rng.normal()
    series = dict(walk=walk, noise=noise, ar=ar)
    df = _series(spark, **series)
    for r in fc.adf_test(df, "x", "t", "s", max_lag=3, autolag=False).collect():
        assert abs(r["stat"] - _adf(series[r["s"]], 3)[0]) < 1e-6 and r["lag"] == 3
    for r in fc.adf_test(df, "x", "t", "s").collect():
        x = series[r["s"]]
        limit = int(np.ceil(12 * (len(x) / 100) ** 0.25))
        aic = []
        for lag in range(limit + 1):
            _, ssr, n = _adf(x[limit - lag:], lag)
            aic.append(n * (np.log(2 * np.pi * ssr / n) + 1) + 2 * (lag + 2))
        assert r["lag"] == int(np.argmin(aic)) and r["n"] == len(x)
        assert abs(r["stat"] - _adf(x, r["lag"])[0]) < 1e-6
        assert r["stationary"] == (r["s"] != "walk")
    assert abs(fc.mackinnon_p(-2.86) - 0.05) < 0.002 and abs(fc.mackinnon_p(-3.43) - 0.01) < 0.001


def test_ljung_box(spark):
    rng = np.random.default_rng(7)
    noise, walk = rng.normal(size=300), rng.normal(size=300).cumsum()
    got = {(r["s"], r["lag"]): r for r in fc.ljung_box(_series(spark, noise=noise, walk=walk), "x", 3, "t", "s").collect()}
    c = noise - noise.mean()
    q = sum(300 * 302 * ((c[k:] * c[:-k]).sum() / (c * c).sum()) ** 2 / (300 - k) for k in (1, 2, 3))
    assert abs(got["noise", 3]["q"] - q) < 1e-8
    assert got["noise", 1]["white_noise"] and not got["walk", 1]["white_noise"]
    # Tabulated 5 % points of the chi-square distribution.
    for dof, point in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (7, 14.06714)):
        assert abs(fc.chi2_tail(point, dof) - 0.05) < 1e-6


def test_arch(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=500)
    df = _series(spark, a=x)
    fit = fc.arch_fit(df, "x", 2, "t", "s")
    e2 = (x - x.mean()) ** 2
    w = np.linalg.lstsq(np.c_[e2[1:-1], e2[:-2], np.ones(498)], e2[2:], rcond=None)[0]
    r = fit.first()
    assert np.allclose([*r["alpha"], r["omega"]], w, atol=1e-8)
    steps = [r["variance"] for r in fc.arch_forecast(fit, 3, "s").orderBy("step").collect()]
    one = w[2] + w[0] * e2[-1] + w[1] * e2[-2]
    two = w[2] + w[0] * one + w[1] * e2[-1]
    assert np.allclose(steps[:2], [one, two])


def _arma(n, phi, theta, seed):
    rng = np.random.default_rng(seed)
    e, x = rng.normal(size=n + 200), np.zeros(n + 200)
    for i in range(1, n + 200):
        x[i] = phi * x[i - 1] + e[i] + theta * e[i - 1]
    return x[200:] + 10


def test_arma(spark):
    x = _arma(4000, 0.6, 0.4, 11)
    df = _series(spark, a=x, b=_arma(2000, 0.8, 0.0, 12))
    best = {r["s"]: (r["p"], r["q"]) for r in fc.best_order(fc.arma_order(df, "x", 3, 3, "t", "s"), "s").collect()}
    assert best["b"] == (1, 0) and sum(best["a"]) >= 2
    # The two stages against plain regressions on the same rows.
    m, n = 20, len(x)
    z = np.array([x[t - m:t] for t in range(m + 1, n)])
    a = np.linalg.lstsq(np.c_[z, np.ones(len(z))], x[m + 1:], rcond=None)[0]
    e = np.full(n, np.nan)
    for t in range(m, n):
        e[t] = x[t] - a[-1] - a[:-1] @ x[t - m:t]
    w = np.linalg.lstsq(np.c_[x[m:n - 1], e[m:n - 1], np.ones(n - 1 - m)], x[m + 1:], rcond=None)[0]
    got = fc.arma_forecast(df.filter("s = 'a'"), "x", 3, "t", "s", order=(1, 1)).orderBy("step").collect()
    one = w[0] * x[-1] + w[1] * e[-1] + w[2]
    assert np.allclose([r["forecast"] for r in got], [one, w[0] * one + w[2], w[0] * (w[0] * one + w[2]) + w[2]], atol=1e-6)
    assert abs(w[0] - 0.6) < 0.08 and abs(w[1] - 0.4) < 0.08


def test_garch(spark):
    rng = np.random.default_rng(13)
    n, v, x = 20000, 1.0, []
    last = 0.0
    for _ in range(n):
        v = 0.1 + 0.15 * last * last + 0.75 * v
        last = np.sqrt(v) * rng.normal()
        x.append(last)
    r = fc.garch_fit(_series(spark, a=x), "x", 1, 1, "t", "s", h=400).first()
    assert abs(r["alpha"][0] - 0.15) < 0.08 and abs(r["beta"][0] - 0.75) < 0.15
    assert abs(r["variances"][-1] - np.var(x)) < 0.2 * np.var(x)  # forecasts settle at the mean level
    assert r["converged"] and min(*r["alpha"], *r["beta"]) >= 0 and r["alpha"][0] + r["beta"][0] < 1
    e2 = (np.array(x[-5000:]) - np.mean(x)) ** 2
    free = lambda o, a, b: fc._garch_start(o, np.array([a]), np.array([b]), 1.0)
    found = fc._garch_loss(free(r["omega"], r["alpha"][0], r["beta"][0]), 1, e2)
    assert found <= fc._garch_loss(free(0.1, 0.15, 0.75), 1, e2) + 1e-6  # not below the truth's likelihood


def test_garch_of_awkward_series(spark):
    """Rising, flat and noisy series stay within the bounds or are flagged."""
    rng = np.random.default_rng(2)
    df = _series(spark, flat=np.full(200, 3.0), walk=np.cumsum(rng.normal(size=300)), noise=rng.normal(size=300),
                 spike=np.r_[np.zeros(150), 50.0, np.zeros(149)])
    for r in fc.garch_fit(df, "x", 2, 2, "t", "s", h=30).collect():
        assert min([*r["alpha"], *r["beta"], r["omega"]]) >= 0 and sum([*r["alpha"], *r["beta"]]) < 1
        assert len(r["variances"]) == 30 and all(np.isfinite(v) and v >= 0 for v in r["variances"])
        assert r["s"] != "flat" or not r["converged"]


def test_lag_forecast(spark):
    rng = np.random.default_rng(14)
    x = np.sin(np.arange(300) / 7) * 10 + rng.normal(size=300) + 40
    df = _series(spark, a=x, b=x[::-1]).withColumn("is_test", (F.col("t") >= 250).cast("int"))
    got = {(r["s"], r["t"]): r["prediction"] for r in fc.lag_forecast(df, "x", 12, "t", "is_test", "s").collect()}
    assert len(got) == 100
    z = np.array([x[t - 12:t] for t in range(12, 300)])
    w = np.linalg.lstsq(np.c_[z[:238], np.ones(238)], x[12:250], rcond=None)[0]
    assert np.allclose([got["a", t] for t in range(250, 300)], np.c_[z[238:], np.ones(50)] @ w, atol=1e-6)
    out = fc.lag_forecast(df, "x", 12, "t", "is_test", "s", est="boosted", n_trees=20)
    assert out.count() == 100 and ev.rmse(out, "x", "prediction").first()[0] < 0.6 * x.std()
    both = fc.kalman_lag_forecast(df, "x", 12, "t", "is_test", "s")
    assert both.count() == 100 and {"smooth", "prediction", "x"} <= set(both.columns)
    alone = fc.lag_forecast(df.filter("s = 'a'").drop("s"), "x", 12, "t", "is_test")
    assert np.allclose([r["prediction"] for r in alone.orderBy("t").collect()], [got["a", t] for t in range(250, 300)])


@pytest.fixture(scope="module")
def pictures(spark):
    rng = np.random.default_rng(15)
    colours = np.array([[200, 10, 10], [10, 200, 10], [10, 10, 200], [250, 250, 250]])
    data = []
    for i in range(30):
        code = rng.integers(0, 4, 16)
        px = colours[code] + rng.integers(-5, 6, (16, 3))
        data.append((i, [int(v) for v in px.T.ravel()]))
    return spark.createDataFrame(data, "id long, data array<int>"), colours


def test_palette_and_colorize(pictures):
    df, colours = pictures
    px = im.pixels(df, "id", "data", 16)
    found = cl.palette(px, 4, seed=3)
    dist = np.sqrt(((found.fit.centres[:, None] - colours[None]) ** 2).sum(2))
    assert dist.min(1).max() < 30
    out = im.colorize(df, "id", "data", 4, k=4)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 480 and ev.accuracy(out, "code", "prediction").first()[0] > 0.6


def test_patches(spark):
    df = spark.createDataFrame([(1, [float(i) for i in range(9)])], "id long, g array<double>")
    got = {r["pos"]: r["patch"] for r in im.patch_features(df, "id", "g", 3).collect()}
    assert got[4] == [float(i) for i in range(9)]
    assert got[0] == [0, 0, 0, 0, 0, 1, 0, 3, 4]


def test_noise(pictures):
    df, _ = pictures
    one = im.inject_noise(df, "id", "data", 16, n=5, seed=1, out="noisy").collect()
    two = {r["id"]: r["noisy"] for r in im.inject_noise(df.repartition(3), "id", "data", 16, n=5, seed=1, out="noisy").collect()}
    for r in one:
        assert two[r["id"]] == r["noisy"]
        a, b = np.array(r["data"]).reshape(3, 16), np.array(r["noisy"]).reshape(3, 16)
        moved = (a != b).any(0)
        assert 0 < moved.sum() <= 5
        assert all(len(set(b[:, i])) == 1 and b[0, i] in (0, 255, 96, 144) for i in np.nonzero(moved)[0])
