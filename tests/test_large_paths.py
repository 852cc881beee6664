"""The paths taken above the size limits give the same rows as the plain ones, skew included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluate as ev
from millrace.operators import forecast as fc
from millrace.operators import joins as jn
from millrace.operators import neighbours as nb
from millrace.operators import order as od
from millrace.operators import resample as rs
from millrace.operators import series as se
from millrace.operators import stats as st
from millrace.operators import text as tx


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """1,000 rows in 9 series; the series 'hot' holds two thirds of them."""
    rng = np.random.default_rng(5)
    data = []
    for i in range(1000):
        key = "hot" if i % 3 else f"s{i % 8}"
        data.append((i, key, float(rng.normal(100, 20)), int(rng.integers(0, 50))))
    return spark.createDataFrame(data, "id long, s string, x double, g int").repartition(7)


@pytest.mark.parametrize("groups", [None, "s"])
def test_position(skewed, groups):
    plain = od.with_position(skewed, "id", groups)
    split = od.with_position(skewed, "id", groups, max_rows=50)
    assert rows(plain.select("id", "pos")) == rows(split.select("id", "pos"))
    assert plain.columns == split.columns


def test_position_descending(skewed):
    order = [F.desc("x"), F.col("id")]
    plain = od.with_position(skewed, order).select("id", "pos")
    split = od.with_position(skewed, order, max_rows=10).select("id", "pos")
    assert rows(plain) == rows(split)


def test_prefix_sums(skewed):
    plain = od.prefix_sums(skewed, "id", {"t": "g"}).select("id", "t")
    assert rows(plain) == rows(od.prefix_sums(skewed, "id", {"t": "g"}, max_rows=30).select("id", "t"))


def test_windows(skewed):
    same = lambda fn, cols: rows(fn(10 ** 6).select(*cols)) == rows(fn(16).select(*cols))
    assert same(lambda m: se.moving_avg(skewed, "g", 10, "id", "s", max_rows=m), ["id", "ma"])
    assert same(lambda m: se.moving_avg(skewed, "g", 40, "id", "s", max_rows=m), ["id", "ma"])
    assert same(lambda m: se.rel_change(skewed, "x", "id", "s", max_rows=m), ["id", "change"])
    assert same(lambda m: se.forward_return(skewed, "x", [3, 5], "id", "s", max_rows=m), ["id", "rt_3", "rt_5"])
    assert same(lambda m: se.lag_windows(skewed, "x", 20, "id", "s", max_rows=m), ["id", "window"])
    assert same(lambda m: se.with_lags(skewed, "x", [1, 7], "id", max_rows=m), ["id", "lag_1", "lag_7"])


def test_folds_and_split(skewed):
    folds = od.contiguous_folds(skewed, "id", 7)
    n = skewed.count()
    want = sorted(r[0] for r in skewed.select("id").collect())
    got = dict(rows(folds.select("id", "fold")))
    assert [got[i] for i in want] == [((at + 1) * 7 - 1) // n for at in range(n)]
    head, tail = od.positional_split(skewed, "id", frac=0.7)
    for frame in (folds, head, tail):
        assert "SinglePartition" not in frame._jdf.queryExecution().executedPlan().toString()
    assert head.count() == 700 and head.agg(F.max("id")).first()[0] < tail.agg(F.min("id")).first()[0]


@pytest.mark.parametrize("n,k", [(10, 3), (11, 10), (7, 7), (100, 6)])
def test_fold_bounds(spark, n, k):
    got = dict(rows(od.contiguous_folds(spark.range(n), "id", k).select("id", "fold")))
    want = {i: f for f in range(k) for i in range(int(n / k * f), int(n / k * (f + 1)))}
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join(spark, skewed, how):
    dim = spark.createDataFrame([("hot", 1), ("s0", 2), ("s3", 3), ("zz", 4)], "s string, d int")
    plain = jn.lookup_join(skewed, dim, "s", how)
    split = jn.lookup_join(skewed, dim, "s", how, max_rows=1, hot_rows=50)
    assert set(plain.columns) == set(split.columns)
    cols = sorted(plain.columns)
    key = lambda r: str(r)
    assert sorted(map(tuple, plain.select(cols).collect()), key=key) == sorted(map(tuple, split.select(cols).collect()), key=key)


@pytest.mark.parametrize("sketch", [40, 10_000])
def test_quantiles(skewed, sketch):
    heavy = skewed.withColumn("h", F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("x")))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    plain = st.exact_quantiles(heavy, ["x", "h", "g"], probs)
    split = st.exact_quantiles(heavy, ["x", "h", "g"], probs, max_rows=60, sketch=sketch)
    x = np.array([r["x"] for r in heavy.collect()])
    assert np.allclose(plain["x"], np.quantile(x, probs))
    for c in plain:
        assert np.allclose(plain[c], split[c], rtol=1e-12)


def test_auc(skewed):
    df = skewed.select((F.col("id") % 4 == 0).cast("int").alias("y"), "g", "x")
    for score in ("g", "x"):
        assert abs(ev.auc(df, "y", score).first()[0] - ev.auc(df, "y", score, max_rows=5).first()[0]) < 1e-12
        got = df.toPandas()
        pos, neg = got[got.y == 1][score].to_numpy(), got[got.y == 0][score].to_numpy()
        want = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
        assert abs(ev.auc(df, "y", score).first()[0] - want) < 1e-12


@pytest.fixture(scope="module")
def points(spark):
    """300 points in 6 dimensions: a third are copies of one point, labels uneven."""
    rng = np.random.default_rng(8)
    data = []
    for i in range(300):
        v = [0.5] * 6 if i % 3 == 0 else [float(round(x, 3)) for x in rng.normal(size=6)]
        data.append((i, v, int(i % 10 == 0) + int(i % 25 == 1)))
    return spark.createDataFrame(data, "id long, v array<double>, y int").repartition(5)


def brute(pts, k, allowed):
    out = {}
    for a in pts:
        d = sorted((float(np.sqrt(((np.array(a["v"]) - np.array(b["v"])) ** 2).sum())), b["id"]) for b in pts if allowed(a, b))
        out[a["id"]] = [(i, round(x, 9)) for x, i in d[:k]]
    return out


def near(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["neighbour"], round(r["dist"], 9)))
    return out


@pytest.mark.parametrize("kw", [{}, {"max_rows": 0, "block_rows": 40}, {"max_rows": 0, "block_rows": 15, "pivots": 9}])
def test_knn(points, kw):
    pts = points.collect()
    got = near(nb.knn_join(points, points, 4, "v", "id", exclude_same="id", **kw))
    assert got == brute(pts, 4, lambda a, b: a["id"] != b["id"])
    got = near(nb.knn_join(points, points, 3, "v", "id", by="y", exclude_same="id", **kw))
    assert got == brute(pts, 3, lambda a, b: a["id"] != b["id"] and a["y"] == b["y"])
    got = near(nb.knn_join(points, points, 3, "v", "id", **kw))
    assert got == brute(pts, 3, lambda a, b: True)


@pytest.mark.parametrize("kw", [{}, {"max_rows": 0, "block_rows": 40}])
def test_knn_other_fold(points, kw):
    folded = points.withColumn("fold", (F.col("id") % 4).cast("int"))
    got = near(nb.knn_join(folded, folded, 3, "v", "id", exclude_same="fold", **kw))
    assert got == brute(points.collect(), 3, lambda a, b: a["id"] % 4 != b["id"] % 4)


def test_knn_approx_recall(points):
    exact = near(nb.knn_join(points, points, 4, "v", "id", exclude_same="id"))
    got = near(nb.knn_join(points, points, 4, "v", "id", exclude_same="id", approx=True, probes=4, block_rows=200, pivots=12))
    hits = sum(len({i for i, _ in exact[k]} & {i for i, _ in got.get(k, [])}) for k in exact)
    assert hits / (4 * len(exact)) > 0.6


def test_silhouette_blocks(points):
    plain = ev.silhouette(points, "id", "v", "y").first()[0]
    sums = nb.cluster_distance_sums(points, "id", "v", "y", max_rows=0, block_rows=70)
    whole = nb.cluster_distance_sums(points, "id", "v", "y")
    a = {(r["id"], r["cluster"]): (r["n"], r["dist"]) for r in sums.collect()}
    b = {(r["id"], r["cluster"]): (r["n"], r["dist"]) for r in whole.collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and abs(a[k][1] - b[k][1]) < 1e-6 for k in a)
    pts = points.collect()
    v, y = np.array([p["v"] for p in pts]), np.array([p["y"] for p in pts])
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    s = []
    for i in range(len(v)):
        own = (y == y[i]).sum()
        inside = d[i, y == y[i]].sum() / (own - 1)
        outside = min(d[i, y == c].mean() for c in set(y) if c != y[i])
        s.append((outside - inside) / max(inside, outside))
    assert abs(plain - np.mean(s)) < 1e-7


@pytest.mark.parametrize("kw", [{}, {"max_rows": 40}])
def test_smote(points, kw):
    out = rs.smote(points, "id", "v", "y", k=3, seed=4, **kw).collect()
    real = {r["id"]: r for r in points.collect()}
    counts = {}
    for r in out:
        counts[r["y"]] = counts.get(r["y"], 0) + 1
    assert len(set(counts.values())) == 1 and sum(1 - r["synthetic"] for r in out) == 300
    near_of = brute(points.collect(), 3, lambda a, b: a["id"] != b["id"] and a["y"] == b["y"])
    for r in (r for r in out if r["synthetic"]):
        base, new = np.array(real[r["id"]]["v"]), np.array(r["v"])
        on_segment = False
        for other, _ in near_of[r["id"]]:
            to = np.array(real[other]["v"]) - base
            gap = (new - base) @ to / (to @ to) if to @ to else 0.0
            on_segment |= 0 <= gap <= 1 and np.allclose(base + gap * to, new)
        assert on_segment


def test_smote_is_stable(points):
    one = rs.smote(points, "id", "v", "y", k=3, seed=4)
    two = rs.smote(points.repartition(2), "id", "v", "y", k=3, seed=4)
    assert rows(one) == rows(two)


def _filter_loop(z):
    x, p, out = 0.0, 1.0, []
    for v in z:
        base = 0.382 * v + 0.618 * x if abs(x - v) >= 30 else x
        ahead = p + 1e-5
        k = ahead / (ahead + 0.1)
        x = base + k * (v - x)
        p = (1 - k) * ahead
        out.append(x)
    return out


def test_kalman_chunks(skewed):
    got = {r["id"]: r["smooth"] for r in fc.kalman_smooth(skewed, "x", "id", "s").collect()}
    cut = {r["id"]: r["smooth"] for r in fc.kalman_smooth(skewed, "x", "id", "s", max_rows=60).collect()}
    data = skewed.toPandas().sort_values("id")
    for _, part in data.groupby("s"):
        want = dict(zip(part["id"], _filter_loop(part["x"])))
        assert all(got[i] == w for i, w in want.items())
        assert all(cut[i] == w for i, w in want.items())


def test_series_sums_in_chunks(skewed):
    for fn in (lambda m: fc.adf_test(skewed, "x", "id", "s", max_lag=2, max_rows=m).select("s", "n", "lag", "stat"),
               lambda m: se.acf(skewed, "x", 4, "id", "s", max_rows=m)):
        a, b = rows(fn(10 ** 6)), rows(fn(40))
        assert [r[:3] for r in a] == [r[:3] for r in b]
        assert np.allclose([r[3] for r in a], [r[3] for r in b], rtol=1e-8, equal_nan=True)


def test_posts_by_day_parts(spark):
    df = spark.createDataFrame([(i, 1 if i % 3 else i, f"t{i}") for i in range(60)], "id long, day int, t string")
    plain = tx.posts_by_day(df, "day", "t", "id", part_rows=7)
    assert rows(plain) == rows(tx.posts_by_day(df, "day", "t", "id", part_rows=7, max_rows=5))
    whole = {}
    for r in sorted(plain.collect(), key=lambda r: (r["day"], r["part"])):
        whole.setdefault(r["day"], []).append(r["text"])
    assert ".".join(whole[1]) == ".".join(f"t{i}" for i in range(60) if i % 3 or i == 1)


def test_doc_freq_shuffled(spark):
    texts = ["the cat sat", "category theory", "a the the", "concatenate, now", "", "dog"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    vocab = spark.createDataFrame([("cat",), ("the",), ("a",), ("dog",), ("none",)], "word string")
    for limit in (10 ** 6, 1):
        sub = dict(rows(tx.doc_freq(df, vocab, "t", "id", "substring", max_rows=limit)))
        assert sub == {w: n for w in ["cat", "the", "a", "dog"] if (n := sum(w in t for t in texts))}
        token = dict(rows(tx.doc_freq(df, vocab, "t", max_rows=limit)))
        assert token == {"cat": 1, "the": 2, "a": 1, "dog": 1}
