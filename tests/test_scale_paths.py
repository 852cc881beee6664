"""Sums in blocks, Newton's method with products, siblings by subtraction, automata: against the plain forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import cluster as cl
from millrace.operators import evaluate as ev
from millrace.operators import gram
from millrace.operators import margin as mg
from millrace.operators import neighbours as nb
from millrace.operators import order as od
from millrace.operators import resample as rs
from millrace.operators import text as tx
from millrace.operators import trees as tr
from millrace.session import cut_lineage


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 12))
    y = (np.arange(400) % 3).astype(int)
    x[:, 0] += y
    value = x @ rng.normal(size=12) + rng.normal(size=400)
    rows = [(i, [float(v) for v in x[i]], int(y[i]), float(value[i]), i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int, value double, fold int").repartition(7)
    return cut_lineage(df), x, y, value


# --- sums -----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("shuffled", [8, 200])
def test_sums_of_many_tasks_travel_in_small_records(spark, monkeypatch, shuffled):
    """500 tasks with two million numbers each: the total is exact and no record is above a megabyte."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shuffled))
    cells = 2_000_000 if shuffled == 8 else 300_000
    parts = 500 if shuffled == 200 else 70
    seen, merge = [], gram.tree_merge
    monkeypatch.setattr(gram, "tree_merge", lambda p, *a: merge(seen.append(p) or p, *a))
    try:
        rows = cut_lineage(spark.range(parts, numPartitions=parts).select(F.col("id").cast("double").alias("v")))

        def vectors(batches):
            for b in batches:
                yield np.arange(cells) % 7 * b["v"].to_numpy().sum()

        got = gram.total_array(rows, vectors)
        assert len(got) == cells and np.array_equal(got, np.arange(cells) % 7 * (parts * (parts - 1) / 2))
        sample = seen[0].filter("part = 0").limit(1).select(F.size("sums")).first()[0]
        assert 8 * sample <= 1_000_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("cells", [125_000, 30, 5])
def test_moments_in_blocks_of_rows(spark, points, monkeypatch, cells):
    df, x, y, _ = points
    monkeypatch.setattr(gram, "BLOCK_CELLS", cells)
    found = gram.collect_moments(df, "x", "y")
    for k in range(3):
        own = x[y == k] - x[y == k].mean(0)
        n, mean, m2 = found[k]
        assert n == len(own) and np.allclose(mean, x[y == k].mean(0)) and np.allclose(m2, own.T @ own)


def test_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(gram, "_FAN_IN", 3)
    rows = cut_lineage(spark.range(100, numPartitions=40).select(F.col("id").cast("double").alias("v")))
    got = gram.total_array(rows, lambda batches: (np.array([b["v"].sum(), len(b)]) for b in batches))
    assert got.tolist() == [4950, 100]


# --- margins --------------------------------------------------------------------------------------------------------

def dense(x, t, c, loss, eps=0.1, bias=False):
    """The same objective by damped Newton with whole Hessians; L2 only."""
    z = np.c_[x, np.ones(len(x))]
    weigh = np.r_[np.ones(x.shape[1]), float(bias)]
    w = np.zeros(z.shape[1])
    value = lambda w: c * mg._pointwise(loss, z @ w, t, eps)[0].sum() + 0.5 * (weigh * w * w).sum()
    for _ in range(200):
        _, slope, curve = mg._pointwise(loss, z @ w, t, eps)
        g = c * slope @ z + weigh * w
        step = np.linalg.solve(c * (z * curve[:, None]).T @ z + np.diag(weigh) + 1e-10 * np.eye(len(w)), -g)
        a = 1.0
        while value(w + a * step) > value(w) + 1e-12 and a > 1e-10:
            a /= 2
        w = w + a * step
    return w


@pytest.mark.parametrize("loss", ["logistic", "squared_hinge", "squared_eps"])
def test_newton_with_products_equals_the_dense_solver(points, loss):
    df, x, y, value = points
    target = None if loss == "squared_eps" else 1
    problems = [mg.Problem(c, f, target) for c in (0.01, 1.0, 9.0) for f in (-1, 2)]
    got = mg.fit_grid(df, "x", "value" if target is None else "y", problems, loss, "l2", "fold")
    for p in problems:
        use = np.arange(400) % 4 != p.fold
        t = value if target is None else np.where(y == 1, 1.0, -1.0)
        assert np.abs(got[p] - dense(x[use], t[use], p.c, loss)).max() < 1e-6, p


def test_l1_fits_are_optimal(points):
    df, x, y, _ = points
    z = np.c_[x, np.ones(400)]
    problems = [mg.Problem(c, -1, k) for c in (0.002, 0.02, 1.0) for k in range(3)]
    got = mg.fit_grid(df, "x", "y", problems, "squared_hinge", "l1", penalise_bias=True)
    zeros = 0
    for p in problems:
        w, t = got[p], np.where(y == p.target, 1.0, -1.0)
        g = p.c * mg._pointwise("squared_hinge", z @ w, t, 0)[1] @ z
        assert np.abs(g[w != 0] + np.sign(w[w != 0])).max(initial=0) < 1e-5 and (np.abs(g[w == 0]) <= 1 + 1e-7).all()
        zeros += (w == 0).sum()
    assert zeros > 5


def test_feature_maps_advance_together(points):
    """Fits of several kernels in one grid are those of each alone, on stored features too."""
    df, x, y, _ = points
    maps = [mg.fourier(12, g, 40, 3) for g in (0.01, 0.2)]
    problems = [mg.Problem(1.0, -1, 0, m) for m in range(2)]
    got = mg.fit_grid(df, "x", "y", problems, "squared_hinge", "l2", maps=maps)
    for m in range(2):
        want = dense(maps[m].of(x), np.where(y == 0, 1.0, -1.0), 1.0, "squared_hinge")
        assert np.abs(got[problems[m]] - want).max() < 1e-6


def test_unfinished_fits_warn(points):
    with pytest.warns(UserWarning, match="did not converge"):
        mg.fit_grid(points[0], "x", "y", [mg.Problem(1.0, -1, 0)], "logistic", "l2", max_passes=2)


# --- trees ----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_siblings_by_subtraction_give_the_same_trees(spark, points, monkeypatch, loss):
    df, x, _, _ = points
    df = df.withColumn("b", (F.col("value") > 0).cast("int"))
    found = []
    for subtract, refresh in ((False, 100), (True, 2), (True, 1)):
        monkeypatch.setattr(tr, "SUBTRACT", subtract)
        monkeypatch.setattr(tr, "REFRESH", refresh)
        if loss == "squared":
            found.append(tr.boost_reg(df, "x", "value", [0.0, 0.5], "fold", n_trees=5))
        else:
            found.append(tr.boost_clf(df, "x", "b", n_trees=4, depth=4))
    for other in found[1:]:
        assert len(other.fit.trees) == len(found[0].fit.trees)
        for a, b in zip(found[0].fit.trees, other.fit.trees, strict=True):
            assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut)
            assert np.allclose(a.value, b.value, atol=1e-9)
        assert found[0].scores == pytest.approx(other.scores)


def test_boosting_is_that_of_plain_numpy(points):
    """One tree of depth one: the cut of the largest gain over the bins, leaves by the formula."""
    df, x, _, value = points
    fit = tr.boost_reg(df, "x", "value", [0.0], n_trees=1, depth=1, eta=1.0, l2=1.0, n_bins=8).fit
    edges = fit.edges
    g = value.mean() - value
    best = max(((g[x[:, j] <= e].sum() ** 2 / ((x[:, j] <= e).sum() + 1) + g[x[:, j] > e].sum() ** 2 / ((x[:, j] > e).sum() + 1), j, k)
                for j in range(12) for k, e in enumerate(edges[j])), key=lambda s: s[0])
    tree = fit.trees[0]
    assert (tree.feature[0], tree.cut[0]) == best[1:]
    left = x[:, best[1]] <= edges[best[1]][best[2]]
    assert tree.value[1:3, 0] == pytest.approx([-g[left].sum() / (left.sum() + 1), -g[~left].sum() / ((~left).sum() + 1)])


def test_boosted_folds_write_their_margins(points):
    df, _, _, _ = points
    fits = tr.boost_folds(df.withColumn("b", (F.col("value") > 0).cast("int")), "x", "b", "fold", n_trees=5, depth=2)
    assert sorted(fits) == [0, 1, 2, 3] and all(len(f.trees) == 5 for f in fits.values())


# --- text and order -------------------------------------------------------------------------------------------------

def test_substring_frequencies_of_a_very_long_piece(spark):
    texts = ["ab" * 10_000, "xabx ab", None, "", "b", "a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    words = ["a", "ab", "ba", "abab" * 20, "c", "zz", "ab"]
    vocab = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.n_docs for r in tx.doc_freq(df, vocab, "t", "id", "substring").collect()}
    assert got == {w: n for w in words if (n := sum(w in (t or "") for t in texts))}
    assert tx.doc_freq(df, vocab.limit(0), "t", "id", "substring").count() == 0


def test_folds_by_several_keys_with_nulls(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 11 == 0 else str(k % 5), float(k)) for k in rng.permutation(200).tolist()]
    df = spark.createDataFrame(rows, "a string, b double").repartition(6)
    frame = pd.DataFrame(rows, columns=["a", "b"]).sort_values(["a", "b"], na_position="first").reset_index(drop=True)
    got = {(r.a, r.b): r.fold for r in od.contiguous_folds(df, ["a", "b"], 7).collect()}
    for at, (a, b) in enumerate(zip(frame["a"], frame["b"], strict=True)):
        assert got[a if isinstance(a, str) else None, b] == ((at + 1) * 7 - 1) // 200
    assert od.contiguous_folds(df, ["a", "b"], 1).agg(F.max("fold")).first()[0] == 0
    head, tail = od.positional_split(df, ["a", "b"], n=200)
    assert (head.count(), tail.count()) == (200, 0)


# --- neighbours -----------------------------------------------------------------------------------------------------

def test_neighbours_in_many_groups_are_one_plan(spark):
    """Groups of one to twenty rows; the plan does not grow with their number, and rows equal the broadcast form's."""
    rng = np.random.default_rng(4)
    side = np.concatenate([rng.integers(0, 800, 1200), np.zeros(1500, int)])
    df = cut_lineage(spark.createDataFrame([(k, rng.normal(size=3).tolist(), int(s), k % 3) for k, s in enumerate(side)],
                                           "id long, v array<double>, side int, fold int").repartition(6))
    for barred in ("fold",):
        found = nb.knn_join(df, df, 3, "v", "id", by="side", exclude_same=barred, max_rows=10, block_rows=500)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Union") == 0 and plan.count("FlatMapCoGroups") <= 1
        wide = nb.knn_join(df, df, 3, "v", "id", by="side", exclude_same=barred)
        keys = ["id", "rank", "neighbour"]
        assert sorted(map(tuple, found.select(*keys).collect())) == sorted(map(tuple, wide.select(*keys).collect()))


def test_approximate_neighbours_reach_their_recall_at_few_candidates(spark, monkeypatch):
    """Vectors near a curved sheet: nine of ten neighbours are found, and candidates grow below n ** 1.6."""
    rng = np.random.default_rng(6)
    lift = rng.normal(size=(4, 24))
    seen, visits = [], nb._visits

    def counted(left, stats, *a):
        out = cut_lineage(visits(left, stats, *a))
        seen.append(out.join(stats.select("cell", "n"), "cell").agg(F.sum("n")).first()[0])
        return out

    monkeypatch.setattr(nb, "_visits", counted)
    for n in (3000, 12_000):
        base = rng.uniform(-1, 1, size=(n, 2))
        x = np.tanh(np.c_[base, base ** 2] @ lift) + rng.normal(scale=0.01, size=(n, 24))
        df = cut_lineage(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(8))
        near = nb.knn_join(df, df, 5, "v", "id", exclude_same="id", approx=True).select("id", "neighbour").collect()
        some = rng.choice(n, 200, False)
        got = {}
        for r in near:
            got.setdefault(r.id, set()).add(r.neighbour)
        d = ((x[some][:, None] - x[None]) ** 2).sum(2)
        d[np.arange(200), some] = np.inf
        want = np.argsort(d, 1)[:, :5]
        assert np.mean([len(got[i] & set(w.tolist())) / 5 for i, w in zip(some.tolist(), want, strict=True)]) >= 0.9
    assert np.log(seen[1] / seen[0]) / np.log(4) < 1.6 and seen[1] < 0.3 * 12_000 ** 2


def test_resampling_of_all_folds_is_that_of_each(spark, points):
    df, _, _, _ = points
    df = df.filter("y < 2 and (y = 0 or id % 5 < 2)")
    made = rs.smote_folds(df, "id", "x", "y", "fold", 3, seed=5)
    got = sorted((r.trains, r.id, r.y, r.synthetic, tuple(np.round(r.x, 9))) for r in made.collect())
    want = sorted((f, r.id, r.y, r.synthetic, tuple(np.round(r.x, 9))) for f in range(4)
                  for r in rs.smote(df.filter(F.col("fold") != f), "id", "x", "y", 3, seed=5).collect())
    assert got == want and any(r[3] for r in got)


# --- clusters -------------------------------------------------------------------------------------------------------

def test_lloyd_steps_of_many_starts_are_those_of_each(spark, points):
    df, x, _, _ = points
    starts = [cl._start(x, k, seed) for k in (2, 5, 9) for seed in (0, 1)]
    for start, got in zip(starts, cl.lloyd_grid(df, "x", starts), strict=True):
        c = start
        for _ in range(500):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
            moved, c = ((new - c) ** 2).sum(1).max(), new
            if moved <= 1e-8:
                break
        assert np.allclose(got, c, atol=1e-9)
    with pytest.warns(UserWarning, match="still moved"):
        cl.lloyd_grid(df, "x", starts[:1], max_iter=1)


@pytest.mark.parametrize("rows", [10**6, 10])
def test_scores_of_a_sweep_are_those_of_each_clustering(spark, points, monkeypatch, rows):
    df, x, _, _ = points
    monkeypatch.setattr(ev, "BROADCAST_ROWS", rows)
    centres = cl.kmeans_grid(df, "x", [2, 4, 7], [3, 3, 3])
    placed = cut_lineage(cl.assign_grid(df, "x", centres, "all"))
    got = ev.silhouettes(placed, "id", "x", "all", 3, max_rows=rows)
    for j in range(3):
        alone = ev.silhouette(placed.withColumn("c", F.col("all")[j]), "id", "x", "c").first()[0]
        assert got[j] == pytest.approx(alone, abs=1e-9)
    sweep = cl.kmeans_sweep(df, "id", "x", [2, 4, 7], seed=3).collect()
    for j, r in enumerate(sweep):
        own = placed.withColumn("c", F.col("all")[j])
        assert r.inertia == pytest.approx(ev.inertia(own, "x", "c").first()[0])
        assert r.calinski_harabasz == pytest.approx(ev.calinski_harabasz(own, "x", "c").first()[0])
        assert r.silhouette == pytest.approx(got[j])


def test_runs_are_one_plan(points):
    df, x, _, _ = points
    runs = cl.kmeans_runs(df, "x", 3, range(6))
    assert runs.count() == 6 * 400 and runs._jdf.queryExecution().optimizedPlan().toString().count("Union") == 0
    centres = cl.kmeans_grid(df, "x", [3] * 6, list(range(6)))
    for r in runs.filter("run = 4").collect():
        assert r.cluster == ((np.array(r.x)[None] - centres[4]) ** 2).sum(1).argmin()
