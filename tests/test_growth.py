"""Work that grows with the input only: sums of equal rows, distances as products, large vocabularies, bounded blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import cluster as cl
from millrace.operators import gram
from millrace.operators import margin as mg
from millrace.operators import neighbours as nb
from millrace.operators import order as od
from millrace.operators import text as tx
from millrace.operators import trees as tr
from millrace.session import cut_lineage


@pytest.mark.parametrize("loss", ["squared", "logistic"])
def test_rows_of_equal_bins_are_grown_as_one(spark, monkeypatch, loss):
    """6,000 rows with 60 combinations of bins and four folds: at most 240 (or 480) rows a pass, the same trees and scores."""
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 5, 6000), rng.integers(0, 4, 6000), rng.integers(0, 3, 6000)], axis=1)
    y = x[:, 0] * 2.0 - x[:, 1] + rng.normal(size=6000)
    rows = [([float(v) for v in a], float(b), int(b > 2), i % 4) for i, (a, b) in enumerate(zip(x, y))]
    df = cut_lineage(spark.createDataFrame(rows, "x array<double>, y double, b int, fold int").repartition(5))
    sizes, found, seen = [], [], tr._Grower.held_loss

    def grow(combinations):
        monkeypatch.setattr(tr, "COMBINATIONS", combinations)
        if loss == "squared":
            return tr.boost_reg(df, "x", "y", [0.0, 5.0], "fold", n_trees=6, depth=3)
        grower = tr._Grower(df, "x", "b", "fold", "logistic", [tr.Spec(0.0, 1.0, f) for f in (-1, 2)], 3, 32, 1, 0.3, 0.0, 1.0, None, False)
        for _ in range(5):
            grower.grow()
        scores = seen(grower)
        grower.close()
        return tr.BoostResult(tr.Ensemble(grower.edges, grower.done[1], 3, 0.0, 0.3, "logistic", [0, 1]), 0.0, {0: scores[1]})

    def held(grower):
        sizes.append(sum(len(np.frombuffer(r["y"])) for r in grower.rows.select("y").collect()))
        return seen(grower)

    monkeypatch.setattr(tr._Grower, "held_loss", held)
    found = [grow(4_000_000), grow(0)]
    if loss == "squared":
        assert sizes[0] <= 240 and sizes[1] == 6000
    for a, b in zip(found[0].fit.trees, found[1].fit.trees, strict=True):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.allclose(a.value, b.value, atol=1e-9)
    assert found[0].scores == pytest.approx(found[1].scores)


def test_few_vectors_are_summed_in_one_stage(spark, monkeypatch):
    """Vectors of few tasks need no shuffle; the total is the same."""
    rows = cut_lineage(spark.range(100, numPartitions=7).select(F.col("id").cast("double").alias("v")))
    fn = lambda batches: (np.array([b["v"].sum(), len(b)]) for b in batches)
    monkeypatch.setattr(gram, "tree_merge", lambda *a: pytest.fail("merged by a shuffle"))
    assert gram.total_array(rows, fn, width=2).tolist() == [4950, 100]


# --- text -----------------------------------------------------------------------------------------------------------

def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stop_words_of_a_frame_shuffle_no_words(spark):
    """The rows of the anti join, nulls and shared keys included; distinct keys need no exploded words."""
    texts = [(1, " the cat \t sat the"), (2, None), (3, ""), (None, "the dog"), (4, "the the"), (5, "over\nthe  Moon")]
    words = spark.createDataFrame([("the",), ("cat",), (None,)], "word string")
    df = spark.createDataFrame(texts, "id long, t string")
    got = tx.remove_stopwords(df, "t", words, key="id", out="k")
    want = {(1, "sat"), (2, None), (3, ""), (None, ""), (4, ""), (5, "over Moon")}
    assert {(r["id"], r["k"]) for r in got.collect()} == want and "Generate" not in _plan(got)
    for more in ([(1, "the dog ran")], []):
        both = spark.createDataFrame(texts + more, "id long, t string")
        rows = [sorted(map(str, tx.remove_stopwords(both, "t", words, key="id", out="k", max_rows=n).collect())) for n in (10, 0)]
        assert rows[0] == rows[1]


def test_tf_of_a_large_vocabulary_is_counted_once(spark, monkeypatch):
    """A vocabulary above the limit gives the same rows, and the counts are made once."""
    df = cut_lineage(spark.createDataFrame([(i, f"a b{i % 3} c{i} a") for i in range(40)], "id long, t string"))
    vocab = tx.vocabulary(df, "t", 2)
    calls, cut = [], tx.cut_lineage
    monkeypatch.setattr(tx, "cut_lineage", lambda d: calls.append(1) or cut(d))
    rows = [sorted(map(str, tx.tf_idf(tx.tf(df, "id", "t", vocab, n, ["idf"]), vocab).collect())) for n in (1000, 1)]
    assert rows[0] == rows[1] and len(calls) == 1
    plain = tx.tf_idf(tx.tf(df, "id", "t", vocab), vocab)
    assert sorted(map(str, plain.select("id", "word", "n", "total", "tf", "idf", "tf_idf").collect())) == rows[0]
    assert _plan(tx.tf_idf(tx.tf(df, "id", "t", vocab, carry=["idf"]), vocab)).count("Join") == 1


def test_token_document_counts_are_made_once(spark):
    """Both sides have a row a word: one plain join, with no count of hot words before it."""
    df = cut_lineage(spark.createDataFrame([(i, f"a b{i % 3}") for i in range(40)], "id long, t string"))
    found = tx.doc_freq(df, tx.word_freq(df, "t", 2), "t", max_rows=1)
    assert {r["word"]: r["n_docs"] for r in found.collect()} == {"a": 40, "b": 40}  # digits are stripped
    assert "__salt" not in _plan(found)


def test_substrings_of_a_large_vocabulary_by_automaton(spark, monkeypatch):
    """More words than are broadcast to a join, in few bytes: the automaton counts them."""
    monkeypatch.setattr(tx, "BROADCAST_ROWS", 2)
    df = spark.createDataFrame([(1, "cats"), (2, "a cat"), (3, "sat")], "id long, t string")
    words = spark.createDataFrame([("cat",), ("a",), ("at",), ("s",)], "word string")
    monkeypatch.setattr(tx, "lookup_join", lambda *a, **k: pytest.fail("substrings were joined"))
    assert dict(tx.doc_freq(df, words, "t", "id", "substring").collect()) == {"cat": 2, "a": 3, "at": 3, "s": 2}


# --- clusters and neighbours ----------------------------------------------------------------------------------------

def test_nearest_centres_by_products():
    """The nearest centre of the differences, ties to the lowest, in a hundredth of their cells."""
    import tracemalloc

    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(3000, 64)), rng.normal(size=(49, 64))
    x[:20], c[7], c[30] = c[5], c[5], c[12] + 1e-13
    x[20:40] = c[12]
    want = np.concatenate([((x[lo:lo + 100, None, :] - c[None]) ** 2).sum(2).argmin(1) for lo in range(0, 3000, 100)])
    tracemalloc.start()
    got = cl._nearest(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, want) and peak < 12_000_000  # before: differences of 16 MB at once
    total = np.zeros((49, 65))
    cl._add_members(total, got, x)
    assert total[:, 0].sum() == 3000 and np.allclose(total[5, 1:], x[got == 5].sum(0))
    x[3, 2] = np.nan
    cl._add_members(other := np.zeros((49, 65)), got, x)
    assert np.isnan(other).sum() == 1


def test_silhouette_sums_mark_members_once_per_block(monkeypatch):
    """Marks of the clusters' members are made for blocks of 2,048 rows: before, again for every few rows of a long table."""
    rng = np.random.default_rng(7)
    x, ks = rng.normal(size=(6000, 3)), (2, 5, 9)
    tags = np.stack([rng.integers(0, k, 6000) for k in ks], axis=1)
    sizes, cells, zeros = [np.bincount(tags[:, j]) for j in range(3)], [], np.zeros
    monkeypatch.setattr(np, "zeros", lambda shape, *a: cells.append(np.prod(shape)) or zeros(shape, *a))
    got = nb._shape_sums(x, tags, tags, x, sizes)
    monkeypatch.setattr(np, "zeros", zeros)
    assert sum(cells) < 500_000  # before: 960,000 at ten steps
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for j, k in enumerate(ks):
        to, at = np.stack([d[:, tags[:, j] == c].sum(1) for c in range(k)], axis=1), np.arange(6000)
        a, to = to[at, tags[:, j]] / (sizes[j][tags[:, j]] - 1), to / sizes[j]
        to[at, tags[:, j]] = np.inf
        assert got[j] == pytest.approx(((to.min(1) - a) / np.maximum(a, to.min(1))).sum())


def test_nearest_centres_of_a_grid_are_those_of_each():
    rng = np.random.default_rng(3)
    x, grid = rng.normal(size=(500, 4)), [rng.normal(size=(k, 4)) for k in (1, 3, 8)]
    grid[2][5] = grid[2][1]
    x[:9], x[9, 0] = grid[2][1], np.nan
    near, ends = cl._nearest_grid(x, grid), np.array([0, 1, 4, 12])
    for j, c in enumerate(grid):
        assert np.array_equal(near[:, j], ((x[:, None] - c[None]) ** 2).sum(2).argmin(1))
    for rows in (x[10:], x):
        near, total, each = cl._nearest_grid(rows, grid), np.zeros((12, 5)), np.zeros((12, 5))
        cl._add_grid(total, near, rows, ends)
        for j in range(3):
            cl._add_members(each[ends[j]:ends[j + 1]], near[:, j], rows)
        assert np.allclose(total, each, equal_nan=True)


def test_lloyd_passes_are_one_stage(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = cut_lineage(spark.createDataFrame([([float(v) for v in r],) for r in rng.normal(size=(200, 3))], "x array<double>").repartition(4))
    monkeypatch.setattr(gram, "tree_merge", lambda *a: pytest.fail("merged by a shuffle"))
    assert [len(c) for c in cl.kmeans_grid(df, "x", [2, 5], [1, 1])] == [2, 5]


@pytest.mark.parametrize("by, barred", [(None, None), ("g", None), (None, "f")])
def test_visits_of_a_task_are_bounded(spark, monkeypatch, by, barred):
    """Parts of left rows shrink as the cells they may visit grow; the neighbours stay."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=4)], i % 3, i % 5) for i in range(300)]
    df = cut_lineage(spark.createDataFrame(rows, "id long, v array<double>, g int, f int"))
    same = barred or "id"
    plain = nb.knn_join(df, df, 3, "v", "id", by=by, exclude_same=same).select("id", "neighbour", "rank")
    monkeypatch.setattr(nb, "VISITS", 500)
    monkeypatch.setattr(nb, "BOUND_CELLS", 200)
    seen, visits = [], nb._visits
    monkeypatch.setattr(nb, "_visits", lambda *a: (seen.append(visits(*a)) or seen[-1]))
    cut = nb.knn_join(df, df, 3, "v", "id", by=by, exclude_same=same, max_rows=0, block_rows=40).select("id", "neighbour", "rank")
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, plain.collect()))
    assert "__part" in _plan(seen[0]) and "50000" not in _plan(seen[0])


def test_neighbours_without_structure_write_no_visits(spark, monkeypatch):
    """Every row has to see most cells of 12,000 normal vectors: before, that was a shuffled row of each with each cell."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12_000, 16)).astype("float32")
    x[50:60] = x[40:50]
    df = cut_lineage(spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "id long, v array<float>, f int").repartition(4))
    monkeypatch.setattr(nb, "_visits", lambda *a: pytest.fail("visits were written"))
    some = np.append(rng.choice(12_000, 60, False), [41, 51])
    d = np.sqrt(((x[some][:, None].astype(float) - x[None]) ** 2).sum(2))
    for barred, off in (("id", np.arange(12_000) == some[:, None]), ("f", np.arange(12_000) % 4 == some[:, None] % 4)):
        out = nb.knn_join(df, df, 5, "v", "id", exclude_same=barred, carry=["f"], max_rows=0, block_rows=400)
        rows = out.filter(F.col("id").isin([int(i) for i in some])).collect()
        assert out.count() == 60_000
        far = np.where(off, np.inf, d)
        got = {(r.id, r["rank"]): (r.neighbour, r.dist) for r in rows}
        for i, row in zip(some, far):
            want = np.lexsort((np.arange(12_000), row))[:5]
            assert [got[i, r][0] for r in range(1, 6)] == want.tolist()
            assert np.allclose([got[i, r][1] for r in range(1, 6)], row[want])
        assert all(r.f == r.neighbour % 4 for r in rows)


def test_approximate_neighbours_without_structure_reach_their_recall(spark, monkeypatch):
    """The rows that tell how many cells to visit are not the pivots, which lie nearer to their neighbours' cells."""
    monkeypatch.setattr(nb, "TRIED", 100)
    x = np.random.default_rng(5).normal(size=(4000, 64))
    df = cut_lineage(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4))
    exact, near = (nb.knn_join(df, df, 5, "v", "id", exclude_same="id", approx=a).select("id", "neighbour") for a in (False, True))
    assert exact.intersect(near).count() >= 0.9 * 20_000


@pytest.mark.parametrize("barred, approx", [("id", False), ("f", False), ("name", False), ("id", True)])
def test_streamed_neighbours_are_those_of_visits(spark, monkeypatch, barred, approx):
    """Small records, groups of near vectors, copies, nulls among the barred values and repeated keys of both sides."""
    rng = np.random.default_rng(2)
    base = np.round(rng.normal(size=(6, 4)) * 4, 1)
    rows = [(i if i % 50 else 7, (base[i % 6] + np.round(rng.normal(size=4), 9 if approx else 1)).tolist(), None if i % 9 == 0 else i % 4,
             None if i % 7 == 0 else "abc"[i % 3]) for i in range(500)]
    left = cut_lineage(spark.createDataFrame([r for r in rows if r[0] != 7], "id long, v array<double>, f int, name string").repartition(3))
    right = cut_lineage(spark.createDataFrame(rows, "id long, v array<double>, f int, name string").repartition(4))

    def found():
        out = nb.knn_join(left, right, 4, "v", "id", exclude_same=barred, carry=["name"], approx=approx, max_rows=0, block_rows=20,
                          probes=3 if approx else None)
        return sorted((r.id, r["rank"], r.neighbour, round(r.dist, 9), str(r.name)) for r in out.collect())

    want = found()
    for name, value in (("VISIT_ROWS", 0), ("VISIT_SHARE", 0), ("RECORD_BYTES", 8 * 4 * 60)):
        monkeypatch.setattr(nb, name, value)
    monkeypatch.setattr(nb, "_visits", lambda *a: pytest.fail("visits were written"))
    got = found()
    assert [r[:4] for r in got] == [r[:4] for r in want] and len(got) == 4 * 489
    monkeypatch.setattr(nb, "CELLS_LISTED", 1)
    assert approx or [r[:4] for r in found()] == [r[:4] for r in want]


def test_margin_passes_hold_few_scores(spark, monkeypatch):
    """Batches are cut so that rows times problems stay bounded; the fits are the same."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4))
    rows = [([float(v) for v in r], int(r[0] > 0) + int(r[1] > 0.5), i % 3) for i, r in enumerate(x)]
    df = cut_lineage(spark.createDataFrame(rows, "x array<double>, y int, fold int").repartition(2))
    problems = [mg.Problem(c, f, k) for c in (0.5, 2.0) for f in (-1, 1) for k in range(3)]
    want = mg.fit_grid(df, "x", "y", problems, "squared_hinge", "l2", "fold")
    monkeypatch.setattr(mg, "SCORE_CELLS", 100)
    got = mg.fit_grid(df, "x", "y", problems, "squared_hinge", "l2", "fold")
    assert all(np.allclose(got[p], want[p], atol=1e-6) for p in problems)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.999, 1.0])
def test_splits_compare_hex_digits(spark, share):
    """The rows of the number that the digits spell, without spelling it out."""
    df = spark.range(2000)
    digits = F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit("7"))), 1, 8)
    split = od.hash_split(df, "id", share, 7)
    assert "conv(" not in _plan(split)
    assert split.filter((F.conv(digits, 16, 10).cast("long") < int(share * 16 ** 8)).cast("int") != F.col("is_test")).isEmpty()


# --- margin fits ----------------------------------------------------------------------------------------------------

def test_l1_fits_of_like_columns_end(spark, monkeypatch):
    """Forty columns that are nearly multiples of one: before, 1000 passes did not end; now a few Hessians do."""
    rng = np.random.default_rng(0)
    x = 1 / rng.integers(1, 400, (600, 1)) * (1 + rng.poisson(0.05, (600, 40))) * (4.76 + 0.001 * rng.integers(0, 3, 40))
    y = (rng.random(600) < 0.55).astype(int)
    df = cut_lineage(spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y)], "x array<double>, y int"))
    passes, sums = [], mg._sums
    monkeypatch.setattr(mg, "_sums", lambda *a: passes.append(1) or sums(*a))
    w = mg.linear_svm_l1(df, "x", "y", 1.0).fit.weights[0]
    assert len(passes) < 60
    full, t = np.hstack([x, np.ones((600, 1))]), np.where(y == 1, 1.0, -1.0)
    slope = (-2 * t * np.maximum(1 - t * (full @ w), 0)) @ full
    assert np.allclose(slope[w != 0], -np.sign(w[w != 0]), atol=1e-6) and np.abs(slope).max() < 1 + 1e-6


def test_least_value_over_signs():
    """The minimum of a penalised quadratic form: its slopes against a form with a free, a singular and a null direction."""
    rng = np.random.default_rng(3)
    for rank in (12, 4):
        half, b = rng.normal(size=(rank, 12)), rng.normal(size=12) * 3
        half[:, 1] = half[:, 0]
        a, weigh = half.T @ half + 1e-9 * np.eye(12), np.append(np.ones(11), 0.0)
        for start in (np.zeros(12), rng.normal(size=12)):
            v = mg._least(a, b, weigh, start)
            slope, held = a @ v + b, v != 0
            assert np.allclose(slope[held], (-np.sign(v) * weigh)[held], atol=1e-4) and (np.abs(slope) <= weigh + 1e-4).all()
