"""The same answers on both sides of every size limit, and the corners that once differed."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import evaluate as ev
from millrace.operators import forecast as fc
from millrace.operators import joins as jn
from millrace.operators import margin as mg
from millrace.operators import neighbours as nb
from millrace.operators import order as od
from millrace.operators import stats as st
from millrace.operators import text as tx
from millrace.operators import trees as tr
from millrace.session import cut_lineage, new_path
from millrace.sources import readers as rd


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    data = [(k, rng.normal(size=3).tolist(), None if k % 5 == 0 else k % 3, None if k % 7 == 0 else "ab"[k % 2])
            for k in range(60)]
    return cut_lineage(spark.createDataFrame(data, "id long, v array<double>, fold int, side string"))


@pytest.mark.parametrize("by, barred", [(None, "fold"), ("fold", None), ("side", "fold"), ("fold", "side"), ("side", "id"),
                                        (None, "side"), (None, "id")])
def test_neighbours_agree_over_the_limit(points, by, barred):
    def found(rows):
        out = nb.knn_join(points, points, 3, "v", "id", by=by, exclude_same=barred, max_rows=rows, block_rows=16)
        return sorted((r.id, r["rank"], r.neighbour) for r in out.collect())

    under, over = found(1000), found(10)
    assert under == over and under
    if by is None:
        assert len({r[0] for r in under}) == 60


def test_wide_correlations_use_the_same_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 30)) + 100
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 3.0
    frame = pd.DataFrame(x, columns=[f"c{k}" for k in range(30)])
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x],
                               ", ".join(f"c{k} double" for k in range(30)))
    want = frame.corr()
    for n in (24, 25, 30):
        got = {(r.f1, r.f2): r.r for r in st.corr_matrix(df, [f"c{k}" for k in range(n)]).collect()}
        assert len(got) == n * n and got["c5", "c1"] is None
        for a, b in (("c0", "c1"), ("c3", "c17"), ("c20", "c21")):
            assert got[a, b] == pytest.approx(want[a][b])


def test_running_totals_pass_over_nulls(spark):
    data = [(k, None if k < 40 or k % 3 else k) for k in range(100)]
    df = spark.createDataFrame(data, "k int, v long")
    want = list(np.cumsum([v or 0 for _, v in data]))
    for limit in (1000, 10):
        got = [r.s for r in od.prefix_sums(df, "k", {"s": "v"}, max_rows=limit).orderBy("k").collect()]
        assert got == want


def test_stop_lists_of_any_length(spark):
    df = spark.createDataFrame([(1, "a w7 b w2500 c"), (2, "w1")], "id int, t string")
    for n in (2_000, 2_001, 3_000):
        listed = [f"w{k}" for k in range(n)]
        frame = spark.createDataFrame([(w,) for w in listed], "word string")
        short = [r.t for r in tx.remove_stopwords(df, "t", listed).orderBy("id").collect()]
        joined = [r.t for r in tx.remove_stopwords(df, "t", frame, key="id").orderBy("id").collect()]
        assert short == joined == ["a b c" if n == 3_000 else "a b w2500 c", ""]


def test_more_classes_than_the_old_limits(spark):
    df = spark.range(10_001).select((F.col("id") % 10_001).cast("int").alias("y"))
    weights = st.balanced_weights(df, "y")
    assert weights.filter("abs(weight - 1) < 1e-12").count() == 10_001
    some = spark.range(1_200).select(F.col("id").cast("int").alias("y"), (F.col("id") % 1_100).cast("int").alias("p"))
    grid = ev.confusion(some, "y", "p")
    assert grid.count() == 1_200 ** 2 and grid.agg(F.sum("n")).first()[0] == 1_200


def test_balanced_weights_without_a_label(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id int, y string")
    assert [r.weight for r in st.balanced_weights(df, "y").orderBy("id").collect()] == [0.75, 0.75, 1.5, None]


def test_hash_split_takes_all_or_nothing(spark):
    df = spark.range(1000)
    assert od.hash_split(df, "id", 1.0, 3).agg(F.sum("is_test")).first()[0] == 1000
    assert od.hash_split(df, "id", 0.0, 3).agg(F.sum("is_test")).first()[0] == 0


def test_complement(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id int, fold int")
    assert sorted(r.id for r in od.complement(df, "fold", 0).collect()) == [2, 3]


def test_separators_are_literal(spark, tmp_path):
    (tmp_path / "list.txt").write_text("ab|1\ncd|2\n")
    got = rd.read_list(spark, str(tmp_path / "list.txt"), sep="|", names=("name", "value")).collect()
    assert sorted(map(tuple, got)) == [("ab", "1"), ("cd", "2")]


def test_preamble_with_a_nested_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\ny\nh1,h2\n1,2\n3,4\n")
    schema = T.StructType([T.StructField("a:b", T.IntegerType()), T.StructField("c", T.DoubleType())])
    got = rd.read_delimited(spark, str(tmp_path / "a.csv"), schema, header=True, preamble=2).collect()
    assert sorted(map(tuple, got)) == [(1, 2.0), (3, 4.0)]


def test_posts_as_one_array(spark, tmp_path):
    posts = [{"id": 1, "created_at": "Mon", "sentiment": None, "links": [], "body": "x"},
             {"id": 2, "created_at": "Tue", "sentiment": {"class": "bullish"}, "links": [{"description": "d"}], "body": None}]
    (tmp_path / "posts.json").write_text(json.dumps(posts, indent=1))
    got = rd.read_posts(spark, str(tmp_path / "posts.json")).orderBy("id").collect()
    assert [(r.id, r.sentiment and r.sentiment["class"]) for r in got] == [(1, None), (2, "bullish")]


def test_grids_need_folds_and_skip_those_without_a_score(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 2))
    data = [(v.tolist(), float(v[0]) if k % 3 else 1.0, k % 3) for k, v in enumerate(x)]
    df = spark.createDataFrame(data, "x array<double>, y double, fold int")
    with pytest.raises(ValueError, match="gamma"):
        mg.rbf_svr(df, "x", "y", [1.0], [0.01, 5.0])
    scores = mg.rbf_svr(df, "x", "y", [0.1, 1.0], [0.5], "fold", 16).scores
    assert all(np.isfinite(v) for v in scores.values())


def test_the_filter_carries_its_estimate_over_gaps(spark):
    rng = np.random.default_rng(3)
    z = [None if k % 11 == 4 or k == 0 else float(v) for k, v in enumerate(rng.normal(5, 1, 120))]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(z)], "s int, k int, v double")
    for init in ("zero", "first"):
        whole, parts = ([r.smooth for r in fc.kalman_smooth(df, "v", "k", "s", init=init, max_rows=n).orderBy("k").collect()]
                        for n in (1000, 16))
        assert not np.isnan(whole).any() and np.allclose(whole, parts, atol=1e-12)
        assert whole[4] == whole[3] and whole[15] == whole[14]


def test_first_price_of_a_day_is_the_first_in_order(spark):
    posts = spark.createDataFrame([(1, 5)], "id int, day int")
    prices = spark.createDataFrame([(5, 2, 20.0), (5, 1, 10.0)], "day int, at int, close double")
    assert jn.attach_labels(posts, prices, "at").first().close == 10.0


def test_boosting_starts_at_the_mean(spark):
    df = spark.createDataFrame([([float(k % 2)], 5000.0 + 10 * (k % 2)) for k in range(64)], "x array<double>, y double")
    fit = tr.boost_reg(df, "x", "y", 0.0, n_trees=2, depth=1).fit
    got = [r.prediction for r in fit.transform(df, "x").collect()]
    assert all(abs(v - 5005) < 6 for v in got)


def test_scratch_paths_share_a_folder(spark):
    assert new_path(spark, "a").rsplit("/", 1)[0] == new_path(spark, "b").rsplit("/", 1)[0]
