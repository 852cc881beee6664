"""Sources on hand-made files, text steps, edge rows, streams, plan shapes."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import arrays as fa
from millrace.functions import text as ft
from millrace.operators import evaluate as ev
from millrace.operators import forecast as fc
from millrace.operators import images as im
from millrace.operators import joins as jn
from millrace.operators import order as od
from millrace.operators import relational as rl
from millrace.operators import series as se
from millrace.operators import stats as st
from millrace.operators import text as tx
from millrace.plans.catalog import queries
from millrace.sources import readers as rd
from millrace.streaming import posts as sp


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_missing_tokens(spark, tmp_path):
    (tmp_path / "m.csv").write_text("a,1,?,3,?\nb,?,2,4,?\nc,5,6,?,?\n")
    df = rd.read_delimited(spark, str(tmp_path / "m.csv"), "k string, x double, y double, z double, e double", na="?")
    assert rows(df.select("k", "x", "y")) == [("a", 1.0, None), ("b", None, 2.0), ("c", 5.0, 6.0)]
    full = st.impute_mean(df, ["x", "y", "z", "e"])
    assert rows(full.select("k", "x", "y", "z")) == [("a", 1.0, 4.0, 3.0), ("b", 3.0, 2.0, 4.0), ("c", 5.0, 6.0, 3.5)]
    assert full.filter("e is not null").count() == 0
    assert rows(st.impute_mean(df.filter("k = 'b'"), "x", fit_on=df).select("x")) == [(3.0,)]


@pytest.mark.parametrize("split", [None, "700"])
def test_preamble(spark, tmp_path, split):
    head = "".join(f"line {i}, with commas,\n" for i in range(20)) + "class,v\n"
    for part in range(2):
        body = "".join(f"{'neg' if i % 2 else 'pos'},{'na' if i % 3 == 0 else i + 100 * part}\n" for i in range(100))
        (tmp_path / f"p{part}.csv").write_text(head + body)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "600")
    try:
        df = rd.read_delimited(spark, str(tmp_path), "class string, v int", na="na", header=True, preamble=20)
        got = rows(df.groupBy("class").agg(F.count(F.lit(1)), F.sum("v")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(c, 100, sum(i + 100 * p for p in range(2) for i in range(100) if (i % 2 == 1) == (c == "neg") and i % 3)) for c in ("neg", "pos")]
    assert got == want


def test_posts_file(spark, tmp_path):
    posts = [{"id": 1, "created_at": "Fri, 03 Jan 2014 09:00:00", "sentiment": None, "links": []},
             {"id": 2, "created_at": "Sat, 04 Jan 2014 09:00:00", "sentiment": {"class": "bullish"}, "links": [{"description": "buy $ME now"}]},
             {"id": 3, "created_at": "Sat, 04 Jan 2014 10:00:00", "sentiment": {"class": "bearish"}, "links": [{"description": None}]},
             {"id": 4, "created_at": "Sun, 05 Jan 2014 10:00:00", "sentiment": {"class": "bullish"}, "links": [{"description": "ME and $OTHER"}]},
             {"id": 5, "created_at": "Sun, 05 Jan 2014 11:00:00", "sentiment": None, "links": [{"description": "ME"}]}]
    (tmp_path / "posts.json").write_text(json.dumps(posts))
    df = rd.read_posts(spark, str(tmp_path / "posts.json"))
    coded = rl.sentiment_code(df, "sentiment")
    assert [r["code"] for r in coded.orderBy("id").collect()] == [0, 1, 2, 1, 0]
    assert [r["day"] for r in rl.post_day(df).orderBy("id").collect()] == [20140103, 20140104, 20140104, 20140105, 20140105]
    text = df.withColumn("t", ft.first_field(F.col("links"), "description"))
    steps = text.select("id", ft.null_if_contains(ft.remove_names(ft.without_words(F.col("t"), ["and"]), ["$ME", "ME"]), "$").alias("t"))
    assert rows(steps) == [(1, None), (2, "buy  now"), (3, None), (4, None), (5, None)]
    clean = tx.clean_posts(text, "t", ["and"], ["$ME", "ME"])
    assert rows(clean.select("id", "clean")) == [(2, "buy  now")]


def test_lists_and_images(spark, tmp_path):
    (tmp_path / "names").write_text("alpha 1.5 x\nbeta 2\n\n")
    got = rd.read_list(spark, str(tmp_path / "names"), sep=" ", names=("name", "value"))
    assert rows(got) == [("alpha", "1.5"), ("beta", "2")]
    assert rows(rd.read_list(spark, str(tmp_path / "names"))) == [("alpha 1.5 x",), ("beta 2",)]
    img = spark.createDataFrame([(2, list(range(12))), (1, [0] * 12)], "labels int, data array<int>")
    for part in range(2):
        rd.write_table(img, str(tmp_path / f"batch_{part}"))
    back = rd.read_images(spark, str(tmp_path / "batch_*"), label=2)
    assert back.count() == 2
    px = rows(im.pixels(back.limit(1), "labels", "data", 4))
    assert px == [(2, i, i, i + 4, i + 8) for i in range(4)]
    gray = im.grayscale(back.limit(1), "data", 4).first()["gray"]
    assert np.allclose(gray, [0.2989 * i + 0.5870 * (i + 4) + 0.1140 * (i + 8) for i in range(4)])
    with pytest.raises(Exception, match="wrong length"):
        im.check_planar(back, "data", 3072).collect()


def test_prices_and_labels(spark, tmp_path):
    (tmp_path / "prices.csv").write_text("Date,CLOSE\n" + "".join(
        f"2014-01-{d:02d},{c}\n" for d, c in [(2, 10), (3, 11), (6, 9), (7, 12), (7, 99), (8, 8), (9, 14), (10, 13), (13, 15)]))
    raw = rd.read_delimited(spark, str(tmp_path / "prices.csv"), "Date date, CLOSE double", header=True)
    prices = jn.first_per_day(rl.day_key(raw, "Date"), "day", "CLOSE")
    assert prices.count() == 8 and rows(prices.filter("day = 20140107").select("CLOSE")) == [(12.0,)]
    out = rl.sign_labels(se.forward_return(prices, "CLOSE", [3, 5], "day"), "rt_3", "rt_5").orderBy("day").collect()
    close = [10, 11, 9, 12, 8, 14, 13, 15]
    for i, r in enumerate(out):
        assert r["rt_3"] == ((close[i + 3] - close[i]) / close[i] if i + 3 < 8 else None)
        known = i + 5 < 8
        assert (r["up_1"], r["up_2"]) == ((int(close[i + 3] > close[i]), int(close[i + 5] > close[i])) if known else (0, 0))
    posts = spark.createDataFrame([(1, 20140103), (2, 20140104), (3, 20140107)], "id int, day int")
    assert rows(jn.on_trading_days(posts, prices).select("id")) == [(1,), (3,)]
    assert rows(jn.attach_labels(posts, prices, "CLOSE").select("id", "CLOSE")) == [(1, 11.0), (3, 12.0)]


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "k int, x double, s string, v array<double>")
    assert st.coef_variation(empty, ["x"]).first()["cv"] is None
    assert st.box_stats(empty, ["x"]).first()["median"] is None
    assert od.with_position(empty, "k").count() == 0
    assert od.with_position(empty, "k", max_rows=-1).count() == 0
    assert od.contiguous_folds(empty, "k", 3).count() == 0
    assert tx.word_freq(empty, "s").count() == 0
    assert st.impute_mean(empty, "x").count() == 0
    assert ev.auc(empty.select(F.lit(1).alias("y"), "x"), "y", "x").first()[0] is None
    assert fc.kalman_smooth(empty, "x", "k").count() == 0
    one = spark.createDataFrame([(1, 5.0, 0)], "k int, x double, y int")
    assert st.coef_variation(one, ["x"]).first()["cv"] == 0.0
    assert se.moving_avg(one, "x", 3, "k").first()["ma"] is None
    assert se.lag_windows(one, "x", 2, "k").count() == 0
    assert ev.auc(one, "y", "x").first()[0] is None and ev.auc_hard(one, "y", "y").first()["auc"] is None
    assert fc.kalman_smooth(one, "x", "k", init="first").first()["smooth"] == 5.0


def test_zero_mean_and_constant(spark):
    df = spark.createDataFrame([(-1.0, 2.0), (1.0, 2.0)], "a double, b double")
    assert dict(rows(st.coef_variation(df, ["a", "b"]))) == {"a": None, "b": 0.0}
    got = {(r["f1"], r["f2"]): r["r"] for r in st.corr_matrix(df, ["a", "b"]).collect()}
    assert got["a", "a"] == 1.0 and got["a", "b"] is None
    const = spark.createDataFrame([(i, 3.0) for i in range(30)], "t int, x double")
    assert fc.adf_test(const, "x", "t", max_lag=0).first()["stat"] is None
    assert se.acf(const, "x", 2, "t").first()["rho"] is None


def test_group_mode_ties(spark):
    df = spark.createDataFrame([(1, "b", "x"), (1, "a", None), (1, "b", "y"), (1, "a", "y"), (2, None, "z")], "g int, p string, q string")
    assert rows(st.group_mode(df, "g", ["p", "q"])) == [(1, "a", "y"), (2, None, "z")]


def test_wide_correlation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 30)) + 5
    x[:, 3] = 1.0
    names = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in x], names)
    got = {(r["f1"], r["f2"]): r["r"] for r in st.corr_matrix(df, names).collect()}
    small = {(r["f1"], r["f2"]): r["r"] for r in st.corr_matrix(df, names[:8]).collect()}
    assert len(got) == 900 and got["c3", "c1"] is None
    assert all(got[k] is v is None or abs(got[k] - v) < 1e-10 for k, v in small.items())


def test_label_codes(spark):
    from millrace.functions.labels import FAMILY_CODES, GENUS_CODES, SPECIES_CODES

    for codes in (FAMILY_CODES, GENUS_CODES, SPECIES_CODES):
        df = spark.createDataFrame([(k,) for k in codes] + [("other",)], "name string")
        out = dict(rows(rl.recode(df, "name", codes, "code").select("name", "code")))
        assert out == {**codes, "other": None} and sorted(codes.values()) == list(range(len(codes)))


def test_row_correlation(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 8))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(6)], "id int, v array<double>")
    want = np.corrcoef(x)
    got = {(r["id1"], r["id2"]): r["r"] for r in st.row_correlation(df, "id", "v", [1, 4]).collect()}
    assert len(got) == 12 and all(abs(r - want[i, j]) < 1e-12 for (i, j), r in got.items())
    mean = {r["id"]: r["mean_r"] for r in st.row_correlation_mean(df, "id", "v").collect()}
    assert all(abs(mean[i] - want[i].mean()) < 1e-12 for i in range(6))


def test_scores_with_absent_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    report = {r["class"]: r for r in ev.class_report(df, "y", "p").collect()}
    assert report["c"]["precision"] == 0.0 and report["c"]["recall"] == 0.0 and report["b"]["recall"] == 1.0
    macro = ev.macro_scores(df, "y", "p").first()
    assert abs(macro["macro_precision"] - (1 + 1 / 3 + 0) / 3) < 1e-12 and abs(macro["macro_recall"] - 0.5) < 1e-12
    assert sum(r["n"] for r in ev.confusion(df, "y", "p").collect()) == 4 and ev.confusion(df, "y", "p").count() == 9


def test_hamming_lengths(spark):
    df = spark.createDataFrame([([1, 2], [1, 3])], "a array<int>, b array<int>")
    assert df.select(fa.hamming_distance(F.col("a"), F.col("b"))).first()[0] == 1
    with pytest.raises(Exception, match="differ in length"):
        df.select(fa.hamming_distance(F.col("a"), F.array(F.lit(1)))).collect()


def test_stopword_orders(spark):
    df = spark.createDataFrame([(1, "a  b the\tb"), (2, "the"), (3, None), (4, "")], "id int, t string")
    short = rows(tx.remove_stopwords(df, "t", ["the"]).filter("t is not null"))
    frame = spark.createDataFrame([("the",)], "word string")
    long = rows(tx.remove_stopwords(df, "t", frame, key="id").select("id", "t").filter("t is not null"))
    assert short == long == [(1, "a b b"), (2, ""), (4, "")]


def test_select_top_counts_words(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, "dd")], "id int, t string")
    vocab = tx.vocabulary(df, "t", 1)
    kept = tx.tf(df, "id", "t", vocab)
    scores = tx.chisq_words(df, "id", "t", vocab, kept)
    top = {r["id"]: r["vec"] for r in tx.select_top(df, "id", "t", vocab, scores, 2).collect()}
    words = [r["word"] for r in tx.selected_words(scores, 2).collect()][::-1]
    idf = {r["word"]: r["idf"] for r in vocab.collect()}
    for key, text in ((1, "aa bb aa"), (2, "bb cc"), (3, "dd")):
        parts = text.split()
        assert np.allclose(top[key], [(parts.count(w) + 1) / (2 * len(parts)) * idf[w] for w in words])
    grid = np.array([[(t.split().count(w) + 1) / (2 * len(t.split())) * idf[w] for w in sorted(idf)] for t in ("aa bb aa", "bb cc", "dd")])
    want = dict(zip(sorted(idf), ((grid - grid.mean(0)) ** 2).sum(0) / grid.mean(0)))
    assert all(abs(r["chisq"] - want[r["word"]]) < 1e-12 for r in scores.collect())


def test_partitioning_does_not_matter(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    fns = [lambda d: od.contiguous_folds(d, ["ts", "event_id"], 7).select("event_id", "fold"),
           lambda d: od.hash_split(d, "event_id", 0.3, 5).select("event_id", "is_test"),
           lambda d: se.rel_change(d, "value", ["ts", "event_id"], "user_id").select("event_id", "change")]
    for fn in fns:
        assert rows(fn(events.repartition(1))) == rows(fn(events.repartition(7)))


def _stream(spark, tmp_path, df, slices, order):
    """The rows of `df` in order as one file per slice, read one file per batch."""
    src = tmp_path / "src"
    src.mkdir()
    n = df.count()
    placed = od.with_position(df, order)
    for i in range(slices):
        part = placed.filter((F.col("pos") >= n * i // slices) & (F.col("pos") < n * (i + 1) // slices)).drop("pos")
        part.coalesce(1).write.mode("append").parquet(str(src))
        newest = max(src.glob("*.parquet"), key=os.path.getmtime)
        os.utime(newest, (1_000_000 + i, 1_000_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def _drain(df, tmp_path, spark):
    out = str(tmp_path / "out")
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def test_stream_daily_posts(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type")
    stream = _stream(spark, tmp_path, events, 6, ["ts", "event_id"])
    tagged = F.col("event_type").isin("click", "error")
    got = rows(_drain(sp.daily_posts(stream, "ts", F.col("event_type") == "click", tagged), tmp_path, spark))
    batch = rl.day_key(events, "ts").groupBy("day").agg(
        F.count(F.lit(1)), F.avg(F.when(tagged, F.when(F.col("event_type") == "click", 1.0).otherwise(-1.0))))
    want = [r for r in rows(batch) if r[0] <= got[-1][0]]
    assert len(got) >= 20 and np.allclose(got, want)


def test_stream_kalman(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    stream = _stream(spark, tmp_path, events, 3, "event_id")
    got = rows(_drain(sp.kalman_stream(stream, "value", "event_id", "event_type"), tmp_path, spark).select("event_id", "smooth"))
    want = rows(fc.kalman_smooth(events, "value", "event_id", "event_type").select("event_id", "smooth"))
    assert got == want


PLANNED = ["impute_mean", "coef_variation", "group_mode", "word_freq", "attach_labels", "lag_windows", "class_report",
           "knn_join_cells", "tf_idf", "majority_hamming"]


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_cartesian(spark, sf_dir, name):
    plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_is_pruned(spark, sf_dir):
    plan = queries()["row_filters"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "l_returnflag" in plan.split("PushedFilters")[1]
    assert "l_shipdate" not in plan.split("ReadSchema")[1]
