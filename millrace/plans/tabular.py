"""Queries over tables: scans, cleaning, statistics, joins, splits, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as fa
from ..operators import evaluate as ev
from ..operators import joins as jn
from ..operators import order as od
from ..operators import relational as rl
from ..operators import resample as rs
from ..operators import stats as st
from ..session import cut_lineage, new_path
from ..sources import readers as rd
from .registry import Tables, query

FEATURES = ["quantity", "discount", "tax", "linenumber"]
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]

# The feature table with nulls: first lines have no quantity, returned lines no tax.
BASE = """base AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
         CASE WHEN l_linenumber <> 1 THEN l_quantity END AS quantity, l_discount AS discount,
         CASE WHEN l_returnflag <> 'R' THEN l_tax END AS tax,
         CAST(l_linenumber AS DOUBLE) AS linenumber, l_extendedprice AS price
  FROM lineitem)"""

IMPUTED = BASE + """, means AS (
  SELECT avg(quantity) AS mq, avg(discount) AS md, avg(tax) AS mt, avg(linenumber) AS ml FROM base),
imputed AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, coalesce(quantity, mq) AS quantity,
         coalesce(discount, md) AS discount, coalesce(tax, mt) AS tax, coalesce(linenumber, ml) AS linenumber, price
  FROM base CROSS JOIN means)"""

# Three label columns with one prediction each, derived from the line items.
SCORED = """scored AS (
  SELECT CAST(l_linenumber % 4 AS INT) AS y1, CAST(CAST(l_quantity AS BIGINT) % 4 AS INT) AS p1,
         CAST(l_suppkey % 3 AS INT) AS y2, CAST(l_partkey % 3 AS INT) AS p2,
         CAST(l_returnflag = 'R' AS INT) AS y, CAST(l_discount >= 0.05 AS INT) AS p, l_discount AS score,
         l_extendedprice / 1000 AS actual, l_quantity * 1.5 AS predicted
  FROM lineitem)"""


def base(t: Tables) -> DataFrame:
    return t.lineitem.select(
        *ORDER, F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("tax"),
        F.col("l_linenumber").cast("double").alias("linenumber"), F.col("l_extendedprice").alias("price"))


def imputed(t: Tables) -> DataFrame:
    return st.impute_mean(base(t), FEATURES)


def scored(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.select(
        (c("l_linenumber") % 4).cast("int").alias("y1"), (c("l_quantity").cast("bigint") % 4).cast("int").alias("p1"),
        (c("l_suppkey") % 3).cast("int").alias("y2"), (c("l_partkey") % 3).cast("int").alias("p2"),
        (c("l_returnflag") == "R").cast("int").alias("y"), (c("l_discount") >= 0.05).cast("int").alias("p"),
        c("l_discount").alias("score"), (c("l_extendedprice") / 1000).alias("actual"),
        (c("l_quantity") * 1.5).alias("predicted"))


def _round(df: DataFrame, cols, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in ([cols] if isinstance(cols, str) else cols)})


# --- scans and sinks ----------------------------------------------------------------------

_LINES = "l_orderkey bigint, l_linenumber int, l_partkey bigint, quantity double, tax double"
_LINES_SQL = f"WITH {BASE} SELECT l_orderkey, l_linenumber, l_partkey, quantity, tax FROM base"


def _marked(t: Tables, token: str) -> DataFrame:
    """The feature table as text columns with a missing-value token."""
    mark = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(token)).alias(c)
    return base(t).select("l_orderkey", "l_linenumber", "l_partkey", mark("quantity"), mark("tax"))


@query("scan_delimited", _LINES_SQL)
def _(t):
    path = new_path(t.spark, "delimited")
    rd.write_table(_marked(t, "?"), path, "csv", header=False)
    return rd.read_delimited(t.spark, path, _LINES, na="?")


@query("scan_preamble", _LINES_SQL)
def _(t):
    path = new_path(t.spark, "preamble")
    lines = _marked(t, "na")
    names = ",".join(lines.columns)
    body = lines.select(F.concat_ws(",", *lines.columns).alias("value"))

    def with_preamble(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [f"note {i}, any, text, with, commas" for i in range(20)] + [names]})
        yield from batches

    body.mapInPandas(with_preamble, "value string").write.text(path)
    return rd.read_delimited(t.spark, path, _LINES, na="na", header=True, preamble=20)


@query("scan_header_csv", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def _(t):
    path = new_path(t.spark, "header")
    rd.write_table(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path, "csv")
    return rd.read_delimited(
        t.spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string", header=True)


@query("scan_list", "SELECT s_name AS name, s_acctbal AS value FROM supplier")
def _(t):
    path = new_path(t.spark, "list")
    t.supplier.select(F.concat_ws(" ", "s_name", F.col("s_acctbal").cast("string")).alias("value")).write.text(path)
    pairs = rd.read_list(t.spark, path, sep=" ", names=("name", "value"))
    return pairs.select("name", F.col("value").cast("double").alias("value"))


@query("json_field", "SELECT event_id, CAST(props ->> '$.k' AS INT) AS k FROM events")
def _(t):
    return rl.json_field(t.events.select("event_id", "props"), "props", "k int").select("event_id", "k")


@query("write_table", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def _(t):
    path = new_path(t.spark, "customers")
    rd.write_table(t.customer, path, "parquet")
    back = t.spark.read.schema(t.customer.schema).parquet(path)
    return back.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


# --- projections and filters --------------------------------------------------------------


@query("split_features", """SELECT l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem""")
def _(t):
    return rl.split_features(t.lineitem, 3, 7, "l_returnflag")


@query("nullify", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders")
def _(t):
    return rl.nullify(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F")


@query("recode", """SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2
                    ELSE -1 END AS code FROM events""")
def _(t):
    coded = rl.recode(t.events, "event_type", {"view": 0, "click": 1, "purchase": 2}, "code", default=-1)
    return coded.select("event_id", "code")


@query("row_filters", """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
   WHERE l_returnflag = 'A' AND l_linestatus <> 'O' AND l_quantity >= 10 AND l_discount > 0.02 AND l_discount <= 0.06""")
def _(t):
    c = F.col
    return t.lineitem.filter(
        (c("l_returnflag") == "A") & (c("l_linestatus") != "O") & (c("l_quantity") >= 10)
        & (c("l_discount") > 0.02) & (c("l_discount") <= 0.06)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("drop_missing", f"""WITH {BASE} SELECT l_orderkey, l_linenumber, quantity, tax FROM base
   WHERE quantity IS NOT NULL AND tax IS NOT NULL""")
def _(t):
    return rl.drop_missing(base(t).select("l_orderkey", "l_linenumber", "quantity", "tax"))


@query("sentiment_code", """SELECT event_id, CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'error' THEN 2
                            ELSE 0 END AS code FROM events""")
def _(t):
    return rl.sentiment_code(sentiment(t), "sentiment").select("event_id", "code")


def sentiment(t: Tables) -> DataFrame:
    """Events as posts: a click is a bullish tag, an error a bearish one, the rest are untagged."""
    tag = F.when(F.col("event_type") == "click", F.struct(F.lit("bullish").alias("class"))).when(
        F.col("event_type") == "error", F.struct(F.lit("bearish").alias("class")))
    return t.events.select("event_id", "ts", tag.alias("sentiment"))


@query("day_key", "SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INT) AS day FROM events")
def _(t):
    text = t.events.select("event_id", F.date_format("ts", "dd MMM yyyy").alias("created_at"))
    return rl.day_key(text, "created_at", "dd MMM yyyy").select("event_id", "day")


@query("post_day", "SELECT event_id, CAST(strftime(ts, '%Y%m%d') AS INT) AS day FROM events")
def _(t):
    text = t.events.select("event_id", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss").alias("created_at"))
    return rl.post_day(text).select("event_id", "day")


@query("round_cols", """SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8, 2) AS x FROM lineitem""")
def _(t):
    eighths = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 8).alias("x"))
    return rl.round_cols(eighths, "x", 2)


@query("math_columns", """SELECT o_orderkey, round(ln(o_totalprice), 6) AS log_price, round(sqrt(o_totalprice), 5) AS root,
   round(exp(ln(o_totalprice)), 2) AS price, round(abs(250000 - o_totalprice), 2) AS gap FROM orders""")
def _(t):
    x = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", F.round(F.log(x), 6).alias("log_price"), F.round(F.sqrt(x), 5).alias("root"),
        F.round(F.exp(F.log(x)), 2).alias("price"), F.round(F.abs(250000 - x), 2).alias("gap"))


@query("binarize", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS hit,
   CASE WHEN abs(l_discount - 0.05) > 0.02 THEN 1 ELSE 0 END AS far FROM lineitem""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount",
                           (F.col("l_discount") - 0.05).alias("off"))
    df = rl.binarize(rl.binarize(df, "l_discount", 0.05), "off", 0.02, absolute=True, out="far")
    return df.drop("l_discount", "off")


@query("reindex_range", """SELECT i.k AS c_custkey, c.c_name FROM range(2000) i(k) LEFT JOIN customer c ON c.c_custkey = i.k""")
def _(t):
    return rl.reindex_range(t.customer.select("c_custkey", "c_name"), "c_custkey", 2000)


@query("union_all", """SELECT 'c' AS side, c_nationkey AS nation, c_acctbal AS bal FROM customer
                       UNION ALL SELECT 's', s_nationkey, s_acctbal FROM supplier""")
def _(t):
    left = t.customer.select(F.lit("c").alias("side"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    right = t.supplier.select(F.lit("s").alias("side"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    return left.unionByName(right)


# --- statistics ---------------------------------------------------------------------------


@query("impute_mean", f"""WITH {IMPUTED} SELECT l_orderkey, l_linenumber, l_partkey, round_even(quantity, 2) AS quantity,
   round_even(tax, 2) AS tax FROM imputed""")
def _(t):
    return rl.round_cols(imputed(t), ["quantity", "tax"], 2).select(
        "l_orderkey", "l_linenumber", "l_partkey", "quantity", "tax")


@query("impute_fit_rows", f"""WITH {BASE}, placed AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber,
   l_partkey, l_suppkey, l_shipdate) AS place FROM base), m AS (SELECT avg(quantity) AS q FROM placed WHERE place > 5)
   SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(quantity, q), 6) AS quantity FROM placed CROSS JOIN m""")
def _(t):
    placed = od.with_position(base(t), ORDER)
    filled = st.impute_mean(placed, "quantity", fit_where=F.col("pos") >= 5)
    return _round(filled, "quantity").select("l_orderkey", "l_linenumber", "l_partkey", "quantity")


_CV = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(stddev_pop({f}) / avg({f}), 6) AS cv FROM imputed" for f in FEATURES)


@query("coef_variation", f"WITH {IMPUTED} {_CV}")
def _(t):
    return _round(st.coef_variation(imputed(t), FEATURES), "cv")


@query("top_features", f"WITH {IMPUTED}, cv AS ({_CV}) SELECT feature, cv FROM cv ORDER BY cv DESC, feature LIMIT 2")
def top_features(t):
    return _round(rl.top_features(st.coef_variation(imputed(t), FEATURES), 2), "cv")


@query("name_features", f"""WITH {IMPUTED}, cv AS ({_CV}), named AS (
   SELECT * FROM (VALUES (0, 'quantity'), (1, 'discount'), (2, 'tax'), (3, 'linenumber')) v(idx, feature))
   SELECT idx, 'l_' || feature AS name, cv FROM cv JOIN named USING (feature)""")
def _(t):
    stats = _round(st.coef_variation(imputed(t), FEATURES), "cv")
    stats = rl.recode(stats, "feature", {f: i for i, f in enumerate(FEATURES)}, "idx")
    names = t.spark.createDataFrame([(i, f"l_{f}") for i, f in enumerate(FEATURES)], "idx int, name string")
    return jn.name_features(stats.select("idx", "cv"), names)


@query("corr_matrix", f"WITH {IMPUTED} " + " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, round(corr({a}, {b}), 6) AS r FROM imputed" for a in FEATURES for b in FEATURES))
def _(t):
    return _round(st.corr_matrix(imputed(t), FEATURES), "r")


@query("row_correlation_mean", """WITH m AS MATERIALIZED (SELECT vec_id, embedding, list_avg(embedding) AS a FROM embeddings),
   c AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) - a) AS u FROM m),
   z AS MATERIALIZED (SELECT vec_id, sqrt(list_inner_product(u, u)) AS s, u FROM c),
   n AS MATERIALIZED (SELECT vec_id, list_transform(u, lambda x: x / s) AS u FROM z)
   SELECT a.vec_id AS id, round(avg(list_inner_product(a.u, b.u)), 6) AS mean_r FROM n a CROSS JOIN n b GROUP BY 1""")
def _(t):
    return _round(st.row_correlation_mean(vectors(t), "vec_id", "embedding"), "mean_r")


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")


@query("count_by", "SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2")
def _(t):
    return rl.count_by(t.lineitem, ["l_returnflag", "l_linestatus"])


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"))


_MODE = lambda col: f"""SELECT k, v FROM (SELECT o_orderpriority AS k, {col} AS v, row_number() OVER (
   PARTITION BY o_orderpriority ORDER BY count(*) DESC, {col}) AS rn FROM o GROUP BY 1, 2) q WHERE rn = 1"""  # noqa: E731


@query("group_mode", f"""WITH o AS (SELECT o_orderpriority, o_orderstatus AS a, strftime(o_orderdate, '%Y') AS b,
   strftime(o_orderdate, '%m') AS c FROM orders) SELECT a.k AS o_orderpriority, a.v AS a, b.v AS b, c.v AS c FROM
   ({_MODE('a')}) a JOIN ({_MODE('b')}) b ON a.k = b.k JOIN ({_MODE('c')}) c ON a.k = c.k""")
def _(t):
    return st.group_mode(_triples(t), "o_orderpriority", ["a", "b", "c"])


def _triples(t: Tables) -> DataFrame:
    return t.orders.select("o_orderpriority", F.col("o_orderstatus").alias("a"),
                           F.date_format("o_orderdate", "yyyy").alias("b"), F.date_format("o_orderdate", "MM").alias("c"))


@query("majority_hamming", f"""WITH o AS (SELECT o_orderpriority, o_orderstatus AS a, strftime(o_orderdate, '%Y') AS b,
   strftime(o_orderdate, '%m') AS c FROM orders) SELECT o.o_orderpriority,
   round(avg((o.a <> a.v)::INT + (o.b <> b.v)::INT + (o.c <> c.v)::INT), 6) AS distance,
   round(avg(((o.a <> a.v)::INT + (o.b <> b.v)::INT + (o.c <> c.v)::INT) / 3.0), 6) AS loss FROM o
   JOIN ({_MODE('a')}) a ON a.k = o.o_orderpriority JOIN ({_MODE('b')}) b ON b.k = o.o_orderpriority
   JOIN ({_MODE('c')}) c ON c.k = o.o_orderpriority GROUP BY 1""")
def _(t):
    return _round(ev.majority_hamming(_triples(t), "o_orderpriority", ["a", "b", "c"]), ["distance", "loss"])


@query("repeat_stats", """SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std
   FROM lineitem GROUP BY 1""")
def _(t):
    return _round(st.repeat_stats(t.lineitem, "l_returnflag", "l_quantity"), ["mean", "std"])


_BOXED = {"quantity": "l_quantity", "price": "l_extendedprice", "tax": "l_tax"}
_BOX = " UNION ALL ".join(f"""SELECT '{f}' AS feature, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median,
   quantile_cont({c}, 0.75) AS q3 FROM lineitem""" for f, c in _BOXED.items())
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({c} AS DOUBLE) AS x FROM lineitem" for f, c in _BOXED.items())


@query("box_stats", f"""WITH q AS ({_BOX}), v AS ({_LONG}) SELECT feature, round(q1, 4) AS q1, round(median, 4) AS median,
   round(q3, 4) AS q3, min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
   max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
   count(*) FILTER (NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
   FROM q JOIN v USING (feature) GROUP BY feature, q1, median, q3""")
def _(t):
    return _round(st.box_stats(_boxed(t), list(_BOXED)), ["q1", "median", "q3"], 4)


def _boxed(t: Tables) -> DataFrame:
    return t.lineitem.select(*[F.col(c).alias(f) for f, c in _BOXED.items()])


@query("box_outliers", """WITH v AS (SELECT event_id, value, exp(value / 50) AS x FROM events), q AS (SELECT
   quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v) SELECT event_id, 'x' AS feature, round(x, 4) AS value
   FROM v CROSS JOIN q WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)""")
def _(t):
    skewed = t.events.select("event_id", F.exp(F.col("value") / 50).alias("x"))
    return _round(st.box_outliers(skewed, "event_id", "x"), "value", 4)


@query("chisq_uniform", """WITH c AS (SELECT generate_subscripts(embedding, 1) - 1 AS idx,
   CAST(unnest(embedding) AS DOUBLE) + 1 AS x FROM embeddings)
   SELECT CAST(idx AS INT) AS idx, round(count(*) * var_pop(x) / avg(x), 6) AS chisq FROM c GROUP BY 1""")
def _(t):
    shifted = vectors(t).select(F.transform("embedding", lambda x: x + 1.0).alias("v"))
    return _round(st.chisq_uniform(shifted, "v"), "chisq")


@query("scatter_points", """SELECT 'quantity' AS feature, l_quantity AS x, l_extendedprice AS y FROM lineitem
   UNION ALL SELECT 'discount', l_discount, l_extendedprice FROM lineitem""")
def _(t):
    df = t.lineitem.select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), "l_extendedprice")
    return st.scatter_points(df, ["quantity", "discount"], "l_extendedprice")


@query("scatter_bins", """WITH e AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 20 AS w FROM lineitem)
   SELECT 'l_quantity' AS feature, CAST(least(floor((l_quantity - lo) / w), 19) AS INT) AS bin, count(*) AS n,
   round(avg(l_extendedprice), 3) AS mean_y FROM lineitem CROSS JOIN e GROUP BY 1, 2""")
def _(t):
    return _round(st.scatter_bins(t.lineitem, "l_quantity", "l_extendedprice"), "mean_y", 3)


@query("minmax_scale", """WITH p AS (SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders
   WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)
   SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS scaled, round(o_totalprice, 2) AS back
   FROM orders JOIN p USING (o_orderpriority)""")
def _(t):
    params = st.minmax_fit(t.orders, "o_totalprice", "o_orderpriority", F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    scaled = st.scale(t.orders, "o_totalprice", params, "o_orderpriority", "scaled")
    back = st.unscale(scaled, "scaled", params, "o_orderpriority", "back")
    return _round(_round(back, "scaled"), "back", 2).select("o_orderkey", "scaled", "back")


@query("one_hot", """SELECT event_id, (event_type = 'click')::INT AS type_click, (event_type = 'error')::INT AS type_error,
   (event_type = 'view')::INT AS type_view FROM events""")
def _(t):
    return st.one_hot(t.events, "event_type", ["click", "error", "view"], "type").select(
        "event_id", "type_click", "type_error", "type_view")


@query("indicator_argmax", """SELECT vec_id, label AS code, CAST(label = 3 AS INT) AS is_3 FROM embeddings""")
def _(t):
    rows = st.indicator(t.embeddings, "label", st.classes_of(t.embeddings, "label"))
    return rows.select("vec_id", fa.argmax(F.col("indicator")).alias("code"), F.element_at("indicator", 4).alias("is_3"))


@query("balanced_weights", """WITH n AS (SELECT toxic, count(*) AS k FROM labels GROUP BY 1)
   SELECT doc_id, round((SELECT sum(k) FROM n) / ((SELECT count(*) FROM n) * k), 6) AS weight FROM labels JOIN n USING (toxic)""")
def _(t):
    return _round(st.balanced_weights(t.labels, "toxic"), "weight").select("doc_id", "weight")


# --- order, splits, folds -----------------------------------------------------------------

_POS = """row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1"""


@query("positional_split", f"""WITH p AS (SELECT *, {_POS} AS pos FROM lineitem) SELECT
   CASE WHEN pos < floor((SELECT count(*) FROM lineitem) * 0.7) THEN 'head' ELSE 'tail' END AS part, count(*) AS n,
   round(sum(l_quantity), 2) AS quantity, min(l_orderkey) AS first_key FROM p GROUP BY 1""")
def _(t):
    head, tail = od.positional_split(t.lineitem, ORDER, frac=0.7)
    both = head.withColumn("part", F.lit("head")).unionByName(tail.withColumn("part", F.lit("tail")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"),
                                    F.min("l_orderkey").alias("first_key"))


@query("contiguous_folds", f"""WITH p AS (SELECT *, {_POS} AS pos, count(*) OVER () AS n FROM lineitem), b AS (
   SELECT i AS fold, CAST(floor(n / 10.0 * i) AS BIGINT) AS lo, CAST(floor(n / 10.0 * (i + 1)) AS BIGINT) AS hi
   FROM (SELECT count(*) AS n FROM lineitem) CROSS JOIN range(10) r(i))
   SELECT CAST(fold AS INT) AS fold, count(*) AS n, round(sum(l_extendedprice), 0) AS price, min(pos) AS first_pos
   FROM p JOIN b ON pos >= lo AND pos < hi GROUP BY 1""")
def _(t):
    rows = od.with_position(od.contiguous_folds(t.lineitem, ORDER, 10), ORDER)
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 0).alias("price"),
                                    F.min("pos").alias("first_pos"))


@query("fold_complement", f"""WITH p AS (SELECT *, {_POS} AS pos, count(*) OVER () AS n FROM lineitem), f AS (
   SELECT *, CAST(floor(((pos + 1) * 10 - 1) / n) AS INT) AS fold FROM p)
   SELECT i.held, count(*) AS n, round(avg(l_quantity), 6) AS mean_quantity
   FROM f JOIN (SELECT CAST(unnest(range(10)) AS INT) AS held) i ON f.fold <> i.held GROUP BY 1""")
def _(t):
    rows = cut_lineage(od.contiguous_folds(t.lineitem, ORDER, 10).select("fold", "l_quantity"))
    parts = [od.complement(rows, "fold", held).agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean_quantity"))
             .select(F.lit(held).alias("held"), "n", "mean_quantity") for held in range(10)]
    table = reduce(DataFrame.unionByName, parts)
    return _round(table, "mean_quantity")


@query("hash_split", """SELECT doc_id, CAST(substr(md5(CAST(doc_id AS VARCHAR) || ':' || '1'), 1, 8) < '4ccccccc' AS INT)
   AS is_test FROM documents""")
def _(t):
    return od.hash_split(t.documents, "doc_id", 0.3, 1).select("doc_id", "is_test")


@query("extend_history", """WITH s AS (SELECT o_orderkey, o_orderpriority, o_orderdate,
   o_orderdate >= TIMESTAMP '2001-01-01' AS is_test FROM orders), r AS (SELECT *, row_number() OVER (
   PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS back,
   count(*) FILTER (is_test) OVER (PARTITION BY o_orderpriority) AS t FROM s)
   SELECT o_orderkey, CAST(is_test AS INT) AS is_test FROM r WHERE back <= t + 120""")
def _(t):
    cols = t.orders.select("o_orderkey", "o_orderpriority", "o_orderdate")
    late = F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
    out = od.extend_history(cols.filter(~late), cols.filter(late), 120, ["o_orderdate", "o_orderkey"], "o_orderpriority")
    return out.select("o_orderkey", "is_test")


@query("sorted_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5")
def _(t):
    return rl.preview(t.orders, ["o_orderdate", "o_orderkey"], 5).select("o_orderkey", "o_totalprice")


@query("best_worst", """(SELECT s_name, s_acctbal, 'best' AS side FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 3)
   UNION ALL (SELECT s_name, s_acctbal, 'worst' AS side FROM supplier ORDER BY s_acctbal, s_name LIMIT 3)""")
def _(t):
    return rl.best_worst(t.supplier.select("s_name", "s_acctbal"), "s_acctbal", 3, "s_name")


# --- scores -------------------------------------------------------------------------------


@query("mse_rmse", f"WITH {SCORED} SELECT round(avg((actual - predicted) ** 2), 4) AS mse, "
       "round(sqrt(avg((actual - predicted) ** 2)), 5) AS rmse FROM scored")
def _(t):
    both = ev.mse(scored(t), "actual", "predicted")
    return both.select(F.round("mse", 4).alias("mse"), F.round(F.sqrt("mse"), 5).alias("rmse"))


@query("r2", f"""WITH {SCORED} SELECT round(1 - sum((actual - predicted) ** 2) / (count(*) * var_pop(actual)), 6) AS r2 FROM scored""")
def _(t):
    return _round(ev.r2(scored(t), "actual", "predicted"), "r2")


@query("accuracy", f"WITH {SCORED} SELECT round(avg(CAST(y1 = p1 AS INT)), 6) AS accuracy FROM scored")
def _(t):
    return _round(ev.accuracy(scored(t), "y1", "p1"), "accuracy")


@query("confusion", f"""WITH {SCORED}, g AS (SELECT CAST(a.c AS INT) AS y, CAST(b.c AS INT) AS p FROM range(5) a(c), range(5) b(c))
   SELECT g.y, g.p, count(s.y1) AS n FROM g LEFT JOIN scored s ON s.y1 = g.y AND s.p1 = g.p GROUP BY 1, 2""")
def _(t):
    return ev.confusion(scored(t), "y1", "p1", [0, 1, 2, 3, 4])


@query("hamming_loss", f"""WITH {SCORED}, w AS (SELECT avg((y1 <> p1)::INT) AS a, avg((y2 <> p2)::INT) AS b, avg((y <> p)::INT) AS c
   FROM scored) SELECT 'y1' AS label, round(a, 6) AS loss FROM w UNION ALL SELECT 'y2', round(b, 6) FROM w
   UNION ALL SELECT 'y', round(c, 6) FROM w UNION ALL SELECT 'all', round((a + b + c) / 3, 6) FROM w""")
def _(t):
    return _round(ev.hamming_loss(scored(t), ["y1", "y2", "y"], ["p1", "p2", "p"]), "loss")


_CLASSES = f"""{SCORED}, cls AS (SELECT c, count(*) FILTER (y1 = c AND p1 = c) AS tp, count(*) FILTER (y1 = c) AS sup,
   count(*) FILTER (p1 = c) AS said FROM scored, range(4) r(c) GROUP BY 1), pr AS (SELECT CAST(c AS VARCHAR) AS class,
   CASE WHEN said = 0 THEN 0 ELSE tp / said END AS precision, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS recall,
   CASE WHEN sup + said = 0 THEN 0 ELSE 2.0 * tp / (sup + said) END AS f1, sup AS support FROM cls)"""


@query("macro_scores", f"""WITH {_CLASSES} SELECT round(avg(precision), 6) AS macro_precision,
   round(avg(recall), 6) AS macro_recall FROM pr""")
def _(t):
    return _round(ev.macro_scores(scored(t), "y1", "p1"), ["macro_precision", "macro_recall"])


@query("class_report", f"""WITH {_CLASSES}, r AS (SELECT * FROM pr UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1),
   sum(support) FROM pr UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
   sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM pr)
   SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
   CAST(support AS BIGINT) AS support FROM r""")
def _(t):
    return _round(ev.class_report(scored(t), "y1", "p1"), ["precision", "recall", "f1"])


@query("binary_scores", f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (p = 1) AS said,
   count(*) FILTER (y = 1) AS sup FROM scored) SELECT round(tp / said, 6) AS precision, round(tp / sup, 6) AS recall,
   round(2.0 * tp / (said + sup), 6) AS f1 FROM c""")
def _(t):
    return _round(ev.binary_scores(scored(t), "y", "p"), ["precision", "recall", "f1"])


_AUC = """s AS (SELECT score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM scored GROUP BY 1),
   b AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg / 2.0 AS below FROM s)"""


@query("auc", f"""WITH {SCORED}, {_AUC} SELECT round(CAST(sum(pos * below) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS auc FROM b""")
def _(t):
    return _round(ev.auc(scored(t), "y", "score"), "auc")


@query("auc_hard", f"""WITH {SCORED} SELECT round((avg(p) FILTER (y = 1) + avg(1 - p) FILTER (y = 0)) / 2, 6) AS auc FROM scored""")
def _(t):
    return _round(ev.auc_hard(scored(t), "y", "p"), "auc")


@query("auc_ovr", f"""WITH {SCORED}, k AS (SELECT c, (avg((p1 = c)::INT) FILTER (y1 = c) + avg((p1 <> c)::INT) FILTER (y1 <> c)) / 2
   AS a FROM scored, range(4) r(c) GROUP BY 1) SELECT round(avg(a), 6) AS auc FROM k""")
def _(t):
    return _round(ev.auc_ovr(scored(t), "y1", "p1"), "auc")


@query("hamming_distance", f"""WITH {SCORED} SELECT (y1 <> p1)::INT + (y2 <> p2)::INT + (y <> p)::INT AS distance, count(*) AS n
   FROM scored GROUP BY 1""")
def _(t):
    apart = fa.hamming_distance(F.array("y1", "y2", "y"), F.array("p1", "p2", "p"))
    return scored(t).groupBy(apart.alias("distance")).agg(F.count(F.lit(1)).alias("n"))


@query("best_param", """SELECT o_orderpriority AS param, round(avg(o_totalprice), 3) AS score FROM orders GROUP BY 1
   ORDER BY 2 DESC, 1 LIMIT 1""")
def _(t):
    scores = t.orders.groupBy(F.col("o_orderpriority").alias("param")).agg(F.round(F.avg("o_totalprice"), 3).alias("score"))
    return rl.best_param(scores)


@query("repeat_runs", """WITH h AS (SELECT r.i AS run, l_returnflag, l_quantity FROM lineitem, range(50) r(i)
   WHERE substr(md5(CAST(l_orderkey AS VARCHAR) || ':' || CAST(r.i AS VARCHAR)), 1, 8) < '80000000'), m AS (
   SELECT run, l_returnflag, avg(l_quantity) AS q FROM h GROUP BY 1, 2)
   SELECT l_returnflag, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS std FROM m GROUP BY 1""")
def _(t):
    half = rs.repeat_splits(t.lineitem, "l_orderkey", 0.5, range(50)).filter("is_test = 1")
    runs = half.groupBy("run", "l_returnflag").agg(F.avg("l_quantity").alias("q"))
    return _round(st.repeat_stats(runs, "l_returnflag", "q"), ["mean", "std"])
