"""Queries over posts and prices: text cleaning, words, tf-idf, daily sentiment, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as ft
from ..operators import joins as jn
from ..operators import relational as rl
from ..operators import series as se
from ..operators import stats as st
from ..operators import text as tx
from ..session import cut_lineage, new_path, spread
from ..sources import readers as rd
from .registry import Tables, query
from .tabular import _round, sentiment

STOP_WORDS = ["the", "and", "de", "la", "der", "die", "el", "le"]
NAMES = ["$$$", "%%%"]

_LIST = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_DAY = "CAST(strftime(DATE '1995-01-01' + CAST(doc_id % 300 AS INT), '%Y%m%d') AS INT)"

POSTS = f"posts AS (SELECT doc_id, text, {_DAY} AS day FROM documents)"
NO_STOP = POSTS + f""", nostop AS (SELECT doc_id, day, array_to_string(list_filter(string_split(trim(
   regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT list_contains({_LIST}, w)), ' ') AS t FROM posts)"""
CLEAN = NO_STOP + """, named AS (SELECT doc_id, day, CASE WHEN length(t) > 0 THEN replace(replace(t, '$$$', ''), '%%%', '') END AS t
   FROM nostop), one AS (SELECT doc_id, day, CASE WHEN length(t) > 0 AND NOT contains(t, '$') THEN t END AS t FROM named),
clean AS (SELECT doc_id, day, lower(coalesce(t, '')) AS t FROM one WHERE lower(coalesce(t, '')) <> '')"""
STRIPPED = r"""regexp_replace(t, '[,.!%()+''\d:-]', '', 'g')"""
WORDS = f""", words AS (SELECT doc_id, word, total FROM (SELECT doc_id, unnest(l) AS word, len(l) AS total FROM (
   SELECT doc_id, list_filter(string_split({STRIPPED}, ' '), lambda w: w <> '') AS l FROM clean))),
freq AS (SELECT word, count(*) AS n FROM words GROUP BY 1)"""
VOCAB = WORDS + """, vocab AS (SELECT word, f.n, d.n_docs, ln(((SELECT count(*) FROM clean) + 1) / d.n_docs + 1) + 1 AS idf
   FROM (SELECT * FROM freq WHERE n >= 25) f JOIN (SELECT word, count(DISTINCT doc_id) AS n_docs FROM words GROUP BY 1) d USING (word))"""
TF = VOCAB + """, tf AS (SELECT doc_id, word, count(*) AS n, any_value(total) AS total, (count(*) + 1) / (2.0 * any_value(total)) AS tf
   FROM words WHERE word IN (SELECT word FROM vocab) GROUP BY 1, 2)"""
# The dense grid of the definition: every vocabulary word in every text with words.
CHISQ = TF + """, sizes AS (SELECT doc_id, any_value(total) AS total FROM words GROUP BY 1),
grid AS (SELECT v.word, s.doc_id, v.idf * (coalesce(t.n, 0) + 1) / (2.0 * s.total) AS x
   FROM sizes s CROSS JOIN vocab v LEFT JOIN tf t ON t.doc_id = s.doc_id AND t.word = v.word),
chisq AS (SELECT word, count(*) * var_pop(x) / avg(x) AS chisq FROM grid GROUP BY 1)"""


def posts(t: Tables) -> DataFrame:
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    texts = spread(t.documents.select("doc_id", "text"), "doc_id")
    return rl.day_key(texts.withColumn("date", day), "date").drop("date")


def clean(t: Tables, passes: int = 1) -> DataFrame:
    """Cleaned posts; written once when a query reads them more than once."""
    rows = tx.clean_posts(posts(t), "text", STOP_WORDS, NAMES)
    return cut_lineage(rows.drop("text")) if passes > 1 else rows


def vocab(t: Tables, rows: DataFrame) -> DataFrame:
    return tx.vocabulary(rows, "clean", 25)


POST_FIELDS = """SELECT event_id AS id, strftime(ts, '%d %b %Y') AS created_at, CASE event_type WHEN 'click' THEN 'bullish'
   WHEN 'error' THEN 'bearish' END AS class, CASE WHEN event_type <> 'view' THEN props END AS description FROM events"""


def _raw_posts(t: Tables) -> DataFrame:
    links = F.when(F.col("event_type") != "view", F.array(F.struct(F.col("props").alias("description")))).otherwise(
        F.array().cast("array<struct<description: string>>"))
    raw = sentiment(t).join(t.events.select("event_id", links.alias("links")), "event_id")
    return raw.select(F.col("event_id").alias("id"), F.date_format("ts", "dd MMM yyyy").alias("created_at"), "sentiment", "links")


@query("scan_posts_json", POST_FIELDS)
def _(t):
    path = new_path(t.spark, "posts")
    rd.write_table(_raw_posts(t), path, "json")
    return _fields(rd.read_posts(t.spark, path, lines=True))


def _fields(back: DataFrame) -> DataFrame:
    return back.select("id", "created_at", F.col("sentiment.class").alias("class"),
                       ft.first_field(F.col("links"), "description").alias("description"))


@query("scan_posts_array", POST_FIELDS)
def _(t):
    """The same posts from files that hold one array of objects each."""
    path, out = new_path(t.spark, "post-arrays"), _raw_posts(t)
    arrays = out.groupBy(F.pmod("id", F.lit(16)).alias("part")).agg(F.to_json(F.collect_list(F.struct(*out.columns))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return _fields(rd.read_posts(t.spark, path))


@query("first_field", """SELECT event_id, CASE WHEN event_type <> 'view' THEN props END AS description FROM events""")
def _(t):
    links = F.when(F.col("event_type") != "view", F.array(F.struct(F.col("props").alias("description")))).otherwise(
        F.array().cast("array<struct<description: string>>"))
    return t.events.select("event_id", ft.first_field(links, "description").alias("description"))


@query("split_trim", """SELECT event_id, string_split(trim(event_type || ',' || user_id || ' '), ',')[2] AS field FROM events""")
def _(t):
    line = F.concat(F.col("event_type"), F.lit(","), F.col("user_id").cast("string"), F.lit(" "))
    return t.events.select("event_id", ft.split_trim(line, ",")[1].alias("field"))


@query("remove_stopwords", f"WITH {NO_STOP} SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM nostop")
def _(t):
    out = tx.remove_stopwords(posts(t), "text", STOP_WORDS, out="kept")
    return out.select("doc_id", F.length("kept").cast("bigint").alias("n_chars"), F.md5("kept").alias("digest"))


@query("remove_stopwords_join", f"WITH {NO_STOP} SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM nostop")
def _(t):
    words = t.spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")
    out = tx.remove_stopwords(posts(t), "text", words, key="doc_id", out="kept")
    return out.select("doc_id", F.length("kept").cast("bigint").alias("n_chars"), F.md5("kept").alias("digest"))


@query("clean_posts", f"WITH {CLEAN} SELECT doc_id, day, length(t) AS n_chars, md5(t) AS digest FROM clean")
def _(t):
    return clean(t).select("doc_id", "day", F.length("clean").cast("bigint").alias("n_chars"), F.md5("clean").alias("digest"))


@query("strip_tokens", f"""WITH {CLEAN} SELECT doc_id, md5({STRIPPED}) AS digest,
   len(list_filter(string_split({STRIPPED}, ' '), lambda w: w <> '')) AS n_tokens FROM clean""")
def _(t):
    bare = ft.strip_chars(F.col("clean"))
    return clean(t).select("doc_id", F.md5(bare).alias("digest"), F.size(ft.tokens(bare)).cast("bigint").alias("n_tokens"))


@query("word_freq", f"WITH {CLEAN} {WORDS} SELECT word, n FROM freq")
def _(t):
    return tx.word_freq(clean(t), "clean")


@query("doc_freq", f"WITH {CLEAN} {VOCAB} SELECT word, n_docs FROM vocab")
def _(t):
    rows = clean(t, passes=2)
    return tx.doc_freq(rows, tx.word_freq(rows, "clean", 25), "clean")


@query("doc_freq_substring", f"""WITH {CLEAN} {WORDS}, often AS (SELECT word FROM freq WHERE n >= 25)
   SELECT word, count(*) AS n_docs FROM often JOIN clean ON contains(t, word) GROUP BY 1""")
def _(t):
    rows = clean(t, passes=2)
    return tx.doc_freq(rows, tx.word_freq(rows, "clean", 25), "clean", "doc_id", "substring")


@query("idf", f"WITH {CLEAN} {VOCAB} SELECT word, n, n_docs, round(idf, 6) AS idf FROM vocab")
def _(t):
    return _round(vocab(t, clean(t, passes=2)), "idf")


@query("tf", f"WITH {CLEAN} {TF} SELECT doc_id, word, n, round(tf, 8) AS tf FROM tf")
def _(t):
    rows = clean(t, passes=2)
    return _round(tx.tf(rows, "doc_id", "clean", vocab(t, rows)), "tf", 8).drop("total")


@query("tf_idf", f"WITH {CLEAN} {TF} SELECT doc_id, word, round(tf * idf, 8) AS tf_idf FROM tf JOIN vocab USING (word)")
def _(t):
    rows = clean(t, passes=2)
    words = vocab(t, rows)
    return _round(tx.tf_idf(tx.tf(rows, "doc_id", "clean", words, carry=["idf"]), words), "tf_idf", 8).select("doc_id", "word", "tf_idf")


def _scores(t: Tables, rows: DataFrame, words: DataFrame) -> DataFrame:
    return tx.chisq_words(rows, "doc_id", "clean", words, tx.tf(rows, "doc_id", "clean", words))


@query("chisq_words", f"WITH {CLEAN} {CHISQ} SELECT word, round(chisq, 5) AS chisq FROM chisq")
def _(t):
    rows = clean(t, passes=2)
    words = vocab(t, rows)
    return _round(_scores(t, rows, words), "chisq", 5)


@query("select_top", f"""WITH {CLEAN} {CHISQ}, best AS (SELECT word, row_number() OVER (ORDER BY chisq DESC, word) AS r FROM chisq
   ORDER BY chisq DESC, word LIMIT 100)
   SELECT doc_id, CAST(100 - r AS INT) AS at, round(x, 7) AS x FROM grid JOIN best USING (word)""")
def _(t):
    rows = clean(t, passes=2)
    words = vocab(t, rows)
    top = tx.select_top(rows, "doc_id", "clean", words, _scores(t, rows, words), 100)
    return top.select("doc_id", F.posexplode("vec").alias("at", "x")).withColumn("x", F.round("x", 7))


@query("posts_by_day", f"""WITH {CLEAN}, p AS (SELECT day, t, doc_id, (row_number() OVER (PARTITION BY day ORDER BY doc_id) - 1) // 1000
   AS part FROM clean) SELECT day, CAST(part AS INT) AS part, count(*) AS n, md5(string_agg(t, '.' ORDER BY doc_id)) AS digest
   FROM p GROUP BY 1, 2""")
def _(t):
    return tx.posts_by_day(clean(t), "day", "clean", "doc_id").select("day", "part", "n", F.md5("text").alias("digest"))


# --- daily sentiment and volume -----------------------------------------------------------

_TAGGED = """tagged AS (SELECT CAST(strftime(ts, '%Y%m%d') AS INT) AS day, CASE event_type WHEN 'click' THEN 1.0 ELSE -1.0 END AS s
   FROM events WHERE event_type IN ('click', 'error')), daily AS (SELECT day, avg(s) AS score FROM tagged GROUP BY 1)"""
_VOLUME = "volume AS (SELECT CAST(strftime(ts, '%Y%m%d') AS INT) AS day, count(*) AS n FROM events GROUP BY 1)"


def daily_score(t: Tables) -> DataFrame:
    coded = rl.day_key(rl.sentiment_code(sentiment(t), "sentiment"), "ts").filter("code <> 0")
    return st.sentiment_score(coded, "day", F.col("code") == 1)


def daily_volume(t: Tables) -> DataFrame:
    return rl.count_by(rl.day_key(t.events, "ts"), "day").withColumnRenamed("count", "n")


@query("sentiment_score", f"WITH {_TAGGED} SELECT day, round(score, 6) AS score FROM daily")
def _(t):
    return _round(daily_score(t), "score")


@query("moving_avg", f"""WITH {_TAGGED} SELECT day, CASE WHEN count(*) OVER w = 3 THEN round(avg(score) OVER w, 6) END AS ma
   FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(t):
    return _round(se.moving_avg(daily_score(t), "score", 3, "day"), "ma").select("day", "ma")


@query("moving_avg_posts", """SELECT event_id, CASE WHEN count(*) OVER w = 3 THEN round(avg(value) OVER w, 4) END AS ma
   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def _(t):
    return _round(se.moving_avg(t.events, "value", 3, ["ts", "event_id"], "user_id"), "ma", 4).select("event_id", "ma")


@query("rel_change", f"WITH {_VOLUME} SELECT day, round((n - lag(n) OVER (ORDER BY day)) / lag(n) OVER (ORDER BY day), 6) AS change FROM volume")
def _(t):
    return _round(se.rel_change(daily_volume(t), "n", "day"), "change").select("day", "change")


@query("vs_moving_avg", f"""WITH {_VOLUME} SELECT day, CASE WHEN count(*) OVER w = 10 THEN round(n / avg(n) OVER w, 6) END AS ratio
   FROM volume WINDOW w AS (ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def _(t):
    return _round(se.vs_moving_avg(daily_volume(t), "n", 10, "day"), "ratio").select("day", "ratio")


# --- prices and labels --------------------------------------------------------------------

PRICES = """prices AS (SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS day, avg(o_totalprice) AS close FROM orders GROUP BY 1)"""
RETURNS = PRICES + """, returns AS (SELECT day, (lead(close, 3) OVER (ORDER BY day) - close) / close AS rt_3,
   (lead(close, 5) OVER (ORDER BY day) - close) / close AS rt_5 FROM prices)"""
LABELS = RETURNS + """, labelled AS (SELECT day, CASE WHEN rt_3 IS NOT NULL AND rt_5 IS NOT NULL AND rt_3 > 0 THEN 1 ELSE 0 END AS up_3,
   CASE WHEN rt_3 IS NOT NULL AND rt_5 IS NOT NULL AND rt_5 > 0 THEN 1 ELSE 0 END AS up_5, rt_5 FROM returns)"""


def prices(t: Tables) -> DataFrame:
    return rl.day_key(t.orders, "o_orderdate").groupBy("day").agg(F.avg("o_totalprice").alias("close"))


def labelled(t: Tables) -> DataFrame:
    return rl.sign_labels(se.forward_return(prices(t), "close", [3, 5], "day"), "rt_3", "rt_5", ("up_3", "up_5"))


@query("forward_return", f"WITH {RETURNS} SELECT day, round(rt_3, 6) AS rt_3, round(rt_5, 6) AS rt_5 FROM returns")
def _(t):
    return _round(se.forward_return(prices(t), "close", [3, 5], "day"), ["rt_3", "rt_5"]).drop("close")


@query("sign_labels", f"WITH {LABELS} SELECT day, up_3, up_5 FROM labelled")
def _(t):
    return labelled(t).select("day", "up_3", "up_5")


@query("on_trading_days", f"WITH {POSTS}, {PRICES} SELECT doc_id, day FROM posts WHERE day IN (SELECT day FROM prices)")
def _(t):
    return jn.on_trading_days(posts(t), prices(t)).select("doc_id", "day")


@query("attach_labels", f"""WITH {CLEAN}, {LABELS} SELECT doc_id, day, up_3, up_5 FROM clean JOIN labelled USING (day) WHERE rt_5 IS NOT NULL""")
def _(t):
    table = labelled(t).filter(F.col("rt_5").isNotNull()).select("day", "close", "up_3", "up_5")
    return jn.attach_labels(clean(t), table, "close").select("doc_id", "day", "up_3", "up_5")
