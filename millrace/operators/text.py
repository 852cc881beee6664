"""Word counts, document frequencies, tf-idf and word selection over large text tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions.arrays import let
from ..session import BROADCAST_ROWS, TASK_ROWS, Shared, as_list, cut_lineage, fits
from .joins import lookup_join
from .order import with_position

# Bytes of a vocabulary that tasks may hold as an automaton, and distinct pieces whose matches a task remembers.
AUTOMATON_BYTES, PIECES_KNOWN = 8_000_000, 200_000
# Words of a vocabulary that are broadcast to a join: about 100 bytes each.
VOCABULARY_ROWS = 1_000_000


def remove_stopwords(df: DataFrame, col: str, words, key=None, out: str | None = None,
                     max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Drop listed words, keeping order and repeats. `words` is a list, or a frame with `word`.

    A list of any length becomes a projection that looks words up in a hash set. A frame needs `key`, the unique key of
    a text: one of at most `max_rows` words is sent to the tasks, which look the words of their texts up, and no word is
    shuffled. A longer one, or a key that several texts share, becomes an anti join on the exploded words.
    """
    out = out or col
    if not isinstance(words, DataFrame):
        return df.withColumn(out, ft.without_words(F.col(col), words))
    if key is None:
        raise ValueError("a frame of stop words needs the key of the text")
    keys, listed = as_list(key), words.select("word").distinct()
    if not fits(listed, max_rows):
        return _without_joined(df, col, listed, keys, out, max_rows)
    several = cut_lineage(df.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n"))
    if fits(several, 0):
        return _without_sent(df, col, listed, keys, out)
    if not fits(several, max_rows):
        return _without_joined(df, col, listed, keys, out, max_rows)
    alone, shared = (df.join(F.broadcast(several), keys, how) for how in ("left_anti", "left_semi"))
    joined = _without_joined(shared, col, listed, keys, out, max_rows)
    return _without_sent(alone, col, listed, keys, out).unionByName(joined)


def _without_sent(df: DataFrame, col: str, words: DataFrame, keys: list, out: str) -> DataFrame:
    """Texts of distinct keys without the words of a short list, which every task holds. A null key has no words."""
    sent = Shared(df.sparkSession, [r["word"] for r in words.collect() if r["word"] is not None])

    @F.arrow_udf("string")
    def kept(pieces: pa.Array) -> pa.Array:
        flat = pieces.flatten()
        stay = pc.invert(pc.or_(pc.is_in(flat, value_set=pa.array(sent.value, flat.type)), pc.equal(flat, "")))
        before = np.concatenate([[0], np.cumsum(stay.to_numpy(zero_copy_only=False))])
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(pieces), 0).to_numpy())])
        lists = pa.ListArray.from_arrays(pa.array(before[ends].astype(np.int32)), flat.filter(stay))
        return pc.binary_join(lists, " ")

    text = F.col(col)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.withColumn(out, F.when(text.isNull(), F.lit(None)).when(known, kept(_pieces(text))).otherwise(F.lit("")))


def _pieces(text):
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def _without_joined(df: DataFrame, col: str, words: DataFrame, keys: list, out: str, max_rows: int) -> DataFrame:
    """Texts without the words of a long list, by an anti join on their exploded words."""
    exploded = df.select(*keys, F.posexplode(_pieces(F.col(col))).alias("at", "word"))
    kept = lookup_join(exploded, words, "word", "left_anti", max_rows).filter(F.col("word") != "")
    texts = kept.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ")
        .alias("__kept"))
    empty = F.when(F.col(col).isNotNull(), F.coalesce("__kept", F.lit("")))
    return df.join(texts, keys, "left").withColumn(out, empty).drop("__kept")


def clean_posts(df: DataFrame, col: str, stop_words, names, other_mark: str = "$", out: str = "clean") -> DataFrame:
    """Stop words out, own names out, texts naming others dropped, lower case, no empty texts."""
    text = ft.without_words(F.col(col), stop_words)
    text = ft.null_if_contains(ft.remove_names(text, names), other_mark)
    # explode of the filtered value: a filter on the column would be pushed down and computed twice
    return df.withColumn(out, F.explode(F.filter(F.array(ft.normalized(text)), lambda c: c != "")))


def words_of(df: DataFrame, key, col: str) -> DataFrame:
    """(key.., word, total): every word of every text, with the text's word count."""
    split = df.select(*as_list(key), ft.tokens(ft.strip_chars(F.col(col))).alias("__w"))
    return split.select(*as_list(key), F.size("__w").alias("total"), F.explode("__w").alias("word"))


def word_freq(df: DataFrame, col: str, min_count: int = 1) -> DataFrame:
    """(word, n): occurrences over the whole table; counts combine before the shuffle."""
    words = df.select(F.explode(ft.tokens(ft.strip_chars(F.col(col)))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_count) if min_count > 1 else counts


def doc_freq(df: DataFrame, vocab: DataFrame, col: str, key=None, mode: str = "token",
             max_rows: int | None = None) -> DataFrame:
    """(word, n_docs) for the words of `vocab`.

    mode='token' counts texts that hold the word as a token; both sides have one row a word, so no word is hot.
    mode='substring' counts texts that
    hold it anywhere: a word has no space, so it lies inside one space-separated piece of the
    text. A vocabulary of at most AUTOMATON_BYTES (and of `max_rows` words, where given) is sent to the tasks as an
    automaton; they sum texts per word, so that a row per task and word is shuffled. For a larger
    one the distinct pieces are cut into substrings of the lengths the vocabulary has and
    matched with it by an equi join; the matches then join back to the texts. `key` is unique.
    """
    words = vocab.select("word").distinct()
    if mode == "token":
        seen = df.select(F.explode(F.array_distinct(ft.tokens(ft.strip_chars(F.col(col))))).alias("word"))
        return seen.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs")).join(words, "word")
    if mode != "substring":
        raise ValueError("mode is 'token' or 'substring'")
    if key is None:
        raise ValueError("substring mode needs the key of a text")
    words = cut_lineage(words)
    size = words.agg(F.count(F.lit(1)), F.sum(F.octet_length("word"))).first()
    if (max_rows is None or size[0] <= max_rows) and (size[1] or 0) <= AUTOMATON_BYTES:
        return _automaton_counts(df, col, words)
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    keys = as_list(key)
    # Only lengths that the vocabulary has are cut: a piece of n letters gives at most n substrings per length.
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect() if r[0])
    pieces = df.select(*keys, F.explode(F.array_distinct(ft.tokens(F.col(col)))).alias("piece"))
    size = F.length("piece")
    starts = pieces.select("piece").distinct().select("piece", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= size - F.col("i") + 1)
    cuts = starts.select("piece", "i", F.explode(fitting).alias("len"))
    inside = cuts.select("piece", F.substr("piece", "i", "len").alias("word"))
    match = lookup_join(inside, words, "word", "left_semi", max_rows=max_rows)
    # at most len(piece) words a piece and length; stored, because the size check below reads it once more
    held = cut_lineage(match.groupBy("piece").agg(F.collect_set("word").alias("__held")))
    found = lookup_join(pieces, held, "piece", max_rows=max_rows)
    per_text = found.select(*keys, F.explode("__held").alias("word")).distinct()
    return per_text.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


def _automaton_counts(df: DataFrame, col: str, words: DataFrame) -> DataFrame:
    """Substring document frequencies by one Aho-Corasick automaton, run once per distinct piece that a task remembers.

    Linear in the length of a piece and its matches.
    """
    listed = sorted(r["word"] for r in words.collect() if r["word"])
    sent = Shared(df.sparkSession, listed)

    def count(batches):
        import ahocorasick

        own = sent.value
        find = ahocorasick.Automaton()
        for k, word in enumerate(own):
            find.add_word(word, k)
        find.make_automaton()
        n, known = np.zeros(len(own), np.int64), {}
        for batch in batches:
            for pieces in batch.column(0) if own else ():
                found = [np.zeros(0, np.int64)]
                for piece in pieces.as_py() or ():
                    if piece not in known:
                        if len(known) >= PIECES_KNOWN:
                            known.clear()
                        known[piece] = np.array(sorted({k for _, k in find.iter(piece)}), np.int64)
                    found.append(known[piece])
                n[np.unique(np.concatenate(found))] += 1
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in there], pa.string()), pa.array(n[there])],
                                         names=["word", "n_docs"])

    pieces = df.select(F.array_compact(F.array_distinct(ft.tokens(F.col(col)))).alias("pieces"))
    return pieces.mapInArrow(count, "word string, n_docs long").groupBy("word").agg(F.sum("n_docs").alias("n_docs"))


def idf(doc_counts: DataFrame, n_docs: int) -> DataFrame:
    """(.., idf) from (word, n_docs)."""
    return doc_counts.withColumn("idf", ft.idf(F.col("n_docs"), float(n_docs)))


def vocabulary(df: DataFrame, col: str, min_count: int, key=None, mode: str = "token",
               max_rows: int | None = None) -> DataFrame:
    """(word, n, n_docs, idf) of the words that occur at least `min_count` times.

    Words with more documents than occurrences (possible in substring mode) are left out. The
    result feeds several joins, so it is checkpointed.
    """
    freq = cut_lineage(word_freq(df, col, min_count))
    counts = doc_freq(df, freq, col, key, mode, max_rows)
    joined = freq.join(counts, "word").filter((F.col("n_docs") > 0) & (F.col("n_docs") <= F.col("n")))
    return cut_lineage(idf(joined, df.count()))


def tf(df: DataFrame, key, col: str, vocab: DataFrame, max_rows: int = VOCABULARY_ROWS, carry=()) -> DataFrame:
    """(key.., word, n, total, tf, carry..) for the vocabulary words present in a text.

    tf = (n + 1) / (2 total). A word that is absent has tf = 1 / (2 total) for every text, so
    it is a per-text constant and not stored. `carry` names columns of the vocabulary to bring along. A vocabulary above
    `max_rows` is met by a shuffle of the counts; these are stored, so that its look for hot words does not make them again.
    """
    keys, words = as_list(key), vocab.select("word", *carry)
    counts = words_of(df, keys, col).groupBy(*keys, "word").agg(
        F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
    if not fits(words, max_rows):
        counts = cut_lineage(counts)
    words = words if carry else words.distinct()
    kept = lookup_join(counts, words, "word", "inner" if carry else "left_semi", max_rows=max_rows)
    return kept.select(*keys, "word", "n", "total", ((F.col("n") + 1) / (2.0 * F.col("total"))).alias("tf"), *carry)


def tf_idf(tf_rows: DataFrame, vocab: DataFrame, max_rows: int = VOCABULARY_ROWS) -> DataFrame:
    """Adds idf and tf_idf = tf * idf to sparse tf rows; rows that carry their idf already are not joined again."""
    joined = tf_rows if "idf" in tf_rows.columns else lookup_join(tf_rows, vocab.select("word", "idf"), "word", max_rows=max_rows)
    return joined.withColumn("tf_idf", F.col("tf") * F.col("idf"))


def chisq_words(df: DataFrame, key, col: str, vocab: DataFrame, tf_rows: DataFrame) -> DataFrame:
    """(word, chisq) of every word's tf-idf column against its own mean.

    The dense text x vocabulary grid is never built. With c occurrences in a text of T words
    the value is idf (c + 1) / (2 T), so a column's sum and sum of squares are the per-text
    constants (sum of 1/T and 1/T^2, one aggregate) plus terms of the texts that hold the word.
    """
    sizes = df.select(F.size(ft.tokens(ft.strip_chars(F.col(col)))).cast("double").alias("t")).filter(F.col("t") > 0)
    base = sizes.agg(F.count("t").alias("n"), F.sum(1 / F.col("t")).alias("s1"),
                     F.sum(1 / (F.col("t") * F.col("t"))).alias("s2")).first()
    c, t = F.col("n").cast("double"), F.col("total").cast("double")
    held = tf_rows.groupBy("word").agg(F.sum(c / t).alias("e1"), F.sum((2 * c + c * c) / (t * t)).alias("e2"))
    joined = vocab.select("word", "idf").join(held, "word", "left")
    half = F.col("idf") / 2
    total = half * (F.lit(base["s1"]) + F.coalesce("e1", F.lit(0.0)))
    squares = half * half * (F.lit(base["s2"]) + F.coalesce("e2", F.lit(0.0)))
    mean = total / base["n"]
    return joined.select("word", F.try_divide(squares - total * mean, mean).alias("chisq"))


def select_top(df: DataFrame, key, col: str, vocab: DataFrame, scores: DataFrame, k: int = 100,
               score: str = "chisq") -> DataFrame:
    """(key.., vec): the tf-idf values of the k best words per text, best word last.

    Only occurrences of the k chosen words are counted and shuffled, at most k rows per text.
    """
    keys = as_list(key)
    best = scores.join(vocab.select("word", "idf"), "word").orderBy(F.desc(score), "word").limit(k).collect()[::-1]
    rank = F.try_element_at(F.create_map(*[F.lit(x) for i, b in enumerate(best) for x in (b["word"], i)]), F.col("word"))
    chosen = [b["word"] for b in best]
    split = df.select(*keys, ft.tokens(ft.strip_chars(F.col(col))).alias("__w"))
    hits = split.select(*keys, F.size("__w").alias("__t"),
                        F.explode_outer(F.filter("__w", lambda w: w.isin(chosen))).alias("word"))
    counts = hits.groupBy(*keys, "__t", "word").agg(F.count("word").alias("__n")).filter(F.col("__t") > 0)
    entry = F.when(F.col("word").isNotNull(), F.struct(rank.alias("at"), F.col("__n")))
    per_text = counts.groupBy(*keys, "__t").agg(F.map_from_entries(F.collect_list(entry)).alias("__m"))
    idf = F.array(*[F.lit(b["idf"]) for b in best])
    value = let(F.struct("__m", "__t"), lambda r: F.transform(idf, lambda w, i: (
        (F.coalesce(F.try_element_at(r["__m"], i), F.lit(0)) + 1) / (2.0 * r["__t"]) * w)))
    return per_text.select(*keys, value.alias("vec"))


def selected_words(scores: DataFrame, k: int = 100, score: str = "chisq") -> DataFrame:
    """(word, score) of the k best words; ties by word."""
    return scores.orderBy(F.desc(score), "word").limit(k)


def posts_by_day(df: DataFrame, day: str, col: str, order_by, sep: str = ".", part_rows: int = 1_000,
                 max_rows: int = TASK_ROWS) -> DataFrame:
    """(day, part, n, text): a day's texts joined in order, `part_rows` texts to a row.

    A day may hold any number of posts; parts keep every row bounded, and the parts of a day
    read in order are its whole text.
    """
    placed = with_position(df, order_by, day, "__at", max_rows)
    part = F.floor(F.col("__at") / part_rows).cast("int")
    texts = F.array_sort(F.collect_list(F.struct("__at", F.col(col).alias("t"))))
    grouped = placed.withColumn("part", part).groupBy(day, "part").agg(
        F.count(F.lit(1)).alias("n"), texts.alias("__t"))
    return grouped.select(day, "part", "n", F.array_join(F.transform("__t", lambda s: s["t"]), sep).alias("text"))
