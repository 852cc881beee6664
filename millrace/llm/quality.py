"""Quality rules: base counts of a text and its divergence from its language's reference."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import GAP, let, text_or_empty, words_of

# Characters counted by class: what a class keeps of a text. Lower-case letters and all else are the remainder.
CLASSES = {
    "space": r"[^\x20\x09-\x0D]+",
    "upper": r"[^A-Z]+",
    "digit": r"[^0-9]+",
    "mark": r"[^.,;:!?'\"()\-]+",
    "symbol": r"[^#*$%&|<>]+",
    "wide": r"[\x00-\x7F]+",
}
# All but the upper-case letters, digits, marks and symbols. Spelt letter by letter: the regex engine looks single
# characters up in a bit set, and ranges one after another.
PLAIN = "[^" + string.ascii_uppercase + string.digits + r".,;:!?'\"()\-#*$%&|<>]+"
RARE = ("upper", "digit", "mark", "symbol")
RUN = 8  # words in a repeated window
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
# Languages whose references may be broadcast: each is one row of two short histograms.
BROADCAST_LANGUAGES = 10_000
SLOTS = 256  # of the table that finds a word among the common ones


def rare_chars(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, "")


def char_classes(text: Column, rare: Column) -> list[Column]:
    """Code points per class, in the order of CLASSES.

    `rare` is a column with the `rare_chars` of `text`: a small part of it, in which the rare classes are counted.
    """
    return [F.length(F.regexp_replace(rare if name in RARE else text, pattern, "")) for name, pattern in CLASSES.items()]


def repeated_words(words: Column) -> Column:
    """Words lying in an 8-word window that the text holds at least twice, every occurrence included.

    Windows are compared by a 64-bit hash of their words. Sorting (hash, place) puts equal windows side by side, so
    the work is n log n however often a window repeats.
    """
    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, k: F.least(F.lit(RUN), F.coalesce(F.get(places, k + 1) - p, F.lit(RUN))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda total, r: total + r)

    def places(ranked: Column) -> Column:
        twice = F.filter(ranked, lambda x, k: (F.get(ranked, k - 1)["h"] == x["h"])
                         | F.coalesce(F.get(ranked, k + 1)["h"] == x["h"], F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def count(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            let(let(ranked, places), covered))

    def windows(hashes: Column) -> Column:
        # get() is constant time; slice() would copy the whole array for every window.
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - RUN),
                           lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(RUN))))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > RUN, let(let(hashes, windows), count)).otherwise(F.lit(0).cast("long"))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two histograms that sum to 1, in bits (0 to 1)."""
    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    both = F.zip_with(p, q, lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2)
    return F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda total, x: total + x))


def class_histogram(classes: Sequence[Column], chars: Column) -> Column:
    rest = chars
    for c in classes:
        rest = rest - c
    return F.array(*(x / chars for x in [*classes, rest]))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 24,
               min_chars: int = 200) -> DataFrame:
    """Per language (null is one of its own): mean class histogram, its `top` words and their shares.

    Columns `lang`, `classes` (null without a text of `min_chars`), `common`, `shares` (one more than `common`: the rest).
    Class histograms are averaged over documents, so one long document does not set the reference.
    """
    named = docs.select(F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))
    counted = named.filter(F.length("text") >= min_chars).withColumn("rare", rare_chars(F.col("text"))).select(
        "lang", F.length("text").alias("chars"),
        *(c.alias(n) for n, c in zip(CLASSES, char_classes(F.col("text"), F.col("rare")), strict=True)))
    classes = (counted.select("lang", class_histogram([F.col(n) for n in CLASSES], F.col("chars")).alias("h"))
               .groupBy("lang").agg(F.array(*(F.avg(F.col("h")[i]) for i in range(len(CLASSES) + 1))).alias("classes")))
    counts = (named.select("lang", F.explode(F.split(F.lower("text"), GAP)).alias("word"))
              .filter("word != ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    listed = (counts.withColumn("place", place).filter(F.col("place") <= top).groupBy("lang")
              .agg(F.array_sort(F.collect_list(F.struct("place", "word", "n"))).alias("words")))
    words = listed.alias("a").join(totals.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang"))).select(
        F.col("a.lang").alias("lang"), F.col("words.word").alias("common"), (F.transform("words", lambda w: w["n"]
                                                                                      / F.col("total"))).alias("head"))
    words = words.withColumn("shares", F.concat("head", F.array(
        F.greatest(F.lit(0.0), 1 - F.aggregate("head", F.lit(0.0), lambda total, x: total + x))))).drop("head")
    return words.alias("w").join(classes.alias("c"), F.col("w.lang").eqNullSafe(F.col("c.lang")), "left").select(
        "w.lang", "classes", "common", "shares")


def slot(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(SLOTS - 1).cast("int")


def common_slots(common: Column) -> Column:
    """Per slot the place (from 1) of the last common word whose hash falls there, 0 without one."""
    def place(slots: Column, k: Column) -> Column:
        return F.array_position(slots, k).cast("int")

    slots = F.reverse(F.transform(common, slot))
    size = F.size(common)
    return let(slots, lambda s: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.when(
        place(s, k) > 0, size + 1 - place(s, k)).otherwise(0)))


def common_places(words: Column, common: Column, slots: Column) -> Column:
    """The words that are common, each as the letter of its place among the common words: one string to count in.

    Only a word that shares its slot with another common word is sought in the whole list.
    """
    def letter(word: Column, k: Column) -> Column:
        sought = F.array_position(common, word)
        return F.when(k > 0, F.chr(F.lit(64) + F.when(F.get(common, k - 1) == word, k.cast("long"))
                                   .otherwise(F.when(sought > 0, sought))))

    return let(F.transform(words, lambda w: F.lower(w)), lambda low: F.array_join(
        F.zip_with(low, F.transform(low, lambda w: F.get(slots, slot(w))), letter), ""))


def judge(docs: DataFrame, refs: DataFrame, keep: Sequence[str] | None = None, text_col: str = "text",
          lang_col: str = "lang", min_chars: int = 400, min_words: int = 100, max_class_divergence: float = 0.10,
          max_word_divergence: float = 0.25) -> DataFrame:
    """Base counts, both divergences from the reference of the document's language, and the verdict.

    Returns `row` (struct of the `keep` columns), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs),
    class_divergence, word_divergence (null where not judged), base_failed, kept. A text under `min_chars` code points
    or `min_words` words is too short for the respective histogram and passes it; so does one whose language has no
    reference. Null text counts as empty, which fails the base rule. Repeated rows are judged alike. An empty table
    gives an empty result. Very long texts cost n log n in their words.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)))
    rows = docs.select(row.alias("row"), F.col(lang_col).alias("__lang"), text_or_empty(text_col).alias("text"))
    small = refs.count() <= BROADCAST_LANGUAGES
    refs = refs.withColumnRenamed("lang", "__ref").withColumn("slots", common_slots(F.col("common")))
    known = rows.join(F.broadcast(refs) if small else refs, F.col("__lang").eqNullSafe(F.col("__ref")), "left")

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).alias("n_repeat_words"),
                        common_places(words, F.col("common"), F.col("slots")).alias("places"))

    text = F.col("text")
    counted = known.withColumn("rare", rare_chars(text)).select(
        "row", "classes", "common", "shares", F.length("text").alias("chars"), let(words_of(text), of_words).alias("w"),
        duplicate_lines(text).alias("n_dup_lines"),
        *(c.alias(n) for n, c in zip(CLASSES, char_classes(text, F.col("rare")), strict=True)))
    hits = F.transform(F.sequence(F.lit(1), F.size("common")), lambda k: F.length("places") - F.length(
        F.replace(F.col("places"), F.chr(F.lit(64) + k.cast("long")), F.lit(""))))
    shared = counted.select(
        "row", "classes", "shares", "chars", "w.n_words", "w.n_repeat_words", "n_dup_lines", *CLASSES, F.col("w.places"),
        "common").withColumn("hits", F.when(F.col("n_words") >= min_words, hits))
    own = F.transform("hits", lambda h: h / F.col("n_words"))
    rest = 1 - F.aggregate(own, F.lit(0.0), lambda total, x: total + x)
    measured = shared.select(
        "row", "n_words", (F.col("chars") - F.col("space")).cast("long").alias("word_chars"),
        F.col("symbol").cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.when(F.col("chars") >= min_chars, divergence(class_histogram([F.col(n) for n in CLASSES], F.col("chars")),
                                                       F.col("classes"))).alias("class_divergence"),
        F.when(F.col("hits").isNotNull(), divergence(F.concat(own, F.array(F.greatest(F.lit(0.0), rest))),
                                                     F.col("shares"))).alias("word_divergence"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    far = (F.coalesce(F.col("class_divergence") > max_class_divergence, F.lit(False))
           | F.coalesce(F.col("word_divergence") > max_word_divergence, F.lit(False)))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far)


def quality(docs: DataFrame, keep: Sequence[str] | None = None, text_col: str = "text", lang_col: str = "lang",
            **limits) -> DataFrame:
    """`judge` against references learnt from the same documents."""
    return judge(docs, cut_lineage(references(docs, text_col, lang_col)), keep, text_col, lang_col, **limits)


# The same in SQL, for DuckDB, with the default limits.
_CLASSES_SQL = ", ".join(
    f"""len(regexp_replace(t, '{p.replace("'", "''")}', '', 'g')) AS c_{n}""" for n, p in CLASSES.items())
_HISTOGRAM_SQL = "[" + ", ".join(f"c_{n} / chars::DOUBLE" for n in CLASSES) + ", (chars - " + " - ".join(
    f"c_{n}" for n in CLASSES) + ") / chars::DOUBLE]"


def _divergence_sql(p: str, q: str) -> str:
    half = (f"list_sum(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {{0}}[i] > 0 THEN {{0}}[i] * "
            f"log2({{0}}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END))")
    return f"({half.format(p)} + {half.format(q)}) / 2"


QUALITY_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT *, len(t) AS chars, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {_CLASSES_SQL}
  FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents)),
h AS (SELECT *, CASE WHEN chars > 0 THEN {_HISTOGRAM_SQL} END AS hist FROM d),
cls AS (SELECT lang, [{', '.join(f'avg(hist[{k + 1}])' for k in range(len(CLASSES) + 1))}] AS classes FROM h
        WHERE chars >= 200 GROUP BY lang),
cnt AS (SELECT lang, lower(x) AS x, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM d) GROUP BY ALL),
ranked AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS share,
                  row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) AS k FROM cnt),
ref AS (SELECT lang, list(x ORDER BY k) AS common, list(share ORDER BY k) AS head FROM ranked WHERE k <= 24 GROUP BY lang),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM (
        SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (
          SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8))) WHERE k > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
own AS (
  SELECT h.*, classes, head, CASE WHEN len(w) >= 100 THEN list_transform(common, lambda c: len(list_filter(w, lambda x: lower(x) = c))
           / len(w)::DOUBLE) END AS hits
  FROM h LEFT JOIN cls ON h.lang IS NOT DISTINCT FROM cls.lang LEFT JOIN ref ON h.lang IS NOT DISTINCT FROM ref.lang),
m AS (
  SELECT own.doc_id, len(w) AS n_words, chars - c_space AS word_chars, c_symbol AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         CASE WHEN chars >= 400 THEN {_divergence_sql('hist', 'classes')} END AS dc, hits,
         list_append(hits, greatest(0, 1 - list_sum(hits))) AS p, list_append(head, greatest(0, 1 - list_sum(head))) AS q
  FROM own LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, CASE WHEN hits IS NOT NULL THEN {_divergence_sql('p', 'q')} END AS dw,
             n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(dc > 0.10, false) AND NOT coalesce(dw > 0.25, false) AS kept
FROM v
"""
