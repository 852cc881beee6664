"""Personal data: fixed patterns, and terms that disclose what the patterns protect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import let, text_or_empty

KINDS = ("email", "ip", "card", "phone")
TERM = "term"  # the kind of spans that disclosure adds
# Each pattern finds what its plain form finds from left to right. A run is entered at its start (or where the last match
# ended) and never given back, which keeps long runs linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold before its pattern is tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WORD = r"\p{L}{3,}"
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"
BYTE = r"^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"


def doubling(values: Column, combine) -> Column:
    """Running combination of an array (sums, maxima) in n log n steps: each round reaches twice as far back."""
    def run(v: Column) -> Column:
        rounds = F.ceil(F.log2(F.greatest(F.size(v), F.lit(1)) + 1)).cast("int")
        reach = F.transform(F.sequence(F.lit(0), rounds), lambda k: F.pow(F.lit(2.0), k).cast("int"))
        return F.aggregate(reach, v, lambda acc, far: F.transform(
            acc, lambda x, i: F.coalesce(combine(x, F.get(acc, i - far)), x)))

    return let(values, run)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in code points, end exclusive."""
    def placed(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]
        ends = doubling(F.transform(found, lambda m, i: F.length(F.get(gaps, i)) + F.length(m)), lambda x, y: x + y)
        return let(ends, lambda e: F.transform(found, lambda m, i: F.struct(
            (F.get(e, i) - F.length(m)).cast("long").alias("start"), F.get(e, i).cast("long").alias("end"),
            m.alias("value"))))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                    F.split(text, pattern, -1).alias("gaps"))
    return let(both, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    place = F.sequence(F.lit(1), F.length(digits))
    parts = F.transform(place, lambda i: (F.substring(digits, -i, F.lit(1)).cast("int")
                                          * F.when(i % 2 == 0, 2).otherwise(1)))
    return F.aggregate(parts, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(BYTE))
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) of the fixed patterns, by kind as listed and then start."""
    def of(kind: str) -> Column:
        needed = text.contains(NEEDS[kind]) if kind == "email" else text.rlike(NEEDS[kind])
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
        spans = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"),
                                                      m["end"].alias("end"), m["value"].alias("value")))
        return F.coalesce(F.when(needed, spans), F.array().cast(SPANS))

    return F.concat(*(of(kind) for kind in KINDS))


def _contexts(text: Column, spans: Column, reach: int) -> Column:
    """Array of (entity, term, start, end): whole words within `reach` code points of each span, outside all spans."""
    def around(s: Column, spans: Column) -> Column:
        lo = F.greatest(F.lit(0).cast("long"), s["start"] - reach)
        left = F.substring(text, lo.cast("int") + 1, (s["start"] - lo).cast("int"))
        right = F.substring(text, s["end"].cast("int") + 1, F.lit(reach))
        size = F.length(text)

        def terms(piece: Column, at: Column, cut_left: Column, cut_right: Column) -> Column:
            words = F.filter(matches(piece, WORD), lambda m: ~((m["start"] == 0) & cut_left)
                             & ~((m["end"] == F.length(piece)) & cut_right))
            return F.transform(words, lambda m: F.struct(
                F.concat(s["kind"], F.lit(":"), F.lower(s["value"])).alias("entity"), F.lower(m["value"]).alias("term"),
                (m["start"] + at).alias("start"), (m["end"] + at).alias("end")))

        near = F.concat(terms(left, lo, lo > 0, F.lit(True)),
                        terms(right, s["end"], F.lit(True), s["end"] + reach < size))
        return F.filter(near, lambda t: ~F.exists(spans, lambda o: (t["start"] < o["end"]) & (t["end"] > o["start"])))

    return let(spans, lambda all_spans: F.flatten(F.transform(all_spans, lambda s: around(s, all_spans))))


def disclosures(docs: DataFrame, occurrences: DataFrame, text_col: str = "text", min_documents: int = 3,
                threshold: float = 0.8) -> DataFrame:
    """(entity, term, disclosure) of terms that give an entity away.

    disclosure is the pointwise mutual information of term and entity over the entity's information content,
    ln(N n_te / (n_t n_e)) / ln(N / n_e): 1 for a term seen only near the entity, below 0 for one that avoids it. N, n_t and
    n_e count documents of the whole corpus, n_te those with the term near the entity; a pair needs `min_documents`.
    """
    total = docs.count()
    entities = (occurrences.select("digest", "copies", "entity").distinct().groupBy("entity")
                .agg(F.sum("copies").alias("n_e")))
    pairs = (occurrences.filter("term is not null").select("digest", "copies", "entity", "term").distinct()
             .groupBy("entity", "term").agg(F.sum("copies").alias("n_te")).filter(F.col("n_te") >= min_documents))
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), F.lit(0))))
                        .alias("term"))
    frequency = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    known = pairs.join(entities, "entity").join(frequency, "term")
    n = F.lit(float(total))
    value = F.ln(n * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.ln(n / F.col("n_e"))
    return known.withColumn("disclosure", F.when(F.col("n_e") < n, value)).filter(
        F.col("disclosure") >= threshold).select("entity", "term", "disclosure")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_private(docs: DataFrame, keep: Sequence[str] | None = None, text_col: str = "text", reach: int = 60,
                 min_documents: int = 3, threshold: float = 0.8) -> DataFrame:
    """`row` (struct of the `keep` columns), n_email, n_ip, n_card, n_phone, spans.

    `spans` is an array of (kind, start, end, disclosure), in code points, by kind as listed, then start: the fixed patterns'
    matches (disclosure null), then as kind `term` the words within `reach` code points of a match that disclose its
    value by `disclosures`. Statistics come from all documents; only the words near a match, and one count per distinct
    word, are shuffled. Equal texts get equal spans and are joined once by digest.

    Null text counts as empty. Repeated rows count as documents. An empty table gives an empty result. Texts of any length
    are read whole. Kept columns cannot clash with the results.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)))
    text = docs.select(row.alias("row"), text_or_empty(text_col).alias("text"))
    found = text.withColumn("base", base_spans(F.col("text")))
    private = found.filter(F.size("base") > 0).select(
        F.md5("text").alias("digest"), "base", _contexts(F.col("text"), F.col("base"), reach).alias("near"))
    texts = private.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.first("base").alias("base"),
                                          F.first("near").alias("near"))
    blank = F.transform("base", lambda s: F.struct(
        F.concat(s["kind"], F.lit(":"), F.lower(s["value"])).alias("entity"), F.lit(None).cast("string").alias("term"),
        s["start"].alias("start"), s["end"].alias("end")))
    occurrences = cut_lineage(texts.select("digest", "copies", F.explode(F.concat("near", blank)).alias("o")).select(
        "digest", "copies", "o.*"))
    telling = disclosures(text, occurrences, "text", min_documents, threshold)
    extra = (occurrences.filter("term is not null").join(telling, ["entity", "term"]).groupBy("digest", "start", "end")
             .agg(F.max("disclosure").alias("disclosure")).groupBy(F.col("digest").alias("__digest"))
             .agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("extra")))
    fixed = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                  F.lit(None).cast("double").alias("disclosure")))
    added = F.transform("extra", lambda s: F.struct(F.lit(TERM).alias("kind"), s["start"].alias("start"),
                                                   s["end"].alias("end"), s["disclosure"].alias("disclosure")))
    spans = F.concat("fixed", F.coalesce(added, F.array().cast(
        "array<struct<kind:string,start:bigint,end:bigint,disclosure:double>>")))
    lines = found.select("row", fixed.alias("fixed"), F.when(F.size("base") > 0, F.md5("text")).alias("digest"))
    counts = (_count("fixed", kind).alias(f"n_{kind}") for kind in KINDS)
    return lines.join(extra, F.col("digest") == F.col("__digest"), "left").select("row", *counts, spans.alias("spans"))


def sanitised(text: Column, spans: Column, remove_at: float = 0.95) -> Column:
    """The text with fixed spans replaced by [KIND] and terms generalised to [TERM], or removed from `remove_at` on."""
    def rebuilt(sorted_spans: Column) -> Column:
        reach = doubling(F.transform(sorted_spans, lambda s: s["end"]), F.greatest)
        return let(reach, lambda ends: F.concat(
            F.array_join(F.transform(sorted_spans, lambda s, i: piece(s, F.coalesce(F.get(ends, i - 1), F.lit(0)))), ""),
            F.substring(text, F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)).cast("int") + 1, F.length(text))))

    def piece(s: Column, before: Column) -> Column:
        mask = F.when((s["kind"] == TERM) & (s["disclosure"] >= remove_at), F.lit("")).otherwise(
            F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        between = F.substring(text, before.cast("int") + 1, (s["start"] - before).cast("int"))
        return F.when(s["start"] >= before, F.concat(between, mask)).otherwise("")

    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["disclosure"].alias("disclosure"))))
    return let(by_place, rebuilt)


# The same in SQL, for DuckDB, with the default limits.
PRIVATE_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pat(kind, ord, p) AS (VALUES
  ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 2, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
  ('card', 3, '[0-9](?:[ -]?[0-9])+'), ('phone', 4, '\+[0-9][ ().0-9-]+[0-9]')),
f AS (SELECT doc_id, t, kind, ord, regexp_extract_all(t, p) AS f, string_split_regex(t, p) AS g FROM d, pat),
e AS (
  SELECT doc_id, t, kind, ord, f[i] AS v, regexp_replace(f[i], '[^0-9]', '', 'g') AS digits,
         (list_sum(list_transform(g[1:i], lambda x: len(x)))
          + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: len(x))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM f)),
base AS MATERIALIZED (
  SELECT doc_id, t, kind, ord, v, s, s + len(v) AS z FROM e
  WHERE kind = 'email'
     OR kind = 'ip' AND len(list_filter(string_split(v, '.'), lambda x: x::HUGEINT > 255)) = 0
     OR kind = 'phone' AND len(digits) BETWEEN 9 AND 15
     OR kind = 'card' AND len(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(digits) + 1), lambda i:
          CASE WHEN i % 2 = 1 THEN digits[len(digits) - i + 1]::INT
               ELSE digits[len(digits) - i + 1]::INT * 2 // 10 + digits[len(digits) - i + 1]::INT * 2 % 10 END)) % 10 = 0),
side AS (
  SELECT doc_id, kind || ':' || lower(v) AS entity, greatest(0, s - 60) AS org, substr(t, greatest(0, s - 60) + 1, s - greatest(0, s - 60)) AS x,
         s > 60 AS cut_left, true AS cut_right FROM base
  UNION ALL
  SELECT doc_id, kind || ':' || lower(v), z, substr(t, z + 1, 60), true, z + 60 < len(t) FROM base),
near AS (
  SELECT *, regexp_extract_all(x, '\p{L}{3,}') AS f, string_split_regex(x, '\p{L}{3,}') AS g FROM side),
word AS (
  SELECT *, f[i] AS v, (list_sum(list_transform(g[1:i], lambda x: len(x)))
         + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: len(x))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM near)),
occ AS MATERIALIZED (
  SELECT doc_id, entity, lower(v) AS term, org + s AS a, org + s + len(v) AS z FROM word
  WHERE NOT (s = 0 AND cut_left) AND NOT (s + len(v) = len(x) AND cut_right) AND NOT EXISTS (
    SELECT 1 FROM base b WHERE b.doc_id = word.doc_id AND word.org + word.s < b.z AND word.org + word.s + len(word.v) > b.s)),
n AS (SELECT count(*) AS n FROM d),
ne AS (SELECT kind || ':' || lower(v) AS entity, count(DISTINCT doc_id) AS n_e FROM base GROUP BY 1),
nte AS (SELECT entity, term, count(DISTINCT doc_id) AS n_te FROM occ GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
nt AS (SELECT term, count(*) AS n_t FROM (
         SELECT unnest(list_distinct(regexp_extract_all(lower(t), '\p{L}{3,}'))) AS term FROM d) GROUP BY term),
tell AS (SELECT entity, term FROM nte JOIN ne USING (entity) JOIN nt USING (term), n
         WHERE n_e < n AND ln(n * n_te / (n_t * n_e)::DOUBLE) / ln(n / n_e::DOUBLE) >= 0.8),
spans AS (
  SELECT doc_id, kind, ord, s, z FROM base
  UNION ALL SELECT DISTINCT doc_id, 'term', 5, a, z FROM occ JOIN tell USING (entity, term)),
joined AS (
  SELECT doc_id, string_agg(kind || ':' || s || ':' || z, ',' ORDER BY ord, s, z) AS spans,
         coalesce(string_agg(kind || ':' || s || ':' || z, ',' ORDER BY ord, s) FILTER (ord < 5), '') AS fixed,
         count(*) FILTER (ord = 1) AS n_email, count(*) FILTER (ord = 2) AS n_ip, count(*) FILTER (ord = 3) AS n_card,
         count(*) FILTER (ord = 4) AS n_phone FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(fixed, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""
