"""Document fingerprints by consistent weighted sampling, and each document beside its successor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .words import GAP, text_or_empty

SAMPLES = 32
DIGITS = 6  # hexadecimal digits of a sample in the fingerprint
SCALE = 1 << 20  # steps a unit of log a sample's rank is rounded to
SPACE = 1 << (4 * DIGITS)
MOST_BUCKETS = 1 << 20  # bounds the table of bucket starts that is broadcast
COARSE = 256


def _uniform(bits: Column) -> Column:
    """Two numbers in (0, 1] from a 64-bit hash, multiplied."""
    low = (bits.bitwiseAND(F.lit(0xFFFFFFFF)) + 1) / F.lit(float(1 << 32))
    high = (F.shiftrightunsigned(bits, 32) + 1) / F.lit(float(1 << 32))
    return low * high


def sample(term: Column, log_weight: Column, number: int) -> Column:
    """Rank and name of a term in sample `number`, packed into a long whose minimum over the terms is the sample.

    Ioffe's scheme (2010): r and c are Gamma(2, 1), b uniform, all drawn from the term alone; with
    t = floor(ln w / r + b), the term ranks by ln c - r (t - b + 1), and (term, t) is what two documents agree on with
    the probability of their generalised Jaccard similarity. Gamma(2, 1) is minus the log of two uniforms' product.
    """
    r = -F.ln(_uniform(F.xxhash64(term, F.lit(3 * number))))
    c = -F.ln(_uniform(F.xxhash64(term, F.lit(3 * number + 1))))
    b = (F.xxhash64(term, F.lit(3 * number + 2)).bitwiseAND(F.lit(0xFFFFFFFF))) / F.lit(float(1 << 32))
    t = F.floor(log_weight / r + b)
    rank = F.floor((F.ln(c) - r * (t - b + 1) + 2048) * SCALE).cast("long")
    name = F.xxhash64(term, t, F.lit(number)).bitwiseAND(F.lit(SPACE - 1))
    return rank * SPACE + name


def fingerprints(texts: DataFrame, keys: Sequence[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """`keys` and `marks`: the fingerprint of every text with a word, as an array of SAMPLES numbers.

    Terms are words, weights their counts. Counting and sampling group by `keys` first, so a `texts` already
    partitioned by one of them is not shuffled again.
    """
    words = texts.select(*keys, F.explode(F.split(text_col, GAP)).alias("word")).filter("word != ''")
    counted = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("n"))
    return _sampled(counted, keys, samples)


def _sampled(counted: DataFrame, keys: Sequence[str], samples: int) -> DataFrame:
    weighted = counted.withColumn("weight", F.ln(F.col("n").cast("double")))
    least = weighted.groupBy(*keys).agg(
        *(F.min(sample(F.col("term"), F.col("weight"), k)).alias(f"s{k}") for k in range(samples)))
    return least.select(*keys, F.array(*(F.col(f"s{k}").bitwiseAND(F.lit(SPACE - 1)) for k in range(samples)))
                        .alias("marks"))


def as_text(marks: Column) -> Column:
    """The fingerprint as hexadecimal digits; '' for a text without a word."""
    return F.coalesce(F.concat_ws("", F.transform(marks, lambda m: F.lpad(F.lower(F.hex(m)), DIGITS, "0"))), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples (0 to 1). Two texts without words are alike, one without is like no other."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda total, x: total + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a))


def _dealt(rows: DataFrame, rows_per_bucket: int) -> DataFrame:
    """`rows` with `bucket` and `lap`: buckets are ranges of the numeric `id`, null last.

    The first id of every bucket is also dealt, as a guest of lap 1, to the bucket before; that of the first one to the
    last. So every row finds its successor in its bucket. Cells between COARSE quantiles of the ids are cut evenly. The
    table of bucket starts, at most MOST_BUCKETS rows of two longs, is broadcast.
    """
    total = rows.count()
    buckets = max(1, min(MOST_BUCKETS, -(-total // rows_per_bucket)))
    coarse = min(COARSE, buckets)
    fine = -(-buckets // coarse)
    cuts = rows.agg(F.percentile_approx("id", [k / coarse for k in range(coarse + 1)], 10 * COARSE)).first()[0] or []
    points = F.array(*(F.lit(int(p)).cast("long") for p in cuts)) if cuts else F.array().cast("array<long>")
    cell = F.size(F.filter(points, lambda p: p <= F.col("id"))) - 1
    low, high = F.get(points, F.col("cell")), F.get(points, F.col("cell") + 1)
    part = F.when(high > low, F.least(F.floor((F.col("id") - low) * F.lit(float(fine)) / (high - low)),
                                      F.lit(fine - 1))).otherwise(0)
    placed = rows.withColumn("cell", cell).withColumn(
        "bucket", F.when(F.col("id").isNull(), F.lit((len(cuts) + 2) * fine)).otherwise(
            F.col("cell") * fine + F.coalesce(part, F.lit(0))).cast("long")).drop("cell")
    starts = placed.groupBy("bucket").agg(F.min("id").alias("start"))
    everything = Window.orderBy("bucket")
    hosts = cut_lineage(starts.withColumn("host", F.lag("bucket").over(everything)).withColumn(
        "host", F.coalesce("host", F.max("bucket").over(Window.partitionBy()))).select("start", "host"))
    at_home = placed.join(F.broadcast(hosts), F.col("id").eqNullSafe(F.col("start")), "left").drop("start")
    stays = F.struct(F.lit(0).alias("lap"), F.col("bucket").alias("home"))
    visits = F.struct(F.lit(1).alias("lap"), F.col("host").alias("home"))
    both = F.when(F.col("host").isNull(), F.array(stays)).otherwise(F.array(stays, visits))
    return at_home.withColumn("at", F.explode(both)).select(
        *rows.columns, F.col("at.lap").alias("lap"), F.col("at.home").alias("bucket"))


def beside_next(docs: DataFrame, keep: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
                samples: int = SAMPLES, rows_per_bucket: int = 500) -> DataFrame:
    """Every document's fingerprint and those of its edited text and its successor.

    Returns `row` (struct of the `keep` columns), n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text is the document's with its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document's.

    Documents follow each other by `id_col` (a number; null last), repeated ids by text; the last is followed by the
    first, a single one by itself. Null text counts as empty; a text without words has the fingerprint ''. Equal texts
    have equal fingerprints. An empty table gives an empty result. Texts are shuffled once, to buckets of some hundred
    neighbouring ids, and everything else happens there.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)))
    dealt = _dealt(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), row.alias("row")),
                   rows_per_bucket)
    order = Window.partitionBy("bucket").orderBy("lap", F.col("id").asc_nulls_last(), "text")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    placed = dealt.withColumn("next", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half),
                      F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    placed = placed.select("bucket", "place", "lap", "row", "text", edited.alias("edited"))
    facts = F.struct("row", "lap", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"))
    # The facts of a document travel as a third "text" without words, so that no join has to bring them back.
    none = F.lit(None).cast(placed.select(facts.alias("f")).schema["f"].dataType)
    three = F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("text"), f.alias("facts")) for k, t, f in (
        (0, F.col("text"), none), (1, F.col("edited"), none), (2, F.lit(""), facts))))
    each = placed.select("bucket", "place", F.explode(three).alias("x")).select("bucket", "place", "x.*")
    keys = ["bucket", "place", "kind", "facts"]
    words = each.select(*keys, F.explode(F.split("text", GAP)).alias("word")).filter("word != '' or kind = 2")
    counted = words.select(*keys, F.xxhash64("word").alias("term")).groupBy(*keys, "term").agg(
        F.count(F.lit(1)).alias("n"))
    marked = _sampled(counted, keys, samples)
    whole = marked.groupBy("bucket", "place").agg(
        F.first("facts", ignorenulls=True).alias("facts"),
        F.max(F.when(F.col("kind") == 0, F.col("marks"))).alias("own"),
        F.max(F.when(F.col("kind") == 1, F.col("marks"))).alias("changed"))
    after = F.lead("own").over(Window.partitionBy("bucket").orderBy("place"))
    found = whole.withColumn("following", after).filter("facts.lap = 0")
    return found.select(
        "facts.row", "facts.n_chars", F.col("facts.sha").alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"))
