"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import n_words, seeded

# Sources up to which their table, one short row each, is broadcast; beyond it they are joined by shuffling.
BROADCAST_SOURCES = 100_000


def targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Target size per source from (`source`, `source_size`).

    Weights repeat over the sources in code point order, null last, and share the whole size. A target stops at
    `cap` times its source; the excess goes to the others by weight until none is above. With sources sorted by
    cap / weight, the level every uncapped source reaches per unit of weight is the largest of
    (total - caps before) / (weights from here on), so no rounds are needed.

    One row per source passes through a single task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("__cap") / F.col("__w"), "rank")
    everything = Window.partitionBy()
    pick = F.element_at(F.array(*(F.lit(int(w)) for w in weights)),
                        (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    ranked = (
        sources.withColumn("rank", F.row_number().over(by_name).cast("long"))
        .withColumn("__w", pick).withColumn("__cap", F.col("source_size") * cap)
        .withColumn("__total", F.sum("source_size").over(everything))
    )
    before = F.coalesce(F.sum("__cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("__w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("__level", (F.col("__total") - before).cast("double") / rest)
    return level.select(
        "source", "rank", "source_size", F.col("__total").alias("total"),
        F.least(F.col("__cap").cast("double"), F.max("__level").over(everything) * F.col("__w")).alias("target"))


def apportion(parties: DataFrame, votes: str, seats: str, most: str, order: str, within: Sequence[str] = ()) -> DataFrame:
    """Sainte-Lague seats as the column `quota`; `seats` is the house size and `most` a party's limit.

    Highest quotients votes / (2k + 1) win. With V votes and n parties, the divisor V / (seats - n/2) surely
    awards too few seats and V / (seats + n/2) enough, so only the few quotients between the two are listed and
    ranked, not one row per seat. Ties go to the lower `order`.
    """
    group = Window.partitionBy(*within)
    v, n = F.col("__votes"), F.col("__n") / F.lit(2.0)
    share = F.when(v > 0, F.col(votes).cast("double") / v).otherwise(0.0)
    sure = F.floor(share * (F.col(seats) - n) + 0.5) - 1
    enough = F.floor(share * (F.col(seats) + n) + 0.5) + 1
    bounded = (
        parties.withColumn("__votes", F.sum(F.col(votes).cast("double")).over(group))
        .withColumn("__n", F.count(F.lit(1)).over(group))
        .withColumn("__sure", F.least(F.greatest(sure.cast("long"), F.lit(0)), F.col(most)))
        .withColumn("__enough", F.least(F.greatest(enough.cast("long"), F.lit(0)), F.col(most)))
        .withColumn("__open", F.col(seats) - F.sum("__sure").over(group))
    )
    steps = F.when(F.col("__enough") > F.col("__sure"), F.sequence(F.col("__sure"), F.col("__enough") - 1))
    quotient = F.col(votes).cast("double") / (2 * F.col("__k") + 1)
    ranked = (
        bounded.withColumn("__k", F.explode_outer(steps))
        .withColumn("__place", F.row_number().over(
            Window.partitionBy(*within).orderBy(F.col("__k").isNull(), quotient.desc(), order, "__k")))
    )
    won = (F.col("__k").isNotNull() & (F.col("__place") <= F.col("__open")) & (F.col(votes) > 0)).cast("long")
    keys = [c for c in parties.columns]
    return (ranked.groupBy(*keys, "__sure").agg(F.sum(won).alias("__won"))
            .select(*keys, (F.col("__sure") + F.col("__won")).alias("quota")))


def _covered(length: Column, upto: Column, point: Column) -> Column:
    """How many of the positions 0 .. upto-1 of an endless tape of period `length` fall below `point` in their period."""
    return F.floor(upto / length).cast("long") * point + F.least(F.pmod(upto, length), point)


def mix(docs: DataFrame, keep: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights: Sequence[int] = (5, 2, 1), cap: int = 3, block_words: int = 8,
        shard_words: int = 100_000, max_shards: int = 4096, seed: int = 10) -> DataFrame:
    """Words taken from every document so that the sources reach their target shares.

    Returns one row per input row: `row` (struct of the `keep` columns, all by default), `source`, `size`,
    `source_size`, `target`, `taken`. The mix holds total / `block_words` blocks of `block_words` words.
    Sainte-Lague hands them to the sources by target, then each source's to its shards by size. A shard lays its
    documents on a tape in seeded order and takes its blocks from a seeded start, going round again for repeats;
    a document's `taken` is what those blocks cover of it, so never above `cap` times its size.

    Shards bound what one task sorts: a source has one per `shard_words` words, up to `max_shards`, and holds
    narrow rows (what `keep` names). The documents are shuffled once, to their shards. Null text, or one without words, has size 0 and takes nothing. A null source is a
    source of its own, last in order. Repeated rows count each for itself. An empty table gives an empty result.
    Columns of `docs` cannot clash with the results, which sit beside `row`.
    """
    text = F.col(text_col)
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)))
    sized = docs.select(row.alias("row"), F.col(id_col).alias("__id"), F.col(source_col).alias("source"),
                        n_words(text).alias("size"))
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    blocks = plan.withColumn("__blocks", F.floor(F.col("total") / block_words)).withColumn(
        "__most", F.floor(F.col("source_size") * cap / block_words))
    quotas = apportion(blocks, "target", "__blocks", "__most", "rank").withColumn(
        "__shards", F.greatest(F.lit(1), F.least(F.lit(max_shards), F.ceil(F.col("source_size") / shard_words))))

    few = docs.select(source_col).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES

    def dealt(frame: DataFrame) -> DataFrame:
        known = quotas.select(F.col("source").alias("__source"), "rank", "source_size", "target", "quota", "__shards")
        known = F.broadcast(known) if few else known
        return (frame.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
                .withColumn("shard", F.pmod(seeded(seed, F.col("__id")), F.col("__shards"))))

    shards = (dealt(sized.select("__id", "source", "size")).groupBy("rank", "shard", "quota")
              .agg(F.sum("size").alias("length"))
              .withColumn("__most", F.floor(F.col("length") * cap / block_words)))
    shares = apportion(shards.withColumnRenamed("quota", "seats"), "length", "seats", "__most", "shard", ["rank"])
    start = F.when(F.col("length") > 0, F.pmod(seeded(seed + 1, F.col("rank"), F.col("shard")), F.col("length")))
    shares = shares.select(F.col("rank").alias("__rank"), F.col("shard").alias("__shard"), "length",
                           F.coalesce(start, F.lit(0)).alias("start"),
                           (F.col("quota") * block_words).alias("__words"))
    tape = Window.partitionBy("rank", "shard").orderBy(seeded(seed + 2, F.col("__id")), "__id", "size")
    laid = dealt(sized).withColumn("end", F.sum("size").over(tape.rowsBetween(Window.unboundedPreceding, 0)))
    both = laid.join(shares, (F.col("rank") == F.col("__rank")) & (F.col("shard") == F.col("__shard")))
    length, start, stop = F.col("length"), F.col("start"), F.col("start") + F.col("__words")

    def below(point: Column) -> Column:
        return _covered(length, stop, point) - _covered(length, start, point)

    taken = F.when(F.col("size") > 0, below(F.col("end")) - below(F.col("end") - F.col("size"))).otherwise(0)
    return both.select("row", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeated(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix as whole documents: each row as often as its words were taken, rounded by a seeded draw."""
    part = F.col("taken") / F.col("size")
    draw = seeded(5, F.col(f"row.{id_col}")) / F.lit(float(16**15))
    times = F.when(F.col("size") > 0, F.floor(part + draw).cast("int")).otherwise(0)
    return (mixed.withColumn("__times", times).filter(F.col("__times") > 0)
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("row.*"))


# The same in SQL, for DuckDB. `docs` names the input.
MIX_SQL = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
capped AS (
  SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS cap,
         sum(source_size) OVER ()::BIGINT AS total FROM src),
lev AS (
  SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM capped WINDOW o AS (ORDER BY cap::DOUBLE / w, rank)),
tgt AS (
  SELECT source, rank, source_size, total, least(cap::DOUBLE, (max(level) OVER ()) * w) AS target,
         total // 8 AS seats, source_size * 3 // 8 AS most FROM lev),
sure AS (
  SELECT *, CASE WHEN v > 0 THEN target / v ELSE 0 END AS share FROM (
    SELECT *, sum(target) OVER () AS v, count(*) OVER () AS n FROM tgt)),
lim AS (
  SELECT *, least(greatest(floor(share * (seats - n / 2.0::DOUBLE) + 0.5)::BIGINT - 1, 0), most) AS s0,
         least(greatest(floor(share * (seats + n / 2.0::DOUBLE) + 0.5)::BIGINT + 1, 0), most) AS s1 FROM sure),
cand AS (
  SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS place FROM (
    SELECT rank, target, s0, seats - (SELECT sum(s0) FROM lim) AS open, unnest(range(s0, s1)) AS k FROM lim)),
quota AS (
  SELECT l.*, s0 + coalesce(won, 0) AS quota,
         greatest(1, least(4096, ceil(source_size / 100000.0::DOUBLE)::BIGINT)) AS shards
  FROM lim l LEFT JOIN (SELECT rank, count(*) AS won FROM cand WHERE place <= open AND target > 0 GROUP BY rank) c
  USING (rank)),
dealt AS (
  SELECT d.*, q.rank, q.source_size, q.target, q.quota,
         ('0x' || substr(md5('10:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % shards AS shard
  FROM sized d JOIN quota q ON d.source IS NOT DISTINCT FROM q.source),
sh AS (
  SELECT rank, shard, quota AS seats, sum(size)::BIGINT AS length, sum(size)::BIGINT * 3 // 8 AS most
  FROM dealt GROUP BY ALL),
shl AS (
  SELECT *, least(greatest(floor(share * (seats - n / 2.0::DOUBLE) + 0.5)::BIGINT - 1, 0), most) AS s0,
         least(greatest(floor(share * (seats + n / 2.0::DOUBLE) + 0.5)::BIGINT + 1, 0), most) AS s1 FROM (
    SELECT *, CASE WHEN v > 0 THEN length::DOUBLE / v ELSE 0 END AS share FROM (
      SELECT *, sum(length::DOUBLE) OVER (PARTITION BY rank) AS v, count(*) OVER (PARTITION BY rank) AS n FROM sh))),
shc AS (
  SELECT *, row_number() OVER (PARTITION BY rank ORDER BY length::DOUBLE / (2 * k + 1) DESC, shard, k) AS place FROM (
    SELECT rank, shard, length, seats - sum(s0) OVER (PARTITION BY rank) AS open, unnest(range(s0, s1)) AS k
    FROM shl)),
shq AS (
  SELECT l.rank, l.shard, length, (s0 + coalesce(won, 0)) * 8 AS words,
         CASE WHEN length > 0 THEN ('0x' || substr(md5('11:' || l.rank || ':' || l.shard), 1, 15))::BIGINT % length
              ELSE 0 END AS start
  FROM shl l LEFT JOIN (
    SELECT rank, shard, count(*) AS won FROM shc WHERE place <= open AND length > 0 GROUP BY ALL) c
  ON l.rank = c.rank AND l.shard = c.shard),
laid AS (
  SELECT d.*, q.length, q.start, q.start + q.words AS stop, (sum(size) OVER (
           PARTITION BY d.rank, d.shard
           ORDER BY ('0x' || substr(md5('12:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS e
  FROM dealt d JOIN shq q ON d.rank = q.rank AND d.shard = q.shard)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN
    (stop // length) * e + least(stop % length, e) - (start // length) * e - least(start % length, e)
    - (stop // length) * (e - size) - least(stop % length, e - size)
    + (start // length) * (e - size) + least(start % length, e - size) ELSE 0 END)::BIGINT AS taken
FROM laid
"""
