"""Phrase collocations: Misra-Gries summaries find every frequent n-gram, a second pass counts them exactly."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import lookup_join
from ..session import cut_lineage
from .arrow import bounded_batches, release
from .blocks import ASK, answer, parts_schema, record, shard_ranges, shards_for, together
from .bpe import pack, unpack

AT_LEAST = 100
LONGEST = 5
TOP = 2000
UNKNOWN = "und"
# Characters of text whose n-grams are summed before they go to their partitions. A longer text is a block of its own.
BLOCK_CHARS = 8_000_000
# Bytes of text whose n-grams one hash partition takes.
SHARD_BYTES = 32_000_000
# Salts of the first of two steps to a language's best.
SALTS = 64

# A-Z to a-z, and every character that ends a piece to a line feed.
PIECES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
TOKEN = re.compile(rb"\n|[^\x20\x09\n]+")
BREAK = 0  # word number of the end of a piece
ODD = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(11).integers(1, 2**62, 3)]
COUNTED = T.StructType([T.StructField("lang", T.StringType()), T.StructField("size", T.IntegerType()),
                        T.StructField("phrase", T.StringType()), T.StructField("f", T.LongType())])
PACKED = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("data", T.ArrayType(T.BinaryType()))])


# --- summaries ----------------------------------------------------------------------------------------------------

def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(summaries: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """One Misra-Gries summary of several: counts are added, and the (capacity + 1)-th largest is taken off all.

    However often summaries are merged, no key loses more than mass / (capacity + 1) of its count (Agarwal et al. 2012).
    """
    keys, counts = summed(*(np.concatenate(x) for x in zip(*summaries, strict=True)))
    if len(keys) > capacity:
        counts = counts - np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending numbers below 2 ** 32 by their differences, byte by byte."""
    steps = np.diff(keys.astype(np.int64), prepend=0).astype(np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64))


def _survivors(at_least: int):
    """Answers of a hash partition: which keys of each block occur `at_least` times in all blocks."""
    def reply(questions: list[list[bytes]]) -> list[list[bytes]]:
        mass = sum(int(unpack(q[2]).astype(np.int64).sum()) for q in questions)
        capacity = mass // at_least + 1
        summary, waiting, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
        for _, keys, counts in questions:
            waiting.append((unpack_sorted(keys), unpack(counts).astype(np.int64)))
            size += len(waiting[-1][0])
            if size > 4 * capacity:
                summary, waiting, size = merged([summary, *waiting], capacity), [], 0
        able = merged([summary, *waiting], capacity)[0]
        exact = np.zeros(len(able) + 1, np.int64)
        for _, keys, counts in questions:
            own = unpack_sorted(keys)
            at = np.searchsorted(able, own)
            known = np.append(able, -1)[at] == own
            exact[at[known]] += unpack(counts)[known]  # a block's keys are distinct
        frequent = able[exact[:-1] >= at_least]
        return [[shard, pack_sorted(np.intersect1d(unpack_sorted(keys), frequent, assume_unique=True))]
                for shard, keys, _ in questions]

    return reply


# --- blocks -------------------------------------------------------------------------------------------------------

def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """A hash per word number; that of BREAK is not used."""
    import xxhash

    salt = lang.encode() + b"\0"
    return np.array([0, *(xxhash.xxh3_64_intdigest(salt + w) for w in words)], np.uint64)


def ngram_codes(stream: np.ndarray, hashes: np.ndarray, longest: int, shards: int):
    """For sizes 1 to `longest`: (start places of the n-grams within pieces, their codes: partition, then 32 bits)."""
    own = hashes[stream]
    rolled, inside = own, stream != BREAK
    for size in range(1, longest + 1):
        if size > 1:
            if len(stream) < size:
                return
            rolled = rolled[:-1] * ODD[0] + own[size - 1:]
            inside = inside[:-1] & (stream[size - 1:] != BREAK)
        at = np.flatnonzero(inside)
        h = rolled[at]
        h ^= h >> np.uint64(31)
        h *= ODD[1]
        h ^= h >> np.uint64(29)
        h *= ODD[2]
        yield at, ((h >> np.uint64(32)) % np.uint64(shards) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)).view(np.int64)


def _summaries(rows: DataFrame, longest: int, shards: int) -> DataFrame:
    """Records of blocks: per language the words in order; per hash partition the block's n-grams and their counts."""
    schema = parts_schema(T.IntegerType())
    nothing = pa.array([], pa.int32())

    def run(batches):
        part = TaskContext.get().partitionId()
        numbers: dict[str, dict[bytes, int]] = {}
        streams: dict[str, list[np.ndarray]] = {}
        block, chars = part << 32, 0

        def whole_block():
            codes = [np.zeros(0, np.int64)]
            for seq, (lang, number) in enumerate(numbers.items()):
                stream, words = np.concatenate(streams[lang]), list(number)[1:]
                codes += [c for _, c in ngram_codes(stream, word_hashes(lang, words), longest, shards)]
                yield record(block % shards, block, seq,
                             [lang.encode(), pack(stream), pack([len(w) for w in words]),
                              zstandard.ZstdCompressor(level=3).compress(b"".join(words))], nothing)
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            for shard, places in shard_ranges(code >> 32):
                yield record(shard, block, ASK, [shard.to_bytes(8, "little"), pack_sorted(code[places] & 0xFFFFFFFF),
                                                 pack(n[places])], nothing)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                number = numbers.setdefault(lang, {b"\n": BREAK})
                found = TOKEN.findall(raw.translate(PIECES))
                found.append(b"\n")
                streams.setdefault(lang, []).append(
                    np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
                chars += len(raw)
                if chars >= BLOCK_CHARS:
                    yield from whole_block()
                    numbers, streams, block, chars = {}, {}, block + 1, 0
                    release()
        if numbers:
            yield from whole_block()
        numbers, streams, batch = {}, {}, None
        release()

    return rows.mapInArrow(run, schema)


def _counts_of_block(longest: int, shards: int):
    """Exact counts of the block's phrases whose hash survived, word for word, and its number of words (empty phrase).

    Packed by the partition of the phrase: language and phrase with a line feed between them, and the counts.
    """
    def counts(answers: list[list[bytes]], carried: list[tuple]) -> list[pa.RecordBatch]:
        able = np.sort(np.concatenate([np.zeros(0, np.int64), *(
            int.from_bytes(shard, "little") << 32 | unpack_sorted(keys) for shard, keys in answers)]))
        found, times = [], []
        for (lang, stream, lengths, data), _ in carried:
            stream = unpack(stream)
            raw, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum(unpack(lengths), dtype=np.int64)
            words = [raw[lo:hi] for lo, hi in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
            hashes = word_hashes(lang.decode(), words)
            found.append(lang + b"\n")
            times.append(int(np.count_nonzero(stream != BREAK)))
            before, names = np.zeros(len(stream), np.int64), [b""]  # number of the phrase of one word less at each place
            for size, (at, code) in enumerate(ngram_codes(stream, hashes, longest, shards), 1):
                place = np.minimum(np.searchsorted(able, code), max(len(able) - 1, 0))
                # A frequent phrase begins with a frequent one.
                at = at[(able[place] == code if len(able) else np.zeros(len(at), bool)) & (before[at] >= 0)]
                pair, own, n = np.unique(before[at] * (len(words) + 1) + stream[at + size - 1], return_inverse=True,
                                         return_counts=True)
                names = [(names[p] + b" " if size > 1 else b"") + words[w - 1]
                         for p, w in zip(*(x.tolist() for x in np.divmod(pair, len(words) + 1)), strict=True)]
                before = np.full(len(stream), -1, np.int64)
                before[at] = own
                found += [lang + b"\n" + name for name in names]
                times += n.tolist()
        n, squeeze = np.array(times), zstandard.ZstdCompressor(level=1).compress
        records = [(shard, [pack([len(found[k]) for k in places]), squeeze(b"".join([found[k] for k in places])),
                            pack(n[places])])
                   for shard, places in shard_ranges(np.array([zlib.crc32(x) % shards for x in found], np.int64))]
        return [pa.RecordBatch.from_arrays([pa.array([shard for shard, _ in records], pa.int32()),
                                            pa.array([data for _, data in records], pa.list_(pa.binary()))], names=PACKED.names)]

    return counts


def _total_counts(at_least: int):
    """Sums the blocks' counts of a partition's phrases and keeps those of `at_least`, and the numbers of words."""
    def run(group: pa.Table) -> pa.Table:
        release()
        total: dict[bytes, int] = {}
        for data in group.column("data"):
            lengths, raw, n = data.as_py()
            raw, lo = zstandard.ZstdDecompressor().decompress(raw), 0
            for size, k in zip(unpack(lengths).tolist(), unpack(n).tolist(), strict=True):
                phrase = raw[lo:lo + size]
                total[phrase] = total.get(phrase, 0) + k
                lo += size
        kept = [(*phrase.rsplit(b"\n", 1), n) for phrase, n in total.items() if n >= at_least or phrase.endswith(b"\n")]
        langs, phrases, n = zip(*kept, strict=True) if kept else ((), (), ())
        sizes = [phrase.count(b" ") + 1 if phrase else 0 for phrase in phrases]
        return pa.table([pa.array(langs, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()),
                         pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=COUNTED.names)

    return run


def frequent_phrases(docs: DataFrame, at_least: int = AT_LEAST, longest: int = LONGEST, text_col: str = "text",
                     lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, f): every phrase of 1 to `longest` words that occurs `at_least` times in its language.

    Size 0 (empty phrase) has the language's number of words. Texts are lower-cased (A-Z) and cut into pieces, pieces
    into words; f counts all contiguous occurrences within pieces, overlaps included.

    Pass one: a block sums its n-grams' hashes and sends them to their hash partition. That merges the blocks'
    sums into a Misra-Gries summary of more than mass / at_least entries, so that every frequent n-gram survives, and counts
    the survivors. Pass two: the block gets back which of its n-grams survived and counts these word for word; counts of all
    blocks, packed by partition of the phrase, are summed there. Hashes only choose candidates: a collision can add one, which the second pass drops, and
    never lose one. Partitions grow in number with the text. A frequent phrase is one entry per block, packed with others.

    Null texts are empty, a null language is `und`. Repeated rows all count. An empty table gives an empty result. Other
    columns are not read.
    """
    rows = docs.select(F.coalesce(lang_col, F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    shards = shards_for(rows, "text", SHARD_BYTES)
    parts = answer(_summaries(bounded_batches(rows), longest, shards), lambda: _survivors(at_least))
    found = together(parts, PACKED, _counts_of_block(longest, shards))
    return found.groupBy("shard").applyInArrow(_total_counts(at_least), COUNTED)


# --- collocations -------------------------------------------------------------------------------------------------

def _inside(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longer): for phrases inside longer ones, the highest count of these."""
    words, size = F.split("phrase", " "), F.col("size")
    part = F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(
        F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))))
    return phrases.filter("size > 2").select("lang", part.alias("phrase"), "f").groupBy("lang", "phrase").agg(
        F.max("f").alias("longer"))


def collocations(docs: DataFrame, at_least: int = AT_LEAST, longest: int = LONGEST, top: int = TOP,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words.

    Candidates occur at_least times (a). A cut after the first words gives l and r, the counts of the parts, and the
    score floor(1000 * a * n / (l * r)), n being the language's number of words; the lowest score counts, and of equal
    ones the earliest cut. Candidates inside a longer one that occurs as often are dropped. Order: score and a
    descending, then the phrase in byte order. Arithmetic is in decimals of 38 digits, which hold the products of corpora of
    10 ** 16 words; beyond, Spark raises. Awkward rows: see `frequent_phrases`.
    """
    counted = cut_lineage(frequent_phrases(docs, at_least, longest, text_col, lang_col))
    phrases = counted.filter("size > 1")
    longer = _inside(phrases)
    kept = phrases.join(longer, ["lang", "phrase"], "left").filter("longer is null or longer < f").select(
        "lang", "phrase", "size", F.col("f").alias("a"))
    total = counted.filter("size = 0").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    cuts = lookup_join(kept, total, "lang").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "n", "k", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
                       F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("right"))
    known = counted.filter("size > 0")
    cuts = lookup_join(cuts, known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = lookup_join(cuts, known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(cast(1000 as decimal(38,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)))"
                   " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").cast("long")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(lowest).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best)))
    ranked = first.filter(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# The same in SQL, for DuckDB.
COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, k, a, w, unnest(range(2, k)) AS m FROM c), (SELECT unnest(range(1, 5)) AS i)
  WHERE i + m - 1 <= k GROUP BY ALL),
kept AS (
  SELECT c.* FROM c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS p, array_to_string(w[cut + 1:k], ' ') AS q
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n, cut,
         ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN total ON total.lang = cuts.lang JOIN f x ON x.lang = cuts.lang AND x.phrase = p
       JOIN f y ON y.lang = cuts.lang AND y.phrase = q),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
                  phrase, a, l, r, n, score FROM least)
SELECT * FROM ranked WHERE rank <= 2000
"""
