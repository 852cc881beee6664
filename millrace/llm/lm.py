"""Language-model scoring with sharded Elias-Fano tries of smoothed, quantised bigram probabilities."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Shared, cut_lineage
from .arrow import bounded_batches, kept_row, release

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
END, START = b"\n", b"\n\n"  # tokens that no text can hold
PRIOR = 16.0  # weight of the unigram model in a context, in tokens
SHARD_TOKENS = 2_000_000
HOT_SHARE = 2000  # a word with 1 / HOT_SHARE of all tokens is spread over the shards; there are at most so many
FLUSH = 500_000
LEVELS = 65535  # steps of a quantised value


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


class EliasFano:
    """A rising sequence of unsigned 64-bit numbers: low bits in whole bytes, high bits in unary.

    `encode` gives the bytes; an instance reads them in place from a buffer, which may be a memory map. The width of
    the low part is rounded up to 8, 16, 32 or 64 bits so that it is read without unpacking.
    """

    HEAD = "<QQQ"

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) if n else 0
        want = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        width = next(w for w in (8, 16, 32, 64) if w >= want)
        lows = values.astype(f"u{width // 8}")
        highs = (values >> np.uint64(width)).astype(np.int64) if width < 64 else np.zeros(n, np.int64)
        bits = np.zeros((int(highs[-1]) if n else 0) + n + 1, np.uint8)
        bits[highs + np.arange(n)] = 1
        return struct.pack(cls.HEAD, n, width, len(bits)) + lows.tobytes() + np.packbits(bits).tobytes()

    def __init__(self, buffer, at: int = 0):
        self.n, self.width, n_bits = struct.unpack_from(self.HEAD, buffer, at)
        at += struct.calcsize(self.HEAD)
        self.lows = np.frombuffer(buffer, f"u{self.width // 8}", self.n, at)
        at += self.lows.nbytes
        packed = np.frombuffer(buffer, np.uint8, -(-n_bits // 8), at)
        bits = np.unpackbits(packed, count=n_bits)
        self.ones, self.zeros = np.flatnonzero(bits), np.flatnonzero(bits == 0)  # select directories
        self.end = at + packed.nbytes

    def get(self, index: np.ndarray) -> np.ndarray:
        low = self.lows[index].astype(np.uint64)
        if self.width == 64:
            return low
        return ((self.ones[index] - index).astype(np.uint64) << np.uint64(self.width)) | low

    def around(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the elements that share the high part of x."""
        high = np.zeros(len(x), np.int64) if self.width == 64 else (x >> np.uint64(self.width)).astype(np.int64)
        before = np.concatenate([[0], self.zeros - np.arange(len(self.zeros)), [self.n]])
        last = len(before) - 1
        return before[np.minimum(high, last)], before[np.minimum(high + 1, last)]

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """First index in lo..hi-1 whose value is at least x, else hi."""
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.get(mid) < x[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index of x in lo..hi-1, -1 where it is not."""
        at = self.successor(x, lo, hi)
        inside = at < hi
        out = np.full(len(x), -1, np.int64)
        ok = np.flatnonzero(inside)
        out[ok] = np.where(self.get(at[ok]) == x[ok], at[ok], -1)
        return out


class Trie:
    """Two levels: words, and under each the words seen before it.

    Word hashes rise; pointers into the second level rise; the second level's entries are a word's predecessors (32-bit
    hashes) raised by its place times 2^32, so they rise too and are searched within one word's range only. Counts belong
    to words; each entry has the log10 of its smoothed numerator in LEVELS steps.
    """

    HEAD = "<ddQ"

    @classmethod
    def encode(cls, words: np.ndarray, counts: np.ndarray, place: np.ndarray, before: np.ndarray,
               logs: np.ndarray) -> bytes:
        low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
        codes = np.rint((logs - low) * (LEVELS / max(high - low, 1e-9))).astype(np.uint16)
        pointers = np.searchsorted(place, np.arange(len(words) + 1)).astype(np.uint64)
        parts = [EliasFano.encode(words), EliasFano.encode(pointers),
                 EliasFano.encode((place.astype(np.uint64) << np.uint64(32)) | before.astype(np.uint64))]
        return struct.pack(cls.HEAD, low, high, len(words)) + b"".join(parts) + counts.astype("<i8").tobytes() + codes.tobytes()

    def __init__(self, buffer):
        self.low, self.high, n = struct.unpack_from(self.HEAD, buffer)
        self.words = EliasFano(buffer, struct.calcsize(self.HEAD))
        self.pointers = EliasFano(buffer, self.words.end)
        self.entries = EliasFano(buffer, self.pointers.end)
        self.counts = np.frombuffer(buffer, "<i8", n, self.entries.end)
        self.codes = np.frombuffer(buffer, np.uint16, self.entries.n, self.entries.end + 8 * n)

    def word(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words, -1 for unknown ones."""
        return self.words.find(hashes, *self.words.around(hashes))

    def log(self, place: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Stored log10 of known words (by place) after `before`; NaN where the pair was not seen."""
        lo, hi = (self.pointers.get(place + k).astype(np.int64) for k in (0, 1))
        at = self.entries.find((place.astype(np.uint64) << np.uint64(32)) | before.astype(np.uint64), lo, hi)
        out = np.full(len(place), np.nan)
        seen = at >= 0
        out[seen] = self.low + self.codes[at[seen]] * ((self.high - self.low) / LEVELS)
        return out


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def unigrams(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): hash and count of every token, ends included."""
    texts = bounded_batches(docs).select(F.col(text_col).alias("text"))

    def run(batches):
        counts: Counter = Counter()

        def flush():
            words = np.array([word_hash(w) for w in counts], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(words), pa.array(np.fromiter(counts.values(), np.int64, len(counts)))], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(_tokens(text.as_py()))
            counts[END] += batch.num_rows
            if len(counts) > FLUSH:
                yield flush()
                counts.clear()
        if counts:
            yield flush()
        counts.clear()
        release()

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


PARTS = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("block", T.LongType()),
    T.StructField("words", T.BinaryType()),  # distinct word hashes; null in the record that holds the rows
    T.StructField("uses", T.BinaryType()),  # entries per word
    T.StructField("before", T.BinaryType()),  # per entry: the word before, the text, how often
    T.StructField("texts", T.BinaryType()),
    T.StructField("times", T.BinaryType()),
    T.StructField("facts", T.BinaryType()),  # per text: whether it trains; in the record of rows its tokens
])


def _squeeze(data: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data.tobytes())


def _expand(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _pairs(rows: DataFrame, shards: int, hot: Shared) -> DataFrame:
    """Per batch of texts: its rows, and per shard the (word, word before, text, times) entries of its pairs.

    A pair belongs to the shard of its word, and of both words where the word is hot.
    """
    def run(batches):
        spread = np.array(sorted(hot.value), np.uint64)
        part = TaskContext.get().partitionId()
        mine = None
        for seq, batch in enumerate(batches):
            number = Numbers({END: 0, START: 1})
            doc, word, before, size = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                own = np.array(list(map(number.__getitem__, _tokens(text.as_py()))), np.int64)
                word += [own, [0]]
                before += [[1], own]
                doc.append(np.full(len(own) + 1, k))
                size.append(len(own) + 1)
            train = np.array(batch.column(2).to_pylist(), bool)
            facts = _squeeze(train)
            block = (part << 32) + seq
            row = batch.column(0)
            mine = mine or row.type
            yield _record(block % shards, block, None, None, None, None, None, _squeeze(np.array(size, np.int64)),
                          row, mine)
            bits = max(1, (len(number) - 1).bit_length())
            low = max(1, (batch.num_rows - 1).bit_length())
            packed = (np.concatenate(word).astype(np.int64) << (bits + low)) | (
                np.concatenate(before).astype(np.int64) << low) | np.concatenate(doc)
            packed, times = np.unique(packed, return_counts=True)
            hashes = np.array([word_hash(w) for w in number], np.uint64)
            word = packed >> (bits + low)
            ahead = hashes[(packed >> low) & ((1 << bits) - 1)]
            own = hashes[word]
            mixed = np.where(np.isin(hashes, spread)[word], (own ^ (ahead * np.uint64(0x9E3779B97F4A7C15))), own)
            shard = ((mixed >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            shard, word, own, ahead, times = (x[order] for x in (shard, word, own, ahead, times))
            text = (packed[order] & ((1 << low) - 1)).astype(np.uint32)
            for at in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                first = np.concatenate([[0], np.flatnonzero(np.diff(word[at])) + 1])
                yield _record(int(shard[at[0]]), block, own[at[first]].tobytes(),
                              _squeeze(np.diff(np.append(first, len(at))).astype(np.int32)),
                              (ahead[at] >> np.uint64(32)).astype(np.uint32).tobytes(), _squeeze(text[at]),
                              _squeeze(times[at].astype(np.int32)), facts, row.slice(0, 0), mine)

    row_type = rows.schema["row"].dataType
    return rows.mapInArrow(run, T.StructType([*PARTS, T.StructField("rows", T.ArrayType(row_type))]))


def _record(shard, block, words, uses, before, texts, times, facts, row, kind):
    binary = [pa.array([x], pa.binary()) for x in (words, uses, before, texts, times, facts)]
    return pa.RecordBatch.from_arrays(
        [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), *binary,
         pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row)], names=[*PARTS.names, "rows"])


def _shard_scores(parts: DataFrame, known: Shared, tokens: int, distinct: int, prior: float) -> DataFrame:
    """Per shard: builds the trie from the training entries, then answers all entries from it.

    Gives per block the sums of its texts in `words` (text numbers), `before` (known tokens), `texts` (base score) and
    `times` (score). Records of rows pass unchanged.
    """
    floor = np.log10(tokens + distinct + 1)

    def run(group: pa.Table) -> pa.Table:
        release()
        cells = {c: group.column(c).to_pylist() for c in PARTS.names}
        found = [k for k, w in enumerate(cells["words"]) if w is not None]
        if not found:
            return group
        uses = [_expand(cells["uses"][k], np.int32) for k in found]
        own = np.concatenate([np.frombuffer(cells["words"][k], np.uint64) for k in found])
        own, inverse = np.unique(own, return_inverse=True)
        place = np.repeat(inverse, np.concatenate(uses))
        before = np.concatenate([np.frombuffer(cells["before"][k], np.uint32) for k in found])
        texts = [_expand(cells["texts"][k], np.uint32) for k in found]
        times = np.concatenate([_expand(cells["times"][k], np.int32) for k in found])
        train = np.concatenate([_expand(cells["facts"][k], bool)[t] for k, t in zip(found, texts, strict=True)])
        key = (place.astype(np.uint64) << np.uint64(32)) | before
        key, pair = np.unique(key, return_inverse=True)
        seen = np.bincount(pair, times * train, len(key)).astype(np.int64)
        count = np.bincount(place, times * train, len(own)).astype(np.int64)
        everywhere = known.value
        for k in np.flatnonzero(np.isin(own, np.array(list(everywhere), np.uint64))):
            count[k] = everywhere[int(own[k])]  # a hot word has only some of its pairs here
        # The trie: words that occur in training, their training pairs.
        kept = count > 0
        rank = np.cumsum(kept) - 1
        level = key[seen > 0]
        at = (level >> np.uint64(32)).astype(np.int64)
        logs = np.log10(seen[seen > 0] + prior * (count[at] + 1) / (tokens + distinct + 1))
        trie = Trie(Trie.encode(own[kept], count[kept], rank[at], level.astype(np.uint32), logs))
        # Queries: every distinct pair once.
        asked = (key >> np.uint64(32)).astype(np.int64)
        home = trie.word(own)[asked]
        c = np.where(home >= 0, trie.counts[np.maximum(home, 0)] if trie.words.n else 0, 0)
        answer = np.log10(prior * (c + 1)) - floor
        ok = np.flatnonzero(home >= 0)
        stored = trie.log(home[ok], key[ok].astype(np.uint32))
        answer[ok] = np.where(np.isnan(stored), answer[ok], stored)
        # A word is the context of the token after it, an end is not.
        ends = own == np.uint64(word_hash(END))
        follows = np.where(ends[asked], 0.0, np.log10(c + prior))
        base = np.log10(c + 1) - floor
        lo = 0
        for k, text in zip(found, texts, strict=True):
            mine, m = pair[lo:lo + len(text)], times[lo:lo + len(text)]
            lo += len(text)
            ids, where = np.unique(text, return_inverse=True)
            cells["words"][k] = ids.tobytes()
            cells["before"][k] = np.bincount(where, m * (c[mine] > 0), len(ids)).astype(np.int32).tobytes()
            cells["texts"][k] = np.bincount(where, m * base[mine], len(ids)).tobytes()
            cells["times"][k] = np.bincount(where, m * (answer[mine] - follows[mine]), len(ids)).tobytes()
            cells["uses"][k] = cells["facts"][k] = b""
        columns = [pa.array(cells[f.name], group.schema.field(f.name).type) for f in PARTS]
        return pa.Table.from_arrays([*columns, group.column("rows")], schema=group.schema)

    return parts.groupBy("shard").applyInArrow(run, parts.schema)


def _sums(parts: DataFrame, opening: float) -> DataFrame:
    row_type = parts.schema["rows"].dataType.elementType

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("shard").to_numpy(), kind="stable")
        whole = next(k for k in order.tolist() if group.column("words")[k].as_py() is None)
        tokens = _expand(group.column("facts")[whole].as_py(), np.int64)
        known, base, score = np.zeros(len(tokens), np.int64), np.zeros(len(tokens)), np.full(len(tokens), -opening)
        for k in order.tolist():
            words, before, texts, times = (group.column(c)[k].as_py() for c in ("words", "before", "texts", "times"))
            if words is None:
                continue
            at = np.frombuffer(words, np.uint32)
            known[at] += np.frombuffer(before, np.int32)
            base[at] += np.frombuffer(texts, np.float64)
            score[at] += np.frombuffer(times, np.float64)
        return pa.Table.from_arrays(
            [group.column("rows")[whole].values, pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)],
            names=["row", "n_tokens", "n_known", "base_score", "score"])

    schema = T.StructType([T.StructField("row", row_type), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()),
                           T.StructField("score", T.DoubleType())])
    return parts.groupBy("block").applyInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 7, is 2. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def learn_and_score(docs: DataFrame, held_out: Column, keep: Sequence[str] | None = None, text_col: str = "text",
                    prior: float = PRIOR, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Scores all texts under a bigram model of those not held out.

    Returns `row` (struct of the `keep` columns), n_tokens, n_known, train_tokens, base_score (add-one unigrams) and
    score: log10 of the product of P(w | v) = (c(v w) + prior P1(w)) / (c(v) + prior), P1 the add-one unigrams, over the
    words and the end, a start before them.

    One shuffle sends every text's distinct pairs to the shard of their word. There the training pairs become an
    Elias-Fano trie and all pairs are looked up in it; the part of P that depends on v alone is added where v is the
    word. Sums per text return to its block. Shards hold about `shard_tokens` tokens whatever the size of the corpus, so the
    model grows with it and is never gathered. Words with over 1 / HOT_SHARE of all tokens, at most HOT_SHARE of them,
    are broadcast with their counts and spread by both words. Predecessors count as equal on 32 bits of hash within a word.

    Null text counts as empty and is scored as an end alone. Without training texts every score rests on N = V = 0.
    Repeated rows train as often as they occur. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    counts = cut_lineage(unigrams(docs.filter(~held_out), text_col))
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    training = docs.filter(~held_out).count()
    frequent = counts.filter(F.col("n") * HOT_SHARE > tokens).collect()
    hot = Shared(spark, {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in frequent})
    shards = max(1, -(-int(tokens) // shard_tokens))
    rows = bounded_batches(docs).select(kept_row(docs, keep), F.col(text_col).alias("text"), (~held_out).alias("train"))
    scored = _shard_scores(_pairs(rows, shards, hot), hot, int(tokens), int(distinct), prior)
    found = _sums(scored, float(np.log10(training + prior)))
    return found.select("row", "n_tokens", "n_known", F.lit(int(tokens)).cast("long").alias("train_tokens"),
                        "base_score", "score")
