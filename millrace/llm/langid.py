"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Shared
from .arrow import bounded_batches, extend, flat_bytes, release
from .sampling import distinct_texts

UNKNOWN = "und"
# Texts below this length are too short to be told from no language; distance of the limit from the median in quartile
# distances, and at least its share of the median (lists and repeated words need 1.4 times it, random letters over twice).
LEAST_BYTES, SPREAD, SHARE = 200, 12.0, 1.75
BREAK = 10  # the byte that stands before a text
CHUNK = 1 << 18  # bytes scored at a time
GROUP = 4  # languages that share a tree: with more, a follower of one has an empty cell for most others
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
          T.StructField("bits_per_byte", T.DoubleType())]


@dataclass
class Trees:
    """The context trees of a few languages: every context of up to three bytes and every follower it was seen with.

    A state is a context. `two[a << 8 | b]` is the state after two bytes, `three[pair * 256 + x]` after three, where
    `pair` numbers the known pairs and x is the byte before them; unknown contexts map to their longest known suffix.
    The followers of a state are the bits set in its four words of `follows`; `before` counts those of earlier words.
    All arrays of floats have one column per language. `logs` and `bits` have a row per follower: log2 of its count
    (-inf where unseen) and its code length. The others have a row per state: `total` is log2 of what counts are
    divided by, `escape` the code length of an escape, `left` and `further` the same in the suffix without the
    followers the state had.
    """

    two: np.ndarray
    pair: np.ndarray
    three: np.ndarray
    suffix: np.ndarray
    follows: np.ndarray
    before: np.ndarray
    logs: np.ndarray
    total: np.ndarray
    escape: np.ndarray
    left: np.ndarray
    further: np.ndarray
    lowest: np.ndarray  # code length of a byte that no context had, one per language
    bits: np.ndarray | None = None

    def find(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The follower's row, -1 where the state lacks it."""
        key = state.astype(np.int64) * 256 + symbol
        word, bit = self.follows[key >> 6], (key & 63).astype(np.uint64)
        low = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        return np.where((word >> bit) & np.uint64(1), self.before[key >> 6] + low, -1)

    def walk(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Code lengths by PPM: down the suffixes until a language has the byte."""
        def seen(at):
            row = self.find(at, symbol)
            return np.where((row >= 0)[:, None], self.logs[row], -np.inf)

        log = seen(state)
        open_ = np.isneginf(log)
        out = np.where(open_, self.escape[state], self.total[state] - np.where(open_, 0, log))
        while True:
            out += np.where(open_ & (state == 0)[:, None], self.lowest, 0)
            open_ &= (state > 0)[:, None]
            if not open_.any():
                return out
            below = self.suffix[state]
            log = seen(below)
            hit = open_ & ~np.isneginf(log)
            out += np.where(hit, self.left[state] - np.where(hit, log, 0), np.where(open_, self.further[state], 0))
            open_ &= ~hit
            state = below

    def cost(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """As `walk`, from the stored code lengths where there are any."""
        row = self.find(state, symbol)
        out = self.bits[row]
        new = np.flatnonzero(row < 0)
        if len(new):
            key, back = np.unique(state[new].astype(np.int64) * 256 + symbol[new], return_inverse=True)
            out[new] = self.walk(key >> 8, key & 255)[back]
        return out


@dataclass
class Tables:
    """The languages and the trees of every GROUP of them."""

    languages: list[str]
    trees: list[Trees]


def _previous(flat: np.ndarray, starts: np.ndarray, back: int) -> np.ndarray:
    """The byte `back` places earlier, BREAK before a text's start. `starts` are offsets of non-empty texts, ascending."""
    out = np.empty_like(flat)
    out[:back] = BREAK
    out[back:] = flat[:-back] if back else flat
    for k in range(back):
        at = starts + k
        ends = np.append(starts[1:], len(flat))
        out[at[at < ends]] = BREAK
    return out


def gram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, n): how often each four-byte sequence, packed into a long, occurs in a language's texts."""
    rows = bounded_batches(docs).select(F.col(lang_col).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                part = batch.column(1).filter(pa.array(langs == lang))
                flat, at = flat_bytes(part)
                if not len(flat):
                    continue
                starts = np.unique(at[:-1][np.diff(at) > 0])
                code = flat.astype(np.uint32)
                for back in (1, 2, 3):
                    code |= _previous(flat, starts, back).astype(np.uint32) << np.uint32(8 * back)
                new, n = np.unique(code, return_counts=True)
                if lang in sums:
                    old, m = sums[lang]
                    new, where = np.unique(np.concatenate([old, new]), return_inverse=True)
                    n = np.bincount(where, np.concatenate([m, n])).astype(np.int64)
                sums[lang] = (new, n)
        for lang, (code, n) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))],
                names=["lang", "gram", "n"])
        sums.clear()
        release()

    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Tables:
    """Context trees of all languages, for PPM with escape method C and exclusions.

    A context seen n times with q different followers gives c / (n + q) to a follower seen c times and
    q / (n + q) to an escape into its suffix, where followers it had are left out. Below the empty context every byte left
    is equally likely. No context is dropped: the size follows the number of different grams.
    """
    trees = []
    for lo in range(0, len(languages), GROUP):
        names = languages[lo:lo + GROUP]
        code = np.full(len(lang), -1)
        for k, name in enumerate(names):
            code[lang == name] = k
        mine = code >= 0
        trees.append(_trees(len(names), code[mine], gram[mine], n[mine]))
    return Tables(list(languages), trees)


def _trees(width: int, code: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Trees:
    symbol, last = (gram & 255).astype(np.int64), (gram >> 8).astype(np.int64)
    (one_keys, in_one), (two_keys, in_two), (three_keys, in_three) = (
        np.unique(last & mask, return_inverse=True) for mask in (0xFF, 0xFFFF, 0xFFFFFF))
    first_two, first_three = 1 + len(one_keys), 1 + len(one_keys) + len(two_keys)
    states = first_three + len(three_keys)

    one = np.zeros(256, np.int32)
    one[one_keys] = 1 + np.arange(len(one_keys))
    two = np.tile(one, 256)  # index a << 8 | b: the state of b where a b is unknown
    two[two_keys] = first_two + np.arange(len(two_keys))
    pair = np.zeros(1 << 16, np.int32)
    pairs = np.unique(three_keys & 0xFFFF)
    pair[pairs] = 1 + np.arange(len(pairs))
    three = np.zeros((len(pairs) + 1) * 256, np.int32)
    three[256:] = np.repeat(two[pairs], 256)
    three[pair[three_keys & 0xFFFF] * 256 + (three_keys >> 16)] = first_three + np.arange(len(three_keys))
    suffix = np.zeros(states, np.int32)
    suffix[first_two:first_three] = one[two_keys & 0xFF]
    suffix[first_three:] = two[three_keys & 0xFFFF]

    homes = (np.zeros(len(gram), np.int64), 1 + in_one, first_two + in_two, first_three + in_three)
    keys, row = np.unique(np.concatenate([home * 256 + symbol for home in homes]), return_inverse=True)
    counts = np.bincount(row * width + np.tile(code, 4), np.tile(n, 4), minlength=len(keys) * width).reshape(-1, width)
    owner = keys >> 8
    # What a state has, its suffix has too.
    below = np.searchsorted(keys, suffix[owner].astype(np.int64) * 256 + (keys & 255))
    sums = lambda x: np.stack([np.bincount(owner, x[:, k], minlength=states) for k in range(width)], 1)
    size, kinds = sums(counts), sums(counts > 0)
    rest, others = size[suffix] - sums(np.where(counts > 0, counts[below], 0)), kinds[suffix] - kinds

    def logs(m, q):
        with np.errstate(divide="ignore", invalid="ignore"):
            return (np.where(q > 0, np.log2(m + q), 0.0).astype(np.float32),
                    np.where(q > 0, -np.log2(q / (m + q)), 0.0).astype(np.float32))

    follows = np.zeros(states * 4, np.uint64)
    np.bitwise_or.at(follows, keys >> 6, np.uint64(1) << (keys & 63).astype(np.uint64))
    before = np.searchsorted(keys, np.arange(states * 4) * 64)
    with np.errstate(divide="ignore"):
        found = np.log2(counts).astype(np.float32)
    lowest = np.log2(np.maximum(1, 256 - kinds[0])).astype(np.float32)
    tree = Trees(two, pair, three, suffix, follows, before, found, *logs(size, kinds), *logs(rest, others), lowest)
    tree.bits = np.concatenate([tree.walk(owner[at:at + CHUNK], keys[at:at + CHUNK] & 255)
                                for at in range(0, len(keys), CHUNK)]).astype(np.float32)
    return tree


def code_lengths(model: Tables, strings: pa.Array) -> np.ndarray:
    """Bits of each whole text under each language."""
    flat, at = flat_bytes(strings)
    out = np.zeros((len(strings), len(model.languages)))
    filled = np.flatnonzero(np.diff(at) > 0)
    if not len(filled):
        return out
    starts = at[:-1][filled]
    for lo in range(0, len(flat), CHUNK):
        hi = min(lo + CHUNK, len(flat))
        margin = max(0, lo - 3)
        first = np.searchsorted(starts, lo, "right") - 1
        inside = starts[first:np.searchsorted(starts, hi)]
        piece = flat[margin:hi]
        local = inside[inside >= margin] - margin
        prev = [_previous(piece, local, back)[lo - margin:].astype(np.int32) for back in (1, 2, 3)]
        suffix = (prev[1] << 8) | prev[0]
        cuts = np.maximum(inside, lo) - lo
        for k, tree in enumerate(model.trees):
            known = tree.pair[suffix]
            state = np.where(known > 0, tree.three[known * 256 + prev[2]], tree.two[suffix])
            cost = tree.cost(state, flat[lo:hi])
            out[filled[first:first + len(inside)], k * GROUP:(k + 1) * GROUP] += np.add.reduceat(
                cost, cuts, axis=0, dtype=np.float64)
    return out


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample_docs: int = 2000) -> Tables | None:
    """Fit on `sample_docs` distinct whole texts per language, or all where there are fewer; None without a labelled text.

    The bound makes the statistics a constant amount whatever the size of `docs`: at most 256^4 grams, and in
    practice some hundred thousand per language. A text counts once, so copies do not outweigh other texts.
    """
    labelled = docs.filter(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counted = gram_counts(distinct_texts(labelled, sample_docs, text_col, lang_col), "by", "text").toPandas()
    if not len(counted):
        return None
    return build(sorted(counted["lang"].unique()), counted["lang"].to_numpy(), counted["gram"].to_numpy(np.int64),
                 counted["n"].to_numpy(np.float64))


def identify(docs: DataFrame, model: Tables | None, keep: Sequence[str] | None = None,
             text_col: str = "text") -> DataFrame:
    """`row` (struct of the `keep` columns), lang_pred, score, bits_per_byte.

    The language with the shortest code wins, the first by name on a tie. `score` is its share among all languages
    when 16 bytes' worth of the difference counts. Null texts and texts without a letter are `und` with score 0; so is
    everything when no language was learnt. Long texts are scored whole, in pieces. Repeated rows score alike.
    """
    sent = None if model is None else Shared(docs.sparkSession, model)

    def make():
        tables = None if sent is None else sent.value

        def score(batch: pa.RecordBatch) -> list:
            text = batch.column(1)
            letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if tables is None:
                letter = np.zeros(len(text), bool)
                names, won, rate = [], np.zeros(len(text), int), np.zeros(len(text))
                chance = np.zeros(len(text))
            else:
                bits = code_lengths(tables, text)
                size = np.maximum(1, np.diff(flat_bytes(text)[1]))
                won = bits.argmin(1)
                least = bits.min(1)
                rate = least / size
                chance = 1 / np.exp2(-(bits - least[:, None]) * (np.minimum(16, size) / size)[:, None]).sum(1)
                names = tables.languages
            pick = [names[w] if ok else UNKNOWN for w, ok in zip(won, letter, strict=True)]
            return [pa.array(pick, pa.string()), pa.array(np.where(letter, chance, 0.0)),
                    pa.array(np.where(letter, rate, 0.0))]

        return score

    return extend(docs, keep, [F.col(text_col).alias("text")], FIELDS, make)


def limits(docs: DataFrame, model: Tables | None, lang_col: str = "lang", text_col: str = "text") -> dict[str, float]:
    """Bits per byte above which a text of LEAST_BYTES is in none of the learnt languages, per language.

    Taken from all labelled texts of that length that are predicted to be in their own language: the median plus SPREAD
    times the distance from it to the upper quartile (8 deviations of normal rates), and SHARE times the median at least;
    junk among the texts hardly moves these. One pass; a row per language reaches the driver. A language without such texts has no limit.
    """
    own = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(
        F.col("lang").isNotNull() & (F.octet_length("text") >= LEAST_BYTES))
    found = identify(own, model, ["lang"]).filter(F.col("row.lang") == F.col("lang_pred"))
    rows = found.groupBy("lang_pred").agg(F.percentile_approx("bits_per_byte", [0.5, 0.75], 10_000).alias("q")).collect()
    return {r["lang_pred"]: max(SHARE * r["q"][0], r["q"][0] + SPREAD * (r["q"][1] - r["q"][0])) for r in rows}


def within(limits: dict[str, float], text: Column) -> Column:
    """Whether an identified text is in its language: shorter than LEAST_BYTES, or coded in its language's limit."""
    if not limits:
        return F.lit(True)
    table = F.create_map(*(F.lit(x) for pair in sorted(limits.items()) for x in pair))
    limit = F.coalesce(F.try_element_at(table, F.col("lang_pred")), F.lit(float("inf")))
    return (F.octet_length(text) < LEAST_BYTES) | (F.col("bits_per_byte") <= limit)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents no language is learnt from: crc32 of the id as text, modulo 4, is 2. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
