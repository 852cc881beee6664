"""Token counts: pieces once per distinct pre-token, joined to each document's pre-token frequencies and summed."""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Shared
from .arrow import bounded_batches, kept_row, release
from .blocks import ASK, answer, parts_schema, record, shard_ranges, shards_for, together
from .bpe import gather, pack, unpack

# Characters of text whose pre-tokens share one dictionary. A longer text is a block of its own.
BLOCK_CHARS = 8_000_000
# Largest tokenizer file that may be broadcast, in bytes.
TOKENIZER_BYTES = 64_000_000
# Texts on which steps that are said to look at one word at a time are tried.
PROBES = [" ", "a b", " a  b ", "it's 's 1 23 ! ?", "a' s", "- -", "x\ny z", "é 東 京", "e \u0301e\u0301 \u0323\u0301", "ΣΑΣ ΑΣ Σ", "Å \u212b"]


def read_tokenizer(path: str) -> str:
    """The content of a tokenizers .json; its length bounds what is broadcast."""
    with open(path, encoding="utf-8") as lines:
        content = lines.read(TOKENIZER_BYTES + 1)
    if len(content) > TOKENIZER_BYTES:
        raise ValueError(f"{path} has more than {TOKENIZER_BYTES} characters")
    return content


class PreTokens:
    """The library's steps before its model: strings of added tokens, normalisation, pre-tokens.

    `words`: no step looks across a space, and the pre-tokenizer drops spaces, so that a text's pre-tokens are those of
    its space-separated words; `cut` then gives words, and `pre_tokens` normalises and cuts each distinct word.
    """

    def __init__(self, content: str, words: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.own, self.words = Tokenizer.from_str(content), words
        added = json.loads(content).get("added_tokens") or []
        odd = [t["content"] for t in added if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]]
        if odd:
            raise ValueError(f"added tokens that are not matched literally in the raw text: {odd}")
        whole = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, whole))) if whole else None
        for probe in PROBES if words else ():
            if self.pre_tokens(probe) != [p for w in probe.split(" ") for p in self.pre_tokens(w)]:
                raise ValueError(f"the pre-tokenizer does not cut {probe!r} at its spaces")

    def pre_tokens(self, text: str) -> list[str]:
        normalise, split = self.own.normalizer, self.own.pre_tokenizer
        if text and normalise is not None:
            text = normalise.normalize_str(text)
        if not text:
            return []
        return [piece for piece, _ in split.pre_tokenize_str(text)] if split is not None else [text]

    def cut(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens (or words) of a text in order, and how often strings of added tokens stand in it."""
        parts = self.added.split(text) if self.added else [text]
        out: list[str] = []
        for part in parts:
            out += part.split(" ") if self.words else self.pre_tokens(part)
        return out, len(parts) - 1


def _by_text(place: np.ndarray, times: np.ndarray, per_text: np.ndarray, firsts: np.ndarray, flat: np.ndarray):
    """Numbers of words per text become numbers of their pre-tokens, ascending per text, with summed frequencies."""
    n = np.diff(firsts)[place]
    text = np.repeat(np.repeat(np.arange(len(per_text)), per_text), n)
    key = text << 32 | gather(flat, firsts[place], n)
    key, own = np.unique(key, return_inverse=True)
    total = np.bincount(own, np.repeat(times, n), len(key)).astype(np.int64)
    return key & 0xFFFFFFFF, total, np.bincount(key >> 32, minlength=len(per_text))


def _frequencies(rows: DataFrame, content: Shared, words: bool, shards: int) -> DataFrame:
    """Records of blocks: per text the numbers and frequencies of its distinct pre-tokens; per shard its pre-tokens.

    Numbers are ranks by frequency within the block. Carried data: numbers as differences within a text, frequencies,
    distinct pre-tokens per text, added tokens per text.
    """
    schema = parts_schema(rows.schema["row"].dataType)

    def run(batches):
        steps = PreTokens(content.value, words)
        part = TaskContext.get().partitionId()
        number: dict[str, int] = {}
        held: list[tuple] = []
        block, chars = part << 32, 0

        def whole_block():
            found: dict[str, int] = {}
            cut = [steps.pre_tokens(w) if words else [w] for w in number]
            firsts = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)
            flat = np.fromiter((found.setdefault(p, len(found)) for x in cut for p in x), np.int64, firsts[-1])
            uses = np.bincount(flat, np.repeat(sum(np.bincount(place, times, len(number)) for place, times, *_ in held),
                                               np.diff(firsts)), len(found))
            order = np.argsort(-uses, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            for seq, (place, times, per_text, added, row) in enumerate(held):
                own, total, distinct = _by_text(place, times, per_text, firsts, rank[flat])
                first = np.zeros(len(own), bool)
                first[(np.cumsum(distinct) - distinct)[distinct > 0]] = True
                yield record(block % shards, block, seq, [pack(np.where(first, own, np.diff(own, prepend=0))), pack(total),
                                                          pack(distinct), pack(added)], row)
            raw = list(found)
            raw = [raw[k].encode() for k in order.tolist()]
            for shard, places in shard_ranges(np.array([zlib.crc32(w) % shards for w in raw], np.int64)):
                own = [raw[p] for p in places.tolist()]
                data = zstandard.ZstdCompressor(level=3).compress(b"".join(own))
                yield record(shard, block, ASK, [pack(np.diff(places, prepend=0)), pack([len(w) for w in own]), data],
                             held[0][-1].slice(0, 0))

        for batch in batches:
            row, texts, lo = batch.column(0), batch.column(1), 0
            while lo < batch.num_rows:
                places, times, per_text, added, hi = [], [], [], [], lo
                while hi < batch.num_rows and (hi == lo or chars < BLOCK_CHARS):
                    text = texts[hi].as_py() or ""
                    found, n_added = steps.cut(text)
                    own, n = np.unique(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64,
                                                   len(found)), return_counts=True)
                    places.append(own)
                    times.append(n)
                    per_text.append(len(own))
                    added.append(n_added)
                    chars += len(text)
                    hi += 1
                held.append((np.concatenate(places).astype(np.int32), np.concatenate(times).astype(np.int32),
                             np.array(per_text), np.array(added), row.slice(lo, hi - lo)))
                lo = hi
                if chars >= BLOCK_CHARS:
                    yield from whole_block()
                    number, held, block, chars = {}, [], block + 1, 0
                    release()
        if held:
            yield from whole_block()
        number, held = {}, []
        batch = row = texts = None
        release()

    return rows.mapInArrow(run, schema)


def _count_pieces(content: Shared):
    """Answers of a shard: the number of pieces of every pre-token, each distinct one put to the model once."""
    def make():
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(content.value).model

        def reply(questions: list[list[bytes]]) -> list[list[bytes]]:
            pieces: dict[bytes, int] = {}
            answers = []
            for places, lengths, data in questions:
                raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
                for n in unpack(lengths).tolist():
                    word = raw[at:at + n]
                    at += n
                    if word not in pieces:
                        pieces[word] = len(model.tokenize(word.decode()))
                    out.append(pieces[word])
                answers.append([places, pack(np.array(out, np.int64))])
            return answers

        return reply

    return make


def _sums(answers: list[list[bytes]], carried: list[tuple]) -> list[pa.RecordBatch]:
    """Frequencies times pieces, summed per text."""
    word = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpack(a[0]).astype(np.int64)) for a in answers)])
    n = np.concatenate([np.zeros(0, np.int64), *(unpack(a[1]).astype(np.int64) for a in answers)])
    pieces = np.zeros(len(word), np.int64)
    pieces[word] = n
    out = []
    for (steps_up, times, per_text, added), row in carried:
        per_text = unpack(per_text).astype(np.int64)
        ends = np.cumsum(per_text)
        own = np.concatenate([[0], np.cumsum(unpack(steps_up).astype(np.int64))])
        # Differences begin anew in each text: take off what was reached before it.
        rank = own[1:] - np.repeat(own[ends - per_text], per_text)
        total = np.concatenate([[0], np.cumsum(pieces[rank] * unpack(times).astype(np.int64))])
        n_tokens = total[ends] - total[ends - per_text] + unpack(added)
        out.append(pa.RecordBatch.from_arrays([row, pa.array(n_tokens, pa.int64())], names=["row", "n_tokens"]))
    return out


def count_tokens(docs: DataFrame, tokenizer: str, keep: Sequence[str] | None = None, text_col: str = "text",
                 words: bool = False, shards: int | None = None) -> DataFrame:
    """`row` (struct of the `keep` columns) and `n_tokens` (long) of every whole text under a tokenizers .json.

    `tokenizer` is the file's content (`read_tokenizer`). Strings of added tokens inside a text count one each, as the
    library has it by default; nothing is added, cut off or padded. Each text becomes a sparse list of distinct
    pre-tokens and their frequencies. A block's distinct pre-tokens go to the shard of their hash, where the model cuts
    each into pieces once and only their number goes back; frequencies times numbers are summed per text, and no id is
    ever kept. `words` says that the tokenizer's steps before its model act on each space-separated word alone
    (tried on PROBES; ValueError): each distinct word of a block is then normalised and cut once. `shards` grows
    with the bytes of text.

    Null and empty texts have no tokens. Repeated rows are counted alike. An empty table gives an empty result. Kept
    columns cannot clash with the results. A text of any length is one block at most.
    """
    spark = docs.sparkSession
    shards = shards or shards_for(docs, text_col)
    rows = bounded_batches(docs).select(kept_row(docs, keep), F.col(text_col).alias("text"))
    content = Shared(spark, tokenizer)
    parts = answer(_frequencies(rows, content, words, shards), _count_pieces(content))
    schema = T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType())])
    return together(parts, schema, _sums)
