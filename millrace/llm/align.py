"""Cross-tokenizer alignment: byte ends of two tokenisations of the same texts, advanced in lockstep."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Shared
from .arrow import bounded_batches, extend, flat_bytes, kept_row, release
from .blocks import ASK, answer, parts_schema, record, shard_ranges, shards_for, together
from .bpe import gather, pack, unpack

# Characters whose id pairs are counted together before they go to the shards. A longer text is a block of its own.
BLOCK_CHARS = 8_000_000
# Words whose tokens a task keeps from block to block.
WORDS_KNOWN = 300_000
# Characters that are encoded and advanced at a time.
SLICE_CHARS = 500_000
# A document's bytes are cut into lanes of this length, so that a long document takes no more steps than a short one.
LANE_BYTES = 1024
# A single space between characters that surely are no white space.
CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
# Largest tokenizer file that may be broadcast, in bytes.
TOKENIZER_BYTES = 64_000_000

FIELDS = [T.StructField("a_ids", T.ArrayType(T.IntegerType())), T.StructField("b_ids", T.ArrayType(T.IntegerType())),
          T.StructField("a_cut", T.ArrayType(T.IntegerType())), T.StructField("b_cut", T.ArrayType(T.IntegerType())),
          T.StructField("link_count", T.ArrayType(T.LongType())),
          T.StructField("link_best", T.ArrayType(T.BooleanType()))]


def _content(path: str) -> bytes:
    with open(path, "rb") as file:
        content = file.read(TOKENIZER_BYTES + 1)
    if len(content) > TOKENIZER_BYTES:
        raise ValueError(f"{path} has more than {TOKENIZER_BYTES} bytes")
    return content


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in a row, and start and length by id."""
    length = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class ByteLevel:
    """A byte-level tokenizers .json, applied to space + text; strings of special tokens are plain text.

    Its pattern starts a new pre-token at a space between other characters, so tokens never cross one.
    """

    def __init__(self, path: str):
        self.content = _content(path).decode()
        spec = json.loads(self.content)
        if spec["normalizer"] or spec["pre_tokenizer"] != {**spec["pre_tokenizer"], "type": "ByteLevel", "use_regex": True,
                                                           "add_prefix_space": False}:
            raise ValueError(f"{path} is not a plain byte-level tokenizer")

    def load(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(self.content)
        own.encode_special_tokens = True
        return lambda texts: [e.ids for e in own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def table(self):
        byte = byte_of_char()
        spec = json.loads(self.content)
        ids = {**{t["content"]: t["id"] for t in spec["added_tokens"]}, **spec["model"]["vocab"]}
        special = {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        tokens = [b""] * (max(ids.values(), default=-1) + 1)
        for piece, k in ids.items():
            tokens[k] = special[k] if k in special else bytes(byte[c] for c in piece)
        return _table(tokens)


class Pieces:
    """A sentencepiece model, which puts a space before the text itself; no piece has a space after another character."""

    def __init__(self, path: str):
        self.content = _content(path)
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_proto=self.content)
        if any("▁" in own.id_to_piece(k).lstrip("▁") for k in range(own.get_piece_size())):
            raise ValueError(f"{path} has pieces that cross a space")

    def load(self):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_proto=self.content)
        return lambda texts: own.encode(texts, num_threads=1)

    def table(self):
        from sentencepiece import SentencePieceProcessor

        own = SentencePieceProcessor(model_proto=self.content)
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        tokens = []
        for k in range(own.get_piece_size()):
            piece = own.id_to_piece(k)
            found = byte.fullmatch(piece) if own.is_byte(k) else None
            tokens.append(bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode())
        return _table(tokens)


def lockstep(end_a: np.ndarray, end_b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of all tokens whose ends meet, ascending; ends ascend strictly, lanes cover (lo, hi].

    One vector of pointers into A and one into B hold the state of all lanes. In each step every lane compares its two
    ends, emits a link where they are equal, and advances the pointer of the smaller end, or both. Finished lanes leave
    the vectors.
    """
    a, b = np.searchsorted(end_a, lo, "right"), np.searchsorted(end_b, lo, "right")
    stop_a, stop_b = np.searchsorted(end_a, hi, "right"), np.searchsorted(end_b, hi, "right")
    in_a, in_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        live = (a < stop_a) & (b < stop_b)
        if not live.all():
            a, b, stop_a, stop_b = a[live], b[live], stop_a[live], stop_b[live]
        if not len(a):
            break
        ends, others = end_a[a], end_b[b]
        meet = ends == others
        in_a.append(a[meet])
        in_b.append(b[meet])
        a, b = a + (ends <= others), b + (others <= ends)
    in_a, in_b = np.concatenate(in_a), np.concatenate(in_b)
    order = np.argsort(in_a, kind="stable")
    return in_a[order], in_b[order]


def _lanes(n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the lanes of texts that lie one after the other."""
    starts = np.cumsum(n_bytes) - n_bytes
    count = -(-n_bytes // LANE_BYTES)
    first = np.repeat(np.cumsum(count) - count, count)
    lo = np.repeat(starts, count) + (np.arange(len(first)) - first) * LANE_BYTES
    return lo, np.minimum(lo + LANE_BYTES, np.repeat(starts + n_bytes, count))


class Words:
    """The tokens of both sides of each distinct word that a task has seen, one word after the other.

    Texts are cut at single spaces between other characters. Neither side has a token across such a space (`ByteLevel`,
    `Pieces`), so a text's tokens are those of its words, each taken with a space before it.
    """

    def __init__(self, encode_a, encode_b):
        self.encode = encode_a, encode_b
        self.number: dict[str, int] = {}
        self.sides = [Grown(), Grown()]

    def add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of the texts and how many each has; new words are encoded."""
        known, number = len(self.number), self.number
        cut = [CUT.split(t) if t else [] for t in texts]
        n = np.array([len(x) for x in cut], np.int64)
        place = np.fromiter((number.setdefault(w, len(number)) for x in cut for w in x), np.int64, int(n.sum()))
        fresh = list(islice(number, known, None))
        for side, encode in zip(self.sides, self.encode, strict=True):
            side.add(encode(fresh) if fresh else [])
        return place, n


class Grown:
    """Lists of ids, one after the other: `flat`, and the `start` and `size` of each. Room is doubled when it runs out."""

    def __init__(self):
        self.flat, self.start, self.size = (np.zeros(1024, np.int64) for _ in range(3))
        self.n, self.end = 0, 0

    def add(self, lists: list[list[int]]) -> None:
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum()))
        self.flat = self._put(self.flat, self.end, ids)
        self.start = self._put(self.start, self.n, self.end + np.cumsum(size) - size)
        self.size = self._put(self.size, self.n, size)
        self.n, self.end = self.n + len(size), self.end + len(ids)

    @staticmethod
    def _put(room: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        if at + len(values) > len(room):
            room = np.concatenate([room[:at], np.zeros(max(at, len(values)) + len(values), np.int64)])
        room[at:at + len(values)] = values
        return room


def spelled(place: np.ndarray, n_words: np.ndarray, flat: np.ndarray, start: np.ndarray,
            size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts given by word numbers, one after the other, and how many each text has."""
    own = size[place]
    ends = np.concatenate([[0], np.cumsum(own)])
    return gather(flat, start[place], own), np.diff(ends[np.concatenate([[0], np.cumsum(n_words)])])


def _same(ids, sizes, table, text_bytes, text_sizes) -> np.ndarray:
    """Per text: whether its tokens' bytes are the text's."""
    flat, start, length = table
    ends = np.concatenate([[0], np.cumsum(length[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
    joined = gather(flat, start[ids], length[ids])
    at = np.concatenate([[0], np.cumsum(text_sizes)])
    ok = np.diff(ends) == text_sizes
    for k in np.flatnonzero(ok).tolist():
        ok[k] = np.array_equal(joined[ends[k]:ends[k + 1]], text_bytes[at[k]:at[k + 1]])
    return ok


def aligned_slice(texts: list[str], words: Words, table_a, table_b) -> dict[str, np.ndarray]:
    """Word numbers, ids of both sides, sizes per text, and the links' places in the flat ids.

    Texts whose tokens' bytes are not the text's have no words.
    """
    spaced, at = flat_bytes(pa.array([" " + t if t else "" for t in texts], pa.large_string()))
    n_bytes = np.diff(at)
    place, n_words = words.add(texts)
    ok = n_bytes > 0
    for k, table in enumerate((table_a, table_b)):
        side = words.sides[k]
        ok &= _same(*spelled(place, n_words, side.flat, side.start, side.size), table, spaced, n_bytes)
    place, n_words, n_bytes = place[np.repeat(ok, n_words)], n_words * ok, n_bytes * ok
    (a, n_a), (b, n_b) = (spelled(place, n_words, x.flat, x.start, x.size) for x in words.sides)
    if (table_a[2][a] == 0).any() or (table_b[2][b] == 0).any():
        raise ValueError("a token without bytes has no place in a text")
    in_a, in_b = lockstep(np.cumsum(table_a[2][a]), np.cumsum(table_b[2][b]), *_lanes(n_bytes))
    n_links = np.diff(np.searchsorted(in_a, np.concatenate([[0], np.cumsum(n_a)])))
    return {"place": place, "n_words": n_words, "a": a, "b": b, "n_a": n_a, "n_b": n_b, "n_links": n_links, "in_a": in_a,
            "in_b": in_b}


def _encode_and_link(rows: DataFrame, sent: Shared, shards: int) -> DataFrame:
    """Records of blocks: the words' ids; per slice word numbers and group sizes; per shard the id pairs linked.

    Word numbers are ranks by frequency within the block, so that they take few bits.
    """
    schema = parts_schema(rows.schema["row"].dataType)

    def run(batches):
        side_a, side_b, table_a, table_b = sent.value
        encoders = side_a.load(), side_b.load()
        part = TaskContext.get().partitionId()
        block, chars, held, pairs, words = part << 32, 0, [], [], Words(*encoders)

        def whole_block():
            empty = held[0][-1].slice(0, 0)
            uses = sum(np.bincount(x["place"], minlength=len(words.number)) for x, _ in held)
            order = np.flatnonzero(uses)
            order = order[np.argsort(-uses[order], kind="stable")]
            rank = np.zeros(len(uses), np.int64)
            rank[order] = np.arange(len(order))
            lists = [x for side in words.sides for x in (side.size[order], gather(side.flat, side.start[order], side.size[order]))]
            yield record(block % shards, block, 0, [pack(x) for x in lists], empty)
            for seq, (x, row) in enumerate(held, 1):
                yield record(block % shards, block, seq, [pack(v) for v in (
                    rank[x["place"]], x["n_words"], x["n_links"], x["group_a"], x["group_b"])], row)
            pair, n = _summed(pairs)
            for shard, places in shard_ranges((pair & 0xFFFFFFFF) % shards):
                own = pair[places]
                yield record(shard, block, ASK, [pack(own >> 32), pack(own & 0xFFFFFFFF), pack(n[places])], empty)

        for batch in batches:
            row, texts, lo = batch.column(0), batch.column(1), 0
            while lo < batch.num_rows:
                own, size, hi = [], 0, lo
                while hi < batch.num_rows and (hi == lo or size < SLICE_CHARS):
                    own.append(texts[hi].as_py() or "")
                    size += len(own[-1])
                    hi += 1
                x = aligned_slice(own, words, table_a, table_b)
                pairs.append(np.unique((x["a"][x["in_a"]] << 32) | x["b"][x["in_b"]], return_counts=True))
                # Each text's last tokens end together, so groups fill all places one after the other.
                held.append(({"place": x["place"].astype(np.int32), "n_words": x["n_words"], "n_links": x["n_links"],
                              "group_a": np.diff(x["in_a"], prepend=-1).astype(np.int32),
                              "group_b": np.diff(x["in_b"], prepend=-1).astype(np.int32)}, row.slice(lo, hi - lo)))
                lo, chars = hi, chars + size
                if chars >= BLOCK_CHARS:
                    yield from whole_block()
                    block, chars, held, pairs = block + 1, 0, [], []
                    if len(words.number) > WORDS_KNOWN:
                        words = Words(*encoders)
                    release()
                elif len(pairs) >= 16:
                    pairs = [_summed(pairs)]
        if held:
            yield from whole_block()
        pairs, held, batch, row, texts, words = [], [], None, None, None, None
        release()

    return rows.mapInArrow(run, schema)


def _summed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts per distinct pair, ascending."""
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pair, place = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
    total = np.zeros(len(pair), np.int64)
    np.add.at(total, place, np.concatenate([n for _, n in pairs]))
    return pair, total


def _pairs(question: list[bytes]) -> np.ndarray:
    return (unpack(question[0]).astype(np.int64) << 32) | unpack(question[1]).astype(np.int64)


def _corpus_counts():
    """Answers of a shard: every pair's count over all blocks, and whether it is the highest of its B id."""
    def reply(questions: list[list[bytes]]) -> list[list[bytes]]:
        pair, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(0, len(questions), 64):
            pair, total = _summed([(pair, total), *((_pairs(q), unpack(q[2]).astype(np.int64))
                                                    for q in questions[k:k + 64])])
        b, place = np.unique(pair & 0xFFFFFFFF, return_inverse=True)
        highest = np.zeros(len(b), np.int64)
        np.maximum.at(highest, place, total)
        best = total == highest[place]
        squeeze = zstandard.ZstdCompressor(level=1).compress
        answers = []
        for a_ids, b_ids, _ in questions:
            at = np.searchsorted(pair, _pairs([a_ids, b_ids]))
            answers.append([a_ids, b_ids, squeeze(total[at].tobytes()), squeeze(best[at].tobytes())])
        return answers

    return reply


def _lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def _within(places: np.ndarray, n_links: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places in the slice, counted from each text's start."""
    return places - np.repeat(np.cumsum(sizes) - sizes, n_links)


def _with_counts(answers: list[list[bytes]], carried: list[tuple]) -> list[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    pair = np.concatenate([np.zeros(0, np.int64), *(_pairs(x) for x in answers)])
    total = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(expand(x[2]), np.int64) for x in answers)])
    best = np.concatenate([np.zeros(0, bool), *(np.frombuffer(expand(x[3]), bool) for x in answers)])
    order = np.argsort(pair)
    pair, total, best = pair[order], total[order], best[order]
    out, (size_a, flat_a, size_b, flat_b) = [], (unpack(x).astype(np.int64) for x in carried[0][0])
    for data, row in carried[1:]:
        place, n_words, n_links, group_a, group_b = (unpack(x).astype(np.int64) for x in data)
        a, n_a = spelled(place, n_words, flat_a, np.cumsum(size_a) - size_a, size_a)
        b, n_b = spelled(place, n_words, flat_b, np.cumsum(size_b) - size_b, size_b)
        cut_a, cut_b = np.cumsum(group_a), np.cumsum(group_b)
        at = np.searchsorted(pair, (a[cut_a - 1] << 32) | b[cut_b - 1])
        out.append(pa.RecordBatch.from_arrays(
            [row, _lists(a, n_a, pa.int32()), _lists(b, n_b, pa.int32()),
             _lists(_within(cut_a, n_links, n_a), n_links, pa.int32()),
             _lists(_within(cut_b, n_links, n_b), n_links, pa.int32()),
             _lists(total[at], n_links, pa.int64()), _lists(best[at], n_links, pa.bool_())],
            names=["row", *(f.name for f in FIELDS)]))
    return out


def align(docs: DataFrame, side_a, side_b, keep: Sequence[str] | None = None, text_col: str = "text",
          shards: int | None = None) -> DataFrame:
    """`row` (struct of the `keep` columns) and FIELDS of every whole text.

    `a_ids`, `b_ids`: the tokens of both sides (`ByteLevel`, `Pieces`). `a_cut`, `b_cut`: how many tokens of each side end
    at or before each byte offset where tokens of both end; these cut the text into groups. The last tokens of a group are a link.
    `link_count`: how many links of the whole table hold the same pair of ids; `link_best`: whether no pair with the
    same B id has more.

    All lanes of a slice of texts advance together (`lockstep`). A block's pairs go, once each, to the shard of their B
    id, where all pairs of a B id meet; totals return to the block. `shards` grows with the bytes of text.

    Null and empty texts, and texts whose tokens on either side do not join to space + text, have empty lists. Repeated
    rows are aligned alike and all count. An empty table gives an empty result. Kept columns cannot clash with the results.
    """
    spark = docs.sparkSession
    shards = shards or shards_for(docs, text_col)
    rows = bounded_batches(docs).select(kept_row(docs, keep), F.col(text_col).alias("text"))
    sent = Shared(spark, (side_a, side_b, side_a.table(), side_b.table()))
    parts = answer(_encode_and_link(rows, sent, shards), _corpus_counts)
    return together(parts, T.StructType([rows.schema["row"], *FIELDS]), _with_counts)


_DIGITS: dict[str, tuple] = {}


def group_text(a_ids: np.ndarray, b_ids: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: the decimal ids of each group, A's then B's."""
    if not len(a_cut):
        return b""
    top = int(max(a_ids.max(), b_ids.max()))
    if "all" not in _DIGITS or len(_DIGITS["all"][1]) <= top:
        _DIGITS["all"] = _table([b"%d," % k for k in range(top + 1)])
    flat, start, length = _DIGITS["all"]
    size_a, size_b = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
    place_a = np.arange(len(a_ids)) + np.repeat(b_cut - size_b, size_a)
    place_b = np.arange(len(b_ids)) + np.repeat(a_cut, size_b)
    ids = np.empty(len(a_ids) + len(b_ids), np.int64)
    ids[place_a], ids[place_b] = a_ids, b_ids
    out = gather(flat, start[ids], length[ids])
    ends = np.cumsum(length[ids]) - 1
    out[ends[place_a[a_cut - 1]]] = ord("|")
    out[ends[place_b[b_cut - 1]]] = ord(";")
    return out[:-1].tobytes()


def group_digests(aligned: DataFrame, keep: Sequence[str]) -> DataFrame:
    """`row` (struct of the `keep` columns) and `groups_sha256` of the groups' text; '' where there are no tokens."""
    inputs = [F.col(c) for c in ("a_ids", "b_ids", "a_cut", "b_cut")]

    def make():
        def digest(batch: pa.RecordBatch) -> list:
            lists = [batch.column(k) for k in range(1, 5)]
            flat = [x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
            at = [x.offsets.to_numpy() for x in lists]
            out = []
            for k in range(batch.num_rows):
                own = [values[o[k]:o[k + 1]] for values, o in zip(flat, at, strict=True)]
                out.append(hashlib.sha256(group_text(*own)).hexdigest() if len(own[0]) else "")
            return [pa.array(out, pa.string())]

        return digest

    return extend(aligned, keep, inputs, [T.StructField("groups_sha256", T.StringType())], make)
