"""Byte-level BPE: every distinct pre-token is encoded once, ids go back to their positions; decoding joins the token bytes."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Shared
from .arrow import bounded_batches, extend, kept_row, release
from .blocks import shards_for

# Characters of text whose pre-tokens share one dictionary: a block. A longer text is a block of its own.
BLOCK_CHARS = 16_000_000
# Largest vocabulary file that may be broadcast, in bytes.
VOCABULARY_BYTES = 64_000_000

PARTS = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("block", T.LongType()),
    T.StructField("seq", T.IntegerType()),  # -1: words of the block; else the place of a batch of texts in it
    T.StructField("places", T.BinaryType()),
    T.StructField("sizes", T.BinaryType()),
    T.StructField("data", T.BinaryType()),
])


@dataclass
class Vocabulary:
    """Ranks of byte strings and the pattern that cuts a text into pre-tokens."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """A rank file: base64 bytes and rank per line. The file is the size bound of everything broadcast."""
        with open(path, "rb") as lines:
            content = lines.read(VOCABULARY_BYTES + 1)
        if len(content) > VOCABULARY_BYTES:
            raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
        pairs = (line.split() for line in content.splitlines() if line)
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("bytes", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The token-byte table: all bytes in a row, and start and length by id (length -1: no such id)."""
        top = max(self.ranks.values(), default=-1) + 1
        start, length = np.zeros(top, np.int64), np.full(top, -1, np.int64)
        flat, at = bytearray(), 0
        for token, rank in self.ranks.items():
            start[rank], length[rank] = at, len(token)
            flat += token
            at += len(token)
        return np.frombuffer(bytes(flat), np.uint8), start, length


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces flat[start : start + length], one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]


def pack(values: np.ndarray) -> bytes:
    """Non-negative numbers, small ones cheapest: one byte below 160, else the high bits and 13 low ones, or all 32."""
    values = np.asarray(values, np.int64)
    rest = values - 160
    head = np.where(rest < 0, values, 160 + np.minimum(np.maximum(rest, 0) >> 13, 95)).astype(np.uint8)
    low = (rest[(head >= 160) & (head < 255)] & 0x1FFF).astype(np.uint16)
    whole = rest[head == 255].astype(np.uint32)
    parts = [head.tobytes(), (low >> 8).astype(np.uint8).tobytes(), (low & 255).astype(np.uint8).tobytes(),
             whole.tobytes()]
    return len(head).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
    head = flat[:n].astype(np.int64)
    mid, whole = (head >= 160) & (head < 255), head == 255
    k = np.count_nonzero(mid)
    low = (flat[n:n + k].astype(np.int64) << 8) | flat[n + k:n + 2 * k]
    out = head
    out[mid] = 160 + ((head[mid] - 160) << 13) + low
    out[whole] = 160 + flat[n + 2 * k:].copy().view(np.uint32).astype(np.int64)
    return out.astype(np.int32)


def _pre_tokens(rows: DataFrame, pattern: str, shards: int) -> DataFrame:
    """PARTS and `rows`: per batch of texts the word numbers of all positions, per block and shard its distinct words.

    Word numbers are ranks by frequency within a block, so that positions take few bits. A batch record carries the
    positions; `places` are the word numbers one after the other, `sizes` the number per text.
    """
    row_type = rows.schema["row"].dataType
    names = [*PARTS.names, "rows"]

    def run(batches):
        import regex

        cut = regex.compile(pattern).findall
        part = TaskContext.get().partitionId()

        def record(shard, block, seq, places, sizes, data, row):
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([seq], pa.int32()),
                 pa.array([places], pa.binary()), pa.array([sizes], pa.binary()), pa.array([data], pa.binary()),
                 pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row)], names=names)

        number: dict[str, int] = {}
        held: list[tuple] = []
        block, chars = part << 32, 0

        def whole_block():
            uses = sum(np.bincount(places, minlength=len(number)) for places, _, _ in held)
            order = np.argsort(-uses, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            for seq, (places, sizes, row) in enumerate(held):
                yield record(block % shards, block, seq, pack(rank[places]), pack(sizes), b"", row)
            found = list(number)
            raw = [found[k].encode() for k in order.tolist()]
            shard_of = np.array([zlib.crc32(w) % shards for w in raw], np.int64)
            for places in np.split(np.argsort(shard_of, kind="stable"), np.cumsum(np.bincount(shard_of))[:-1]):
                if not len(places):
                    continue
                words = [raw[p] for p in places.tolist()]
                data = zstandard.ZstdCompressor(level=3).compress(b"".join(words))
                yield record(int(shard_of[places[0]]), block, -1, pack(np.diff(places, prepend=0)),
                             pack([len(w) for w in words]), data, held[0][2].slice(0, 0))

        batch = row = texts = None
        for batch in batches:
            row, texts = batch.column(0), batch.column(1)
            lo = 0
            while lo < batch.num_rows:
                sizes, places = [], []
                hi = lo
                while hi < batch.num_rows and (hi == lo or chars < BLOCK_CHARS):
                    text = texts[hi].as_py() or ""
                    found = cut(text)
                    for word in found:
                        places.append(number.setdefault(word, len(number)))
                    sizes.append(len(found))
                    chars += len(text)
                    hi += 1
                held.append((np.array(places, np.int32), np.array(sizes, np.int32), row.slice(lo, hi - lo)))
                lo = hi
                if chars >= BLOCK_CHARS:
                    yield from whole_block()
                    number, held, block, chars = {}, [], block + 1, 0
                    release()
        if held:
            yield from whole_block()
        number = held = batch = row = texts = None
        release()

    return rows.mapInArrow(run, T.StructType([*PARTS, T.StructField("rows", T.ArrayType(row_type))]))


def _encode_words(parts: DataFrame, vocabulary: Shared) -> DataFrame:
    """Word records become id records (`sizes`: ids per word, `data`: the ids); batch records pass unchanged."""
    own: dict = {}

    def run(group: pa.Table) -> pa.Table:
        release()
        if "encode" not in own:
            own["encode"] = vocabulary.value.encoding().encode_ordinary
        ids: dict[bytes, list[int]] = {}
        seqs, sizes, data = (group.column(c).to_pylist() for c in ("seq", "sizes", "data"))
        for k, seq in enumerate(seqs):
            if seq >= 0:
                continue
            raw, out, at = zstandard.ZstdDecompressor().decompress(data[k]), [], 0
            for n in unpack(sizes[k]).tolist():
                word = raw[at:at + n]
                at += n
                if word not in ids:
                    ids[word] = own["encode"](word.decode())
                out.append(ids[word])
            sizes[k] = pack(np.array([len(x) for x in out], np.int32))
            data[k] = pack(np.array([i for x in out for i in x], np.int32))
        group = group.set_column(group.schema.get_field_index("sizes"), "sizes", pa.array(sizes, pa.binary()))
        return group.set_column(group.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))

    return parts.groupBy("shard").applyInArrow(run, parts.schema)


def _reassemble(parts: DataFrame) -> DataFrame:
    """Per block: ids by word number, put back in the order of positions. Returns `row`, `ids`."""
    row_type = parts.schema["rows"].dataType.elementType

    def run(group: pa.Table) -> pa.Table:
        release()
        seqs = group.column("seq").to_pylist()
        places, sizes, data = (group.column(c) for c in ("places", "sizes", "data"))
        flat, word, length = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, seq in enumerate(seqs):
            if seq < 0:
                word.append(np.cumsum(unpack(places[k].as_py())))
                length.append(unpack(sizes[k].as_py()).astype(np.int64))
                flat.append(unpack(data[k].as_py()))
        flat, word, length = np.concatenate(flat), np.concatenate(word), np.concatenate(length)
        start_of, length_of = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        start_of[word] = np.cumsum(length) - length
        length_of[word] = length
        rows, ids = [], []
        for k, seq in enumerate(seqs):
            if seq < 0:
                continue
            at, per_text = unpack(places[k].as_py()), unpack(sizes[k].as_py())
            n_ids = np.concatenate([[0], np.cumsum(length_of[at])])
            ends = n_ids[np.concatenate([[0], np.cumsum(per_text)])]
            rows.append(group.column("rows")[k].values)
            ids.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                pa.array(gather(flat, start_of[at], length_of[at]), pa.int32())))
        kind = group.schema.field("rows").type.value_type
        return pa.Table.from_arrays([pa.chunked_array(rows, kind), pa.chunked_array(ids, pa.list_(pa.int32()))],
                                    names=["row", "ids"])

    schema = T.StructType([T.StructField("row", row_type), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return parts.groupBy("block").applyInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, keep: Sequence[str] | None = None, text_col: str = "text",
           shards: int | None = None) -> DataFrame:
    """`row` (struct of the `keep` columns) and `ids` (array of int) of every whole text.

    Texts are cut into pre-tokens in blocks of about BLOCK_CHARS. A block's distinct words go, once each, to the shard of
    their hash; there equal words of all blocks meet and are encoded once. Their ids return to the block, which puts
    them at the words' positions. A frequent word is one entry per block, so no key is hot; both shuffles move
    compressed word lists and position lists, not one row per pre-token. `shards` grows with the bytes of text.

    Null and empty texts have no ids. Special tokens are ordinary text. Repeated rows are encoded alike. An empty table
    gives an empty result. Kept columns cannot clash with the results.
    """
    spark = docs.sparkSession
    shards = shards or shards_for(docs, text_col)
    rows = bounded_batches(docs).select(kept_row(docs, keep), F.col(text_col).alias("text"))
    return _reassemble(_encode_words(_pre_tokens(rows, vocabulary.pattern, shards), Shared(spark, vocabulary)))


def decode(encoded: DataFrame, vocabulary: Vocabulary, keep: Sequence[str] | None = None,
           ids_col: str = "ids") -> DataFrame:
    """`row` (struct of the `keep` columns) and `decoded` (binary): each id joined to the token-byte table.

    The table is as long as the vocabulary file, so it is sent to every task. An unknown id raises ValueError; null ids
    give null.
    """
    sent = Shared(encoded.sparkSession, vocabulary.token_bytes())

    def make():
        flat, start, length = sent.value

        def join(batch: pa.RecordBatch) -> list:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(length) or (length[ids] < 0).any()):
                raise ValueError("an id that the vocabulary lacks")
            per_text = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            out, at = [], 0
            for n, ok in zip(per_text.tolist(), lists.is_valid().to_pylist(), strict=True):
                own = ids[at:at + n]
                out.append(gather(flat, start[own], length[own]).tobytes() if ok else None)
                at += n
            return [pa.array(out, pa.binary())]

        return join

    return extend(encoded, keep, [F.col(ids_col).alias("ids")], [T.StructField("decoded", T.BinaryType())], make)
