"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .arrow import bounded_batches, extend, kept_row, release
from .graph import components

SHINGLE = 5
PERCENT = 75  # 100 * intersection >= PERCENT * union makes a link
HALVES = 16  # half keys per collection; HALVES ** 2 tables
WIDTH = 2  # minhashes in a half key
HASHES = 2 * HALVES * WIDTH
# Equal minhashes of HASHES a pair needs before its full sets are compared (exhaustive step). At similarity 0.75 the mean is
# 48 and the deviation 3.5, so a link falls below with a chance of 1 in 10^5.
AGREE = HASHES // 2
BLOCK = 256  # documents a side of a comparison block
BUCKETS = 1 << 20  # classes of keys in a broadcast filter
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, (2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ODD = [np.uint64(2 * int(x) + 1) for x in np.random.default_rng(21).integers(1, 2**62, SHINGLE + 3)]
WORDS_KNOWN = 500_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORDS_KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; empty without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array(list(map(hashes.__getitem__, words)), np.uint64)
    if len(w) < SHINGLE:
        out = np.full(1, len(w), np.uint64)
        for x in w:
            out = (out ^ x) * ODD[SHINGLE]
    else:
        n = len(w) - SHINGLE + 1
        out = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            out += w[k:k + n] * ODD[k]
    out ^= out >> np.uint64(31)
    out *= ODD[SHINGLE + 1]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def minhashes(own: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(own), 4096):
        x = own[None, lo:lo + 4096] * MULTIPLIERS[0][:, None]
        x ^= x >> np.uint64(32)
        x *= MULTIPLIERS[1][:, None]
        np.minimum(least, x.min(1), out=least)
    return least


SKETCH = [T.StructField("node", T.LongType()), T.StructField("n_shingles", T.LongType()),
          T.StructField("a", T.ArrayType(T.LongType())), T.StructField("b", T.ArrayType(T.LongType())),
          T.StructField("signature", T.BinaryType())]


def sketch(docs: DataFrame, keep: Sequence[str] | None = None, text_col: str = "text") -> DataFrame:
    """`row`, `text_key` and per text: `node` (64-bit hash of its shingle set), n_shingles, half keys a and b, signature.

    HASHES minhashes in two collections give HALVES half keys each; the pairs of half keys make HALVES ** 2 tables.
    """
    def make():
        import xxhash

        hashes = WordHashes()

        def run(batch: pa.RecordBatch) -> list:
            node, n, a, b, signature = [], [], [], [], []
            for text in batch.column(2):
                own = shingles(text.as_py(), hashes)
                n.append(len(own))
                if not len(own):
                    node.append(None), a.append(None), b.append(None), signature.append(None)
                    continue
                least = minhashes(own)
                half = least.reshape(2, HALVES, WIDTH)
                keys = half[:, :, 0] * ODD[0] ^ (half[:, :, 1] * ODD[1])
                node.append(np.int64(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)))
                a.append(keys[0].view(np.int64))
                b.append(keys[1].view(np.int64))
                signature.append((least >> np.uint64(20)).astype(np.uint16).tobytes())
            longs = pa.list_(pa.int64())
            return [batch.column(1), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(a, longs),
                    pa.array(b, longs), pa.array(signature, pa.binary())]

        return run

    return extend(docs, keep, [F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")],
                  [T.StructField("text_key", T.LongType()), *SKETCH], make)


def _similar(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sorted sets are linked to the sorted set x."""
    size = np.array([len(o) for o in others], np.int64)
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    common = np.add.reduceat((x[at] == flat).astype(np.int64), np.cumsum(size) - size)
    return 100 * common >= PERCENT * (len(x) + size - common)


def may_hold(keyed: DataFrame, keys: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """The rows whose long `key` may be among `keys`, or with `inside` false, those whose key surely is not.

    Keys are compared by their class among BUCKETS, so the broadcast table has at most that many rows. It spares a shuffle of
    whole texts where few keys are asked for; an exact join has to follow.
    """
    classes = keys.select(F.pmod(key, F.lit(BUCKETS)).alias("__class")).distinct()
    return keyed.join(F.broadcast(classes), F.pmod(key, F.lit(BUCKETS)) == F.col("__class"),
                      "left_semi" if inside else "left_anti")


def _full_sets(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(node, shingles as binary) of the texts whose `text_key` is wanted."""
    text = F.col(f"`{text_col}`")
    keyed = docs.select(F.xxhash64(text).alias("text_key"), text.alias("text"))
    wanted = cut_lineage(wanted)
    keyed = may_hold(keyed, wanted, "text_key")
    texts = bounded_batches(keyed.join(wanted, "text_key").dropDuplicates(["text_key"]).select("node", "text"))

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingles(t.as_py(), hashes).tobytes() for t in batch.column(1)], pa.binary())],
                names=["node", "shingles"])
        hashes.clear()
        release()

    return texts.mapInArrow(run, "node long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"))

    def run(batches):
        for batch in batches:
            a, b, x, y = batch.columns
            ok = [bool(_similar(np.frombuffer(p.as_buffer(), np.uint64), [np.frombuffer(q.as_buffer(), np.uint64)])[0])
                  for p, q in zip(x, y, strict=True)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return bounded_batches(both.select("a", "b", "x", "y")).mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """Members of half-key groups dealt to blocks: `side` 0 meets `side` 1 in each (key, xc, yc).

    Side 0 holds the members outside the group's largest component, side 1 all. Groups are cut into chunks of about
    BLOCK, so no block is larger, and only members outside the largest component are compared with everyone.
    """
    sized = members.groupBy("key").agg(
        F.max(F.struct("size", "component"))["component"].alias("main"), F.count(F.lit(1)).alias("n"))
    outside = (members.join(sized.select("key", "main"), "key").filter("component != main").groupBy("key")
               .agg(F.count(F.lit(1)).alias("n_outside")))
    plan = sized.join(outside, "key").select(
        "key", "main", F.ceil(F.col("n_outside") / BLOCK).cast("int").alias("px"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("py"))
    known = members.join(plan, "key")
    known = known.withColumn("outer", F.col("component") != F.col("main"))
    own = F.xxhash64("key", "node")
    x = known.filter("outer").withColumn("side", F.lit(0)).withColumn(
        "xc", F.pmod(own, F.col("px")).cast("int")).withColumn(
        "yc", F.explode(F.sequence(F.lit(0), F.col("py") - 1)))
    y = known.withColumn("side", F.lit(1)).withColumn("yc", F.pmod(own, F.col("py")).cast("int")).withColumn(
        "xc", F.explode(F.sequence(F.lit(0), F.col("px") - 1)))
    columns = ["key", "xc", "yc", "side", "outer", "place", "node", "component", "n_shingles"]
    return x.select(*columns).unionByName(y.select(*columns))


def _candidates(block: pa.Table):
    """(x, indices of its partners) for every member of side 0 that has some, with the two sides' column lists.

    All members share a half key of the first collection; partners share one of the second as well, that is a table. They
    are of another component, within the size ratio, agree on AGREE minhashes and share no earlier half key of the first
    collection, so that a pair is compared in one group only.
    """
    side = block.column("side").to_numpy()
    node, component, n = (block.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
    place = int(block.column("place")[0].as_py())
    marks = np.frombuffer(b"".join(block.column("signature").to_pylist()), np.uint16).reshape(len(side), HASHES)
    outer = block.column("outer").to_numpy()
    ys = np.flatnonzero(side == 1)
    for x in np.flatnonzero(side == 0):
        ok = (component[ys] != component[x]) & (100 * np.minimum(n[ys], n[x]) >= PERCENT * np.maximum(n[ys], n[x]))
        near = ys[ok & ~(outer[ys] & (node[ys] > node[x]))]  # two outer members meet twice
        if not len(near):
            continue
        same = marks[near] == marks[x]
        near, same = near[same.sum(1) >= AGREE], same[same.sum(1) >= AGREE]
        if not len(near):
            continue
        halves = same.reshape(len(near), 2, HALVES, WIDTH).all(3)
        near = near[halves[:, 1].any(1) & ~halves[:, 0, :place].any(1)]
        if len(near):
            yield x, near


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """The values of `key` that hold more than one component."""
    return rows.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select(key)


def _tables(classes: DataFrame, component: DataFrame) -> DataFrame:
    """(key, place, node, n_shingles, component, size): the classes that may share a table with one of another component.

    Two classes of a table share a half key of each collection, so half keys that hold one component only drop out, and with
    them the classes that have none left in either collection. The tables of a class are the pairs of its half keys; its rows are
    grouped by the first of the pair alone (`key`), and `_candidates` asks for the second: the same pairs meet from a
    row for each half key instead of one for each table.
    """
    known = cut_lineage(classes.join(component, "node", "left").select(
        "node", "n_shingles", F.coalesce("component", "node").alias("component"),
        F.coalesce("size", F.lit(1)).alias("size"), "a", "b"))

    def left(name: str) -> DataFrame:
        halves = known.select("node", "component", F.posexplode(name).alias("place", "value")).select(
            F.xxhash64("place", "value").alias("key"), "place", "node", "component").repartition("key")
        return halves.join(_mixed(halves, "key"), "key").select("key", "place", "node")

    second = left("b").select("node").distinct()
    kept = known.drop("a", "b").join(second, "node", "left_semi")
    return left("a").join(kept, "node")


def _remaining_links(docs: DataFrame, members: DataFrame, classes: DataFrame, text_col: str) -> DataFrame:
    """All links between documents of different components that share a table."""
    marks = classes.select("node", "signature")
    # Dealt once: a block's membership has to be the same in both passes.
    dealt = cut_lineage(_blocks(members))
    keys = ["key", "xc", "yc"]

    def partners(block: pa.Table) -> pa.Table:
        used = np.zeros(block.num_rows, bool)
        for x, near in _candidates(block):
            used[x] = True
            used[near] = True
        return block.drop_columns(["signature"]).filter(pa.array(used))

    def links(block: pa.Table) -> pa.Table:
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in block.column("shingles")]
        node = block.column("node").to_numpy()
        a, b = [], []
        for x, near in _candidates(block):
            found = near[_similar(sets[x], [sets[y] for y in near])]
            a += [node[x]] * len(found)
            b += node[found].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    useful = dealt.join(marks, "node").select(*dealt.columns, "signature").groupBy(*keys).applyInArrow(
        partners, dealt.schema)
    useful = cut_lineage(useful)
    sets = _full_sets(docs, classes.join(useful.select("node").distinct(), "node").select("text_key", "node"), text_col)
    full = useful.join(marks, "node").join(sets, "node").select(*dealt.columns, "signature", "shingles")
    return full.groupBy(*keys).applyInArrow(links, "a long, b long")


def _stars(classes: DataFrame) -> DataFrame:
    """(a, b): in the tables of equal places, the class with the most company leads and is paired with the others."""
    rows = cut_lineage(classes.select("node", "n_shingles", F.posexplode(F.arrays_zip("a", "b")).alias("place", "halves"))
                       .select(F.xxhash64("place", "halves").alias("key"), "node", "n_shingles"))
    company = rows.groupBy("key").agg(F.count(F.lit(1)).alias("company")).filter("company > 1")
    shared = cut_lineage(rows.join(company, "key"))
    weight = shared.groupBy("node").agg(F.sum(F.floor(16 * F.log2("company"))).alias("weight"))
    shared = shared.join(weight, "node")
    lead = F.max(F.struct("weight", "node", "n_shingles")).alias("lead")
    leaders = shared.groupBy("key").agg(lead).select("key", F.col("lead.node").alias("a"), F.col("lead.n_shingles").alias("na"))
    return (shared.select("key", F.col("node").alias("b"), F.col("n_shingles").alias("nb")).join(leaders, "key")
            .filter((F.col("a") != F.col("b")) & (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")))
            .select("a", "b").distinct())


def near_duplicates(docs: DataFrame, keep: Sequence[str] | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """`row` (struct of the `keep` columns), n_shingles, component, component_id, kept.

    Words are lower-cased (A-Z); a document is its set of distinct five-word shingles, or its whole sequence below five
    words. Equal sets form a class. Two collections of HALVES half keys (pairs of minhashes) give a class HALVES ** 2
    table keys from only 4 * HALVES minhashes. First the HALVES tables of equal places: in each the class with the most
    company leads, the others are compared with it on full sets, and the confirmed links are joined to components, which
    unites large groups of copies at the cost of a star. Then all tables: half keys that hold one component only drop
    out, and the classes of different components that share a half key of each collection, that is a table, are
    compared in blocks, by signature and then on full sets. So no link between candidates rests on the choice of
    leaders. A link of similarity 0.75 is missed with a chance below 2 in 10^5, more similar ones with less. Two sets are
    taken for equal on a 64-bit hash.

    `component` names a row's group by a node; null without shingles. component_id is the smallest id reachable over links,
    `kept` marks the rows that carry it. Null, empty and wordless texts have no shingles, are linked with nothing and are kept.
    Null ids are above all others: such a row is kept only in a group without another id. Repeated rows of the kept id are
    all marked. An empty table gives an empty result. Kept columns may have any names.
    """
    columns = list(docs.columns if keep is None else keep)
    own = docs.select(kept_row(docs, columns), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    every = cut_lineage(sketch(own, ["row", "id"], "text").select(
        "row.row", "row.id", "text_key", *(f.name for f in SKETCH)))
    classes = cut_lineage(every.filter("node is not null").groupBy("node").agg(
        F.min("id").alias("least_id"), F.min("text_key").alias("text_key"),
        *(F.first(c).alias(c) for c in ("n_shingles", "a", "b", "signature"))))
    pairs = cut_lineage(_stars(classes))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _full_sets(docs, classes.join(nodes, "node").select("text_key", "node"), text_col)
    first = cut_lineage(_confirmed(pairs, sets))
    named = components(first)
    size = named.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = cut_lineage(_tables(classes, named.join(size, "component")))
    links = first.unionByName(_remaining_links(docs, members, classes, text_col))
    groups = cut_lineage(components(links).withColumnRenamed("component", "group"))
    lowest = classes.join(groups, "node").groupBy("group").agg(F.min("least_id").alias("component_id"))
    reached = groups.join(lowest, "group").select("node", "group", F.col("component_id").alias("linked"))
    own = classes.select("node", "least_id").join(reached, "node", "left").select(
        "node", F.coalesce("group", "node").alias("component"), F.coalesce("linked", "least_id").alias("component_id"))
    out = every.select("row", "id", "n_shingles", "node").join(own, "node", "left")
    least = F.coalesce("component_id", "id")
    return out.select("row", "n_shingles", "component", least.alias("component_id"),
                      F.coalesce(F.col("id") == least, least.isNull()).alias("kept"))


# The same in SQL, for DuckDB: exact links by shared shingles, components by reachability.
NEARDUP_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id
                    GROUP BY ALL) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * k >= 75 * (na.n + nb.n - k)),
r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.low, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(c.low, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
