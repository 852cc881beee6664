"""The pipeline, stage by stage, against plain Python and SQL."""

import base64
import hashlib
import random
from collections import Counter

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import tiktoken
from nasty import frame, rows
from pyspark.sql import functions as F
from test_span_and_group_operators import brute_components, plain_secrets

from millrace.llm import langid, mixing, secrets
from millrace.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def draw(doc_id):
    digest = hashlib.md5(f"5:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(digest[:15], 16) / float(16**15)


def check(spark, docs, folder, tmp_path, may_go=0):
    stages = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{k}")
        stage(spark, docs, folder).write.parquet(path)
        stages.append(docs)
        docs = spark.read.parquet(path)
    given, named, single, masked, mixed = ([tuple(r[c] for c in COLUMNS) for r in s.select(*COLUMNS).collect()]
                                           for s in stages)
    tokens = docs.collect()
    assert all(s.columns == stages[0].columns for s in stages)
    key = lambda r: tuple((v is None, v) for v in r)
    # Language: letterless texts go, short ones with a letter stay, of the others only those in no language go.
    lost = Counter(given) - Counter(named)
    assert not Counter(named) - Counter(given) and all(any(c.isalpha() for c in r[1] or "") for r in named)
    strange = [r for r in lost if any(c.isalpha() for c in r[1] or "")]
    assert all(len(r[1].encode()) >= langid.LEAST_BYTES for r in strange) and len(strange) <= may_go
    # Near copies: one of each group, the smallest id; every kept row is an old row.
    found = brute_components([(r[0], r[1]) for r in named])
    groups = {(low if low is not None else r[1]) for r, (_, low) in zip(named, found, strict=True)}
    assert len(single) == len(groups) and set(single) <= set(named)
    assert {r[0] for r in single if r[0] is not None} == {g for g in groups if isinstance(g, int)}
    # Secrets: nothing else changes.
    before = {(r[0], r[2], r[3]): r[1] for r in single}
    changed = 0
    for r in masked:
        old = before[r[0], r[2], r[3]]
        plain = secrets.masked(old, plain_secrets(old))
        assert not plain_secrets(r[1]) and r[4] == len(r[1])
        changed += r[1] != plain
    assert len(masked) == len(single) and changed <= 0.02 * len(masked)
    # Mix: each document as often as SQL on the same rows says.
    con = duckdb.connect()
    con.register("given", stages[3].select(*COLUMNS).toArrow())
    con.execute("CREATE VIEW documents AS SELECT * FROM given")
    times = {r[0]: int(r[4] / r[1] + draw(r[0])) if r[1] else 0 for r in con.execute(mixing.MIX_SQL).fetchall()}
    assert sorted(mixed, key=key) == sorted((r for r in masked for _ in range(times[r[0]])), key=key)
    # Tokens: those of the library.
    lines = open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(((r[0], encoding.encode_ordinary(r[1])) for r in mixed), key=lambda x: (x[0] is None, x))
    assert sorted(((r.doc_id, list(r.ids)) for r in tokens), key=lambda x: (x[0] is None, x)) == want
    assert all(r.n_tokens == len(r.ids) for r in tokens)


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    check(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder, tmp_path)


def test_pipeline_on_awkward_rows(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    frame(spark, [r for r in rows() if r[0] is not None]).repartition(2).write.parquet(path)
    check(spark, spark.read.parquet(path), str(tmp_path), tmp_path, may_go=4)


def test_language_stage_rejects_what_is_in_no_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rng = random.Random(3)
    strange = ["".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω  ") for _ in range(600)),
               base64.b64encode(rng.randbytes(900)).decode(),
               "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900))]
    short = ["Ω", "Ωmega " * 5, "q"]
    planted = spark.createDataFrame([(10**9 + k, t, None, "s1", len(t)) for k, t in enumerate(strange + short)], docs.schema)
    stays = corpus_pipeline.identify_language(spark, docs.unionByName(planted), sf_dir)
    ids = {r.doc_id for r in stays.select("doc_id").collect()}
    assert {i - 10**9 for i in ids if i >= 10**9} == {3, 4, 5}
    assert len({r.doc_id for r in docs.select("doc_id").collect()} - ids) <= 5  # of 1000


def test_stages_keep_columns_named_like_helpers(spark, tmp_path):
    names = ["__key", "__id", "key", "group", "kept_id", "kept_key", "id", "n", "bits_per_byte"]
    data = frame(spark, [r for r in rows() if r[0] is not None])
    for name in names:
        data = data.withColumn(name, F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")))
    path = str(tmp_path / "documents.parquet")
    data.write.parquet(path)
    docs = spark.read.parquet(path)
    for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_copies):
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns
        for r in found.collect():
            assert all(r[name] == f"{name}-{r.doc_id}" for name in names)


def test_run_and_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert len(corpus_pipeline.STAGES) == 5


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    with pytest.raises(KeyError):
        QUERIES["op14"]
