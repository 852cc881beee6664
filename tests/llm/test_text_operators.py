"""Mixing, language, quality, licences, tokens and scores against plain Python or SQL."""

import base64
import collections
import hashlib
import math
import os
import string
import textwrap
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from nasty import CLASHES, PROSE, lower, rows, words
from oracle import compare, duck
from pyspark.sql import functions as F

from millrace.llm import bpe, langid, licenses, lm, mixing, quality
from millrace.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    n, _, _ = compare(spark, duck(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert n > 0


def as_view(df):
    con = duckdb.connect()
    table = df.select("doc_id", "text", "lang", "source", "n_chars").toArrow()
    con.register("given", table)
    con.execute("CREATE VIEW documents AS SELECT * FROM given")
    return con


# --- mixing -----------------------------------------------------------------------------------------------------

def test_mix_of_awkward_rows(nasty, empty):
    mixed = mixing.mix(nasty)
    got = mixed.select("row.doc_id", "size", "source_size", "target", "taken").collect()
    want = as_view(nasty).execute(mixing.MIX_SQL).fetchall()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    sizes = collections.Counter((r[0], len(words(r[1]))) for r in rows())
    assert collections.Counter((r.doc_id, r["size"]) for r in got) == sizes
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    assert set(mixed.select("row.*").columns) >= set(CLASHES)
    assert mixing.mix(empty).count() == 0


def test_targets_stop_at_three_times_a_source_and_share_the_rest(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 40), ("z", 0)],
                                    "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sources).collect()}
    # Weights a 5, b 2, c 1, z 5, null 2: a, z and null are capped, b and c share the rest 2 : 1.
    assert got["a"] == 30 and got["z"] == 0 and got[None] == 120
    assert got["b"] == pytest.approx(2 * 1400 / 3) and got["c"] == pytest.approx(1400 / 3)


def test_apportionment_is_highest_quotients(spark):
    rng = np.random.default_rng(3)
    for n, seats in ((1, 7), (3, 11), (12, 100), (40, 17)):
        votes = [int(v) for v in rng.integers(1, 1000, n) ** 2]
        frame = spark.createDataFrame([(k, v, seats, 10**9) for k, v in enumerate(votes)],
                                      "rank long, v long, seats long, most long")
        got = {r.rank: r.quota for r in mixing.apportion(frame, "v", "seats", "most", "rank").collect()}
        won = [0] * n
        for _ in range(seats):
            best = max(range(n), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))
            won[best] += 1
        assert [got[k] for k in range(n)] == won


def test_sources_come_near_their_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert len(by) == 20 and all(abs(r.t - r.target) <= 16 for r in by)
    again = mixing.mix(docs.repartition(7)).select("row.doc_id", "taken")
    assert sorted(again.collect()) == sorted(mixing.mix(docs).select("row.doc_id", "taken").collect())


# --- language ---------------------------------------------------------------------------------------------------

def ppm_bits(counts, symbols, context, symbol):
    """Bits of a byte by PPM, method C, with exclusions, straight from the definition."""
    bits, excluded = 0.0, set()
    for k in range(len(context) + 1):
        seen = {s: c for s, c in counts.get(context[k:], {}).items() if s not in excluded}
        if not seen:
            continue
        total = sum(seen.values()) + len(seen)
        if symbol in seen:
            return bits - math.log2(seen[symbol] / total)
        bits -= math.log2(len(seen) / total)
        excluded |= set(counts[context[k:]])
    return bits + math.log2(256 - len(excluded))


def test_code_lengths_are_ppm():
    train = {"en": ["the cat sat on the mat", "that hat"], "fr": ["le chat été là", "la la"]}
    lang, gram, n, counts = [], [], [], {}
    for name, texts in train.items():
        own, trees = collections.Counter(), collections.defaultdict(collections.Counter)
        for text in texts:
            raw = b"\n\n\n" + text.encode()
            for i in range(3, len(raw)):
                own[int.from_bytes(raw[i - 3:i + 1], "big")] += 1
                for k in range(4):
                    trees[raw[i - k:i]][raw[i]] += 1
        lang += [name] * len(own)
        gram += list(own)
        n += list(own.values())
        counts[name] = trees
    model = langid.build(["en", "fr"], np.array(lang, object), np.array(gram), np.array(n, float))
    texts = ["the chat", "", "zzz é", "x" * 10, "la mat\nla"]
    got = langid.code_lengths(model, pa.array(texts))
    for k, text in enumerate(texts):
        raw = b"\n\n\n" + text.encode()
        for j, name in enumerate(("en", "fr")):
            want = sum(ppm_bits(counts[name], 256, raw[i - 3:i], raw[i]) for i in range(3, len(raw)))
            assert got[k, j] == pytest.approx(want, rel=1e-5)


def test_code_lengths_keep_every_context():
    """Forty languages of many contexts: code lengths are still those of the whole tree."""
    rng = np.random.default_rng(3)
    names = [f"l{k:02d}" for k in range(40)]
    train = {name: bytes(rng.integers(97, 123, 3000).tolist()) for name in names}
    lang, gram, n, counts = [], [], [], {}
    for name, text in train.items():
        own, trees, raw = collections.Counter(), collections.defaultdict(collections.Counter), b"\n\n\n" + text
        for i in range(3, len(raw)):
            own[int.from_bytes(raw[i - 3:i + 1], "big")] += 1
            for k in range(4):
                trees[raw[i - k:i]][raw[i]] += 1
        lang += [name] * len(own)
        gram += list(own)
        n += list(own.values())
        counts[name] = trees
    model = langid.build(names, np.array(lang, object), np.array(gram), np.array(n, float))
    texts = [train["l07"][500:540].decode(), train["l33"][:30].decode() + "é"]
    got = langid.code_lengths(model, pa.array(texts))
    for k, text in enumerate(texts):
        raw = b"\n\n\n" + text.encode()
        for j, name in enumerate(names):
            want = sum(ppm_bits(counts[name], 256, raw[i - 3:i], raw[i]) for i in range(3, len(raw)))
            assert got[k, j] == pytest.approx(want, rel=1e-5)
    assert got.argmin(1).tolist() == [7, 33]


def test_pieces_of_a_long_text_score_as_one(monkeypatch):
    rng = np.random.default_rng(1)
    gram = rng.integers(0, 1 << 32, 500)
    model = langid.build(["x"], np.array(["x"] * 500, object), gram, np.ones(500))
    texts = pa.array(["abc" * 50, None, "", "q", "zebra " * 30])
    whole = langid.code_lengths(model, texts)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert np.allclose(langid.code_lengths(model, texts), whole, rtol=1e-5)


def test_languages_held_out(spark, sf_dir):
    got = QUERIES["op5_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    rows_ = got.select("held_out", (F.col("lang") == F.col("lang_pred")).alias("ok"), "score", "doc_id").collect()
    out = [r.ok for r in rows_ if r.held_out]
    assert len(rows_) == 1000 and sum(out) / len(out) > 0.98 and all(0 <= r.score <= 1 for r in rows_)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows_)


def test_language_of_awkward_rows(nasty, empty):
    model = langid.learn(nasty)
    got = langid.identify(nasty, model).select("row.*", F.col("lang_pred").alias("p"), F.col("score").alias("s")).collect()
    assert len(got) == len(rows())
    for r in got:
        assert (r.p == "und") == (not any(c.isalpha() for c in r.text or "")), r.text
    assert langid.learn(empty) is None
    assert {r.lang_pred for r in langid.identify(nasty, None).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


# --- quality ----------------------------------------------------------------------------------------------------

def base_counts(text):
    text = text or ""
    w = words(text)
    where = collections.defaultdict(list)
    for k in range(len(w) - 7):
        where[tuple(w[k:k + 8])].append(k)
    covered = {j for at in where.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts(spark, nasty, empty, sf_dir):
    def check(docs, judged):
        got = judged.select("row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                            "n_repeat_words", "base_failed", "kept").collect()
        assert len(got) == docs.count()
        for r in got:
            want = base_counts(r.text)
            assert tuple(r)[2:7] == want, r.doc_id
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
            assert not (r.kept and r.base_failed)

    check(nasty, quality.quality(nasty))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(docs, quality.quality(docs))
    assert quality.quality(empty).count() == 0


def test_common_words_that_share_a_slot(spark):
    # More common words than slots: many share one, and those that lost it are sought in the whole list.
    common = [f"w{k}" for k in range(300)]
    words = ["W7", "w299", "other", "w0", "w0", "W150", "w300"]
    df = spark.createDataFrame([(words, common), (words, []), ([], common)], "words array<string>, common array<string>")
    slots = quality.common_slots(F.col("common"))
    rows = df.withColumn("slots", slots).select(
        "slots", quality.common_places(F.col("words"), F.col("common"), F.col("slots")).alias("p")).collect()
    places = [common.index(w.lower()) + 1 for w in words if w.lower() in common]
    assert len(rows[0].slots) == quality.SLOTS and max(rows[0].slots) == 300 and set(rows[1].slots) == {0}
    assert [r.p for r in rows] == ["".join(chr((64 + k) % 256) for k in places), "", ""]


def test_char_classes(spark, nasty):
    df = nasty.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("rare", quality.rare_chars(F.col("text")))
    rows = df.select("text", *quality.char_classes(F.col("text"), F.col("rare"))).collect()
    kinds = ["\x20\t\n\x0b\x0c\r", string.ascii_uppercase, string.digits, ".,;:!?'\"()-", "#*$%&|<>"]
    for r in rows:
        assert list(r)[1:] == [sum(c in kind for c in r.text) for kind in kinds] + [sum(c > "\x7f" for c in r.text)]


def test_divergence_and_verdict(spark):
    prose = [(k, PROSE * 6, "en") for k in range(5)]
    junk = [(10, "### $$$ &&& %%% " * 60, "en"), (11, "gulls " * 400, "en"), (12, PROSE * 6, None)]
    docs = spark.createDataFrame(prose + junk, "doc_id long, text string, lang string")
    refs = quality.references(docs.filter("doc_id < 10 or doc_id = 12"))
    got = {r.row.doc_id: r for r in quality.judge(docs, refs).collect()}
    # Repeats fail the base rule; look at the divergences themselves.
    assert got[0].class_divergence == pytest.approx(0, abs=1e-9) and got[0].word_divergence == pytest.approx(0, abs=1e-9)
    assert got[10].class_divergence > 0.5 and got[11].word_divergence > 0.25
    assert got[12].class_divergence == pytest.approx(0, abs=1e-9)
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    want = sum(x * math.log2(2 * x / (x + y)) / 2 for x, y in zip(p, q) if x) + sum(
        y * math.log2(2 * y / (x + y)) / 2 for x, y in zip(p, q) if y)
    one = spark.range(1).select(quality.divergence(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))).alias("d")).first()
    assert one.d == pytest.approx(want)


def test_clean_prose_is_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = quality.quality(docs).select("row.text", "base_failed", "kept").collect()
    plain = [r for r in got if not r.base_failed and not any(c in r.text for c in "#$|!&%")]
    assert len(plain) > 700 and sum(r.kept for r in plain) >= 0.999 * len(plain)


# --- licences ---------------------------------------------------------------------------------------------------

def test_licence_files_in_their_usual_form(spark, tmp_path):
    """Titles, owner lines in several forms, wrapping, case and spelling do not change a licence's digest."""
    texts = licenses.KNOWN
    wrapped = lambda name: "\n".join(textwrap.wrap(" ".join(texts[name].split()), 60))
    docs = [("MIT", "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + texts["MIT"]),
            ("MIT", "The MIT License (MIT)\n=====\n\nCopyright Jane Doe 2020\nCopyright: others, 2021\n\n" + wrapped("MIT")),
            ("MIT", "Copyright © Jane Doe and her friends\nAll rights reserved.\n" + texts["MIT"].lower()),
            ("ISC", "ISC Licence\n\n(c) 1999 A. Person\n" + wrapped("ISC")),
            ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, Jane\n\n" + wrapped("BSD-3-Clause")),
            ("BSD-2-Clause", "// Copyright Jane\n" + texts["BSD-2-Clause"]), ("Unlicense", texts["Unlicense"]),
            ("0BSD", "Zero-Clause BSD\n\n" + texts["0BSD"]), ("Zlib", "zlib License\n\n(C) 2001 X\n\n" + texts["Zlib"]),
            ("", texts["MIT"].replace("free of charge", "for a fee")), ("", "MIT License\nand a story")]
    frame = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(docs)], "doc_id long, text string")
    got = {r.row.doc_id: r.whole for r in licenses.scan(frame, licenses.known_digests(spark)).collect()}
    assert [",".join(got[k]) for k in range(len(docs))] == [name for name, _ in docs]
    con = as_view(frame.selectExpr("doc_id", "text", "'' AS lang", "'' AS source", "0L AS n_chars"))
    assert {r[0]: r[1] for r in con.execute(licenses.SCAN_SQL).fetchall()} == {k: name for k, (name, _) in enumerate(docs)}
    (tmp_path / "My-1.0.txt").write_text("My License\n\nDo as you please & be kind.\n")
    (tmp_path / "Empty.txt").write_text(" \n")
    own = licenses.known_folder(spark, str(tmp_path))
    assert [r.license for r in own.collect()] == ["My-1.0"]
    found = licenses.scan(spark.createDataFrame([(1, "MY LICENCE\nCopyright Me 2020\ndo as you please and be kind")],
                                                "doc_id long, text string"), own).first()
    assert found.whole == ["My-1.0"]


def test_licences(spark, nasty, empty):
    mit = licenses.KNOWN["MIT"]
    docs = spark.createDataFrame([
        (1, "Copyright (c) 2020 Someone\n\n" + mit), (2, mit.upper().replace(",", " ,")),
        (3, mit.replace("noninfringement", "non-infringement").replace("\n", " ")), (4, mit + " or else"), (5, None), (6, ""),
        (7, "!!!"), (8, "x\nReleased under the MIT Licence\ny"), (8, "x\nReleased under the MIT Licence\ny")],
        "doc_id long, text string")
    known = licenses.known_digests(spark)
    got = sorted((r.row.doc_id, r.whole, r.lines) for r in licenses.scan(docs, known).collect())
    assert got == [(1, ["MIT"], []), (2, ["MIT"], []), (3, ["MIT"], ["MIT"]), (4, [], []), (5, [], []), (6, [], []),
                   (7, [], []), (8, [], ["notice: MIT"]), (8, [], ["notice: MIT"])]
    assert licenses.scan(nasty, known).count() == len(rows()) and licenses.scan(empty, known).count() == 0


# --- tokens -----------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoding():
    lines = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_are_those_of_the_library(nasty, empty, vocabulary, encoding, monkeypatch):
    for block in (bpe.BLOCK_CHARS, 50):  # one block, and nearly one per text
        monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
        encoded = bpe.encode(nasty, vocabulary).select("row.*", F.col("ids").alias("found"))
        both = bpe.decode(encoded, vocabulary, ids_col="found")
        got = both.select("row.text", "row.found", "decoded").collect()
        assert len(got) == len(rows())
        for r in got:
            assert r.found == encoding.encode_ordinary(r.text or "")
            assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty, vocabulary).count() == 0


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(0)
    for top in (1, 160, 161, 1000, 1 << 16, 1 << 20, 1 << 30):
        values = rng.integers(0, top, 5000)
        assert (bpe.unpack(bpe.pack(values)) == values).all()
    assert len(bpe.unpack(bpe.pack([]))) == 0


def test_unknown_ids_and_large_files_are_refused(spark, vocabulary, monkeypatch):
    bad = spark.createDataFrame([([50_300],)], "ids array<int>")
    with pytest.raises(Exception, match="vocabulary lacks"):
        bpe.decode(bad, vocabulary).collect()
    monkeypatch.setattr(bpe, "VOCABULARY_BYTES", 1000)
    with pytest.raises(ValueError, match="more than"):
        bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "x")


def test_token_query(spark, sf_dir, encoding):
    got = {r.doc_id: r for r in QUERIES["op4_byte_bpe"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(200).collect():
        ids = encoding.encode_ordinary(r.text)
        q = got[r.doc_id]
        assert q.n_tokens == len(ids) and q.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert q.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


# --- scores -----------------------------------------------------------------------------------------------------

def test_elias_fano_and_trie():
    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (1000, 1 << 63), (5000, 6000), (300, 1 << 40)):
        values = np.unique(rng.integers(0, top, n).astype(np.uint64)) if n else np.zeros(0, np.uint64)
        seq = lm.EliasFano(lm.EliasFano.encode(values))
        assert (seq.get(np.arange(len(values))) == values).all()
        asked = np.concatenate([values, rng.integers(0, top, 200).astype(np.uint64)])
        found = seq.find(asked, *seq.around(asked))
        assert ((found >= 0) == np.isin(asked, values)).all() and (values[found[found >= 0]] == asked[found >= 0]).all()
        at = seq.successor(asked, np.zeros(len(asked), np.int64), np.full(len(asked), len(values)))
        assert (at == np.searchsorted(values, asked)).all()
    words_ = np.array([3, 900, 1 << 62], np.uint64)
    place, before, logs = np.array([0, 0, 2]), np.array([5, 9, 5], np.uint32), np.array([0.0, 1.0, 2.5])
    trie = lm.Trie(lm.Trie.encode(words_, np.array([7, 8, 9]), place, before, logs))
    assert trie.word(np.array([900, 4, 1 << 62], np.uint64)).tolist() == [1, -1, 2]
    got = trie.log(np.array([0, 0, 1, 2, 2]), np.array([5, 9, 5, 5, 9], np.uint32))
    assert np.allclose(got[[0, 1, 3]], [0, 1, 2.5], atol=1e-4) and np.isnan(got[[2, 4]]).all()


def brute_scores(data, out):
    tokens = [[*words(lower(t or "")), "\n"] for t in data]
    c, b, n = collections.Counter(), collections.Counter(), 0
    for w, held in zip(tokens, out, strict=True):
        if not held:
            c.update(w)
            b.update(zip(["\n\n", *w[:-1]], w, strict=True))
            n += 1
    total, v = sum(c.values()), len(c)
    for w in tokens:
        unigram = [(c[x] + 1) / (total + v + 1) for x in w]
        own = sum(math.log10((b[(u, x)] + lm.PRIOR * p) / ((n if u == "\n\n" else c[u]) + lm.PRIOR))
                  for u, x, p in zip(["\n\n", *w[:-1]], w, unigram, strict=True))
        yield len(w), sum(c[x] > 0 for x in w), total, sum(map(math.log10, unigram)), own


@pytest.mark.parametrize("tokens", [lm.SHARD_TOKENS, 5000])
def test_scores(nasty, empty, tokens):
    got = lm.learn_and_score(nasty, lm.held_out(), shard_tokens=tokens).select(
        "row.doc_id", "row.text", "n_tokens", "n_known", "train_tokens", "base_score", F.col("score").alias("s")).collect()
    out = [zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 == 2 for r in got]
    assert len(got) == len(rows())
    for r, want in zip(got, brute_scores([r.text for r in got], out), strict=True):
        assert tuple(r)[2:5] == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.s == pytest.approx(want[4], abs=1e-3 * r.n_tokens)
    assert lm.learn_and_score(empty, lm.held_out()).count() == 0
    nothing = lm.learn_and_score(nasty, F.lit(True)).select("train_tokens", "n_known").distinct().collect()
    assert nothing == [(0, 0)]


def test_score_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op9_lm_scores"](spark, sf_dir).collect()}
    out = [zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in docs]
    for r, held, want in zip(docs, out, brute_scores([r.text for r in docs], out), strict=True):
        q = got[r.doc_id]
        assert (q.held_out, q.n_tokens, q.n_known, q.train_tokens) == (held, *want[:3])
        assert q.base_score == pytest.approx(want[3], rel=1e-9) and abs(q.score - want[4]) <= 1e-4 * q.n_tokens


def test_nothing_else_imports_the_folder():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "millrace")):
        if "llm" in folder.split(os.sep):
            continue
        for name in names:
            if name.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, name)).read(), name
