"""Phrases, token counts and alignment against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from nasty import CLASHES, frame, lower, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import align, phrases, token_counts
from millrace.llm.queries import QUERIES

SPECIAL = ["<|endoftext|>", "a <|startoftext|>b<|endoftext|><|endoftext|> It's we'll I'D 42 ²½ Ⅷ",
           "▁", "x ▁ y", "<unk> <s> </s> <0x41>", "  two  spaces  ", "\x00\x01 nul", "ﬁ ① Å Å Σίσυφος ΣΑΣ İI",
           "<|endoftext|", "tabs\t\tand\r\nlines 　  wide", "👩‍👩‍👧‍👦🏳️‍🌈", "'s 't 'LL don't"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The awkward table and texts that are odd to tokenizers."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    frame(spark, rows() + [(1000 + k, t, "en", "s1", len(t)) for k, t in enumerate(SPECIAL)]).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


# --- token counts ---------------------------------------------------------------------------------------------------

def test_token_counts_are_the_librarys(odd, empty):
    content = token_counts.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    own = Tokenizer.from_str(content)
    for words, shards in ((False, None), (True, 1)):
        got = token_counts.count_tokens(odd, content, words=words, shards=shards)
        assert set(got.select("row.*").columns) >= set(CLASHES) and got.columns == ["row", "n_tokens"]
        want = collections.Counter((r.doc_id, len(own.encode(r.text or "", add_special_tokens=False).ids))
                                   for r in odd.collect())
        assert collections.Counter(map(tuple, got.select("row.doc_id", "n_tokens").collect())) == want
    assert token_counts.count_tokens(empty, content).count() == 0


def test_token_counts_of_another_tokenizer(odd):
    """Spaces belong to pre-tokens here, and there is no normaliser."""
    content = token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    own = Tokenizer.from_str(content)
    got = token_counts.count_tokens(odd, content, keep=["doc_id"]).select("row.doc_id", "n_tokens").collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(doc_id=r.doc_id, n_tokens=len(
        own.encode(r.text or "", add_special_tokens=False).ids))) for r in odd.collect())


def test_small_blocks_count_alike(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 20_000)
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in QUERIES["op12_token_counts"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        n = len(own.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens) == (len((r.text or "").encode()), n)
        assert got[r.doc_id].over_limit == (n > 2048)


def test_words_need_a_pre_tokenizer_that_drops_spaces():
    content = token_counts.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError, match="spaces"):
        token_counts.PreTokens(content, words=True)


def test_added_tokens_that_normalise_are_refused():
    content = token_counts.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="startoftext"):
        token_counts.PreTokens(content.replace('"normalized":false', '"normalized":true', 1).replace(
            '"normalized": false', '"normalized": true', 1))


# --- alignment ------------------------------------------------------------------------------------------------------

def tokens_of(text):
    """(A ids, B ids, their bytes) straight from the libraries; nothing where bytes differ."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = align.byte_of_char()
    for t in text:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                 for i in ids_b]
        whole = (" " + t).encode() if t else b""
        yield (ids_a, ids_b, raw_a, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else ([], [], [], [])


def brute_alignment(texts):
    found, count = [], collections.Counter()
    for ids_a, ids_b, raw_a, raw_b in tokens_of(texts):
        ends = {int(e): k for k, e in enumerate(np.cumsum([len(x) for x in raw_a]))}
        links = [(ends[int(e)], k) for k, e in enumerate(np.cumsum([len(x) for x in raw_b])) if int(e) in ends]
        count.update((ids_a[i], ids_b[j]) for i, j in links)
        found.append((ids_a, ids_b, links))
    most = collections.Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for a, b, links in found:
        groups, i, j = [], 0, 0
        for x, y in links:
            groups.append(",".join(map(str, a[i:x + 1])) + "|" + ",".join(map(str, b[j:y + 1])))
            i, j = x + 1, y + 1
        own = [count[a[x], b[y]] for x, y in links]
        yield (len(a), len(b), len(links), len(links), sum(n == most[b[y]] for n, (_, y) in zip(own, links, strict=True)),
               sum(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")


def test_alignment_of_awkward_rows(spark, odd, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(align, "SLICE_CHARS", 3000)
    monkeypatch.setattr(align, "BLOCK_CHARS", 20_000)
    docs = odd.collect()
    want = [(r.doc_id, *x) for r, x in zip(docs, brute_alignment([r.text or "" for r in docs]), strict=True)]
    got = QUERIES["op13_token_alignment"](spark, odd_folder(odd)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert sum(w[1] == 0 for w in want) >= 5  # null, empty, U+2581
    sides = [align.ByteLevel(public_tokenizers.path("byte_bpe_50k.json")),
             align.Pieces(public_tokenizers.path("piece_bpe_32k.model"))]
    assert align.align(empty, *sides).count() == 0
    assert set(align.align(odd, *sides).select("row.*").columns) >= set(CLASHES)


def odd_folder(odd):
    return odd.inputFiles()[0].rsplit("/documents.parquet", 1)[0]


def test_lockstep_meets_everywhere(monkeypatch):
    rng = np.random.default_rng(7)
    for lane in (1, 7, 1 << 20):
        monkeypatch.setattr(align, "LANE_BYTES", lane)
        n_bytes = rng.integers(0, 200, 30)
        total = int(n_bytes.sum())
        text_ends = set(np.cumsum(n_bytes)[n_bytes > 0].tolist())
        a, b = (np.array(sorted({*rng.integers(1, total, 900).tolist(), *text_ends})) for _ in range(2))
        in_a, in_b = align.lockstep(a, b, *align._lanes(n_bytes))
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[in_a].tolist() == b[in_b].tolist() == both


# --- phrases --------------------------------------------------------------------------------------------------------

def brute_collocations(docs, at_least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    able = {p: c for p, c in f.items() if len(p) > 2 and c >= at_least}
    longer = collections.Counter()
    for (lang, *w), c in able.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, *w[i:i + k]] = max(longer[lang, *w[i:i + k]], c)
    out = collections.defaultdict(list)
    for p, a in able.items():
        lang, *w = p
        if longer[p] >= a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]],
                                     f[lang, *w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, rank, phrase.decode(), -a, left, right, n[lang], -score) for lang, found in out.items()
            for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)}


@pytest.mark.parametrize("shards", [1, 8])
def test_collocations_of_random_texts(spark, monkeypatch, shards):
    monkeypatch.setattr(phrases, "BLOCK_CHARS", 700)
    rng = random.Random(shards)
    words = ["the", "The", "a", "b'", "c-d", "é", "ß", "\x85", "x\x1cy", "of", " ", "<s>"]
    docs = [(rng.choice([None, "en", "fr", ""]), "".join(rng.choice(words) + rng.choice("   \t  .\n,;\r") * rng.choice([1, 1, 2])
                                                        for _ in range(rng.randrange(60)))) for _ in range(120)]
    docs += [("en", None), ("en", ""), ("fr", " . ,"), (None, "the a " * 400)] + [("en", "once upon a time there was")] * 9
    table = spark.createDataFrame([(*d, "clash") for d in docs], "lang string, text string, f string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    try:
        for at_least, longest, top in ((5, 5, 40), (3, 3, 2000)):
            got = phrases.collocations(table, at_least, longest, top).collect()
            want = brute_collocations(docs, at_least, longest, top)
            assert {tuple(r) for r in got} == want and len(got) == len(want) > 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_collocations_of_awkward_rows(nasty, empty):
    got = phrases.collocations(nasty, 2).collect()
    assert {tuple(r) for r in got} == brute_collocations([(r.lang, r.text) for r in nasty.collect()], 2, 5, 2000)
    assert phrases.collocations(empty).count() == 0


def test_hash_collisions_never_lose_a_phrase(spark, monkeypatch):
    """With codes of four bits nearly all n-grams collide; counts are still exact."""
    plain = phrases.ngram_codes
    monkeypatch.setattr(phrases, "ngram_codes", lambda *a: ((at, code & 0xF) for at, code in plain(*a)))
    docs = [("en", "one two three. two three four one two " * 3)] * 4
    got = phrases.collocations(spark.createDataFrame(docs, "lang string, text string"), 8).collect()
    assert {tuple(r) for r in got} == brute_collocations(docs, 8, 5, 2000)


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(5)
    for _ in range(20):
        stream = rng.zipf(1.3, 5000) % 700
        capacity = len(stream) // 40 + 1
        whole = collections.Counter(stream.tolist())
        parts = [(np.unique(x, return_counts=True)) for x in np.array_split(stream, 9)]
        left = phrases.merged([phrases.merged(parts[:4], capacity), phrases.merged(parts[4:6], capacity), *parts[6:]], capacity)
        assert len(left[0]) <= capacity and {k for k, n in whole.items() if n >= 40} <= set(left[0].tolist())
    keys = np.unique(rng.integers(0, 2**32, 1000))
    assert np.array_equal(phrases.unpack_sorted(phrases.pack_sorted(keys)), keys)
    assert np.array_equal(phrases.unpack_sorted(phrases.pack_sorted(np.array([2**32 - 1]))), [2**32 - 1])
    assert len(phrases.unpack_sorted(phrases.pack_sorted(keys[:0]))) == 0


def test_ranks_of_a_language_are_the_querys(spark, sf_dir):
    got = QUERIES["op11_collocations"](spark, sf_dir)
    by = got.groupBy("lang").agg(F.max("rank").alias("m"), F.count("*").alias("n")).collect()
    assert by and all(r.m == r.n <= phrases.TOP for r in by)
