"""One query per corpus operator over its whole table, and their SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, fingerprints, langid, licenses, lm, mixing, neardup, phrases, privacy, secrets, token_counts
from . import quality as rules
from .words import text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op10_mix_sources", mixing.MIX_SQL)
def op10(spark, folder):
    mixed = mixing.mix(documents(spark, folder), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")


@query("op5_language_id")
def op5(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    model = langid.learn(docs.filter(~langid.held_out()))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("row.doc_id", langid.held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


@query("op6_quality_rules", rules.QUALITY_SQL)
def op6(spark, folder):
    judged = rules.quality(documents(spark, folder), keep=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept")


@query("op4_byte_bpe")
def op4(spark, folder):
    import public_tokenizers

    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode(documents(spark, folder), vocabulary, keep=["doc_id"]).select("row.doc_id", "ids")
    both = bpe.decode(encoded, vocabulary)
    digits = F.concat_ws(",", F.col("row.ids").cast("array<string>"))
    return both.select("row.doc_id", F.size("row.ids").cast("long").alias("n_tokens"),
                       F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def spans_text(spans):
    """kind:start:end of all spans, comma-joined in their order."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


@query("op1_secret_scan")
def op1(spark, folder):
    docs = documents(spark, folder)
    found = secrets.scan(docs, secrets.learn(docs), keep=["doc_id"])
    base = spans_text(F.filter("spans", lambda s: s["kind"] != secrets.FOUND))
    return found.select("row.doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))


@query("op2_minhash_neardup", neardup.NEARDUP_SQL)
def op2(spark, folder):
    found = neardup.near_duplicates(documents(spark, folder), keep=["doc_id"])
    return found.select("row.doc_id", "n_shingles", "component_id", "kept")


@query("op7_fingerprints")
def op7(spark, folder):
    found = fingerprints.beside_next(documents(spark, folder), keep=["doc_id"])
    return found.select("row.doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                        "near_next")


@query("op9_lm_scores")
def op9(spark, folder):
    docs = documents(spark, folder)
    found = lm.learn_and_score(docs, lm.held_out(), keep=["doc_id"])
    return found.select("row.doc_id", lm.held_out("row.doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens",
                        "base_score", "score")


@query("op3_private_data", privacy.PRIVATE_SQL)
def op3(spark, folder):
    found = privacy.find_private(documents(spark, folder), keep=["doc_id"])
    base = spans_text(F.filter("spans", lambda s: s["kind"] != privacy.TERM))
    return found.select("row.doc_id", *(f"n_{k}" for k in privacy.KINDS), F.sha2(base, 256).alias("base_sha256"),
                        spans_text(F.col("spans")).alias("spans"))


@query("op8_license_scan", licenses.SCAN_SQL)
def op8(spark, folder):
    found = licenses.scan(documents(spark, folder), licenses.known_digests(spark), keep=["doc_id"])
    return found.select("row.doc_id", F.concat_ws(",", "whole").alias("whole"), F.concat_ws(",", "lines").alias("lines"))


@query("op12_token_counts")
def op12(spark, folder):
    import public_tokenizers

    content = token_counts.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    docs = documents(spark, folder).select("doc_id", "text", F.octet_length(text_or_empty("text")).alias("n_bytes"))
    found = token_counts.count_tokens(docs, content, keep=["doc_id", "n_bytes"], words=True)
    return found.select("row.doc_id", F.col("row.n_bytes").cast("long").alias("n_bytes"), "n_tokens",
                        (F.col("n_tokens") > 2048).alias("over_limit"))


@query("op13_token_alignment")
def op13(spark, folder):
    import public_tokenizers

    side_a = align.ByteLevel(public_tokenizers.path("byte_bpe_50k.json"))
    side_b = align.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    aligned = align.align(documents(spark, folder), side_a, side_b, keep=["doc_id"])
    figures = {"n_a": F.size("a_ids"), "n_b": F.size("b_ids"), "n_groups": F.size("a_cut"), "n_links": F.size("link_count"),
               "n_best": F.size(F.filter("link_best", lambda x: x)),
               "count_sum": F.aggregate("link_count", F.lit(0).cast("long"), lambda x, y: x + y)}
    counted = aligned.select("row.doc_id", "a_ids", "b_ids", "a_cut", "b_cut",
                             *(v.cast("long").alias(k) for k, v in figures.items()))
    digested = align.group_digests(counted, keep=["doc_id", *figures])
    return digested.select("row.*", "groups_sha256")


@query("op11_collocations", phrases.COLLOCATION_SQL)
def op11(spark, folder):
    return phrases.collocations(documents(spark, folder).select("text", "lang"))
