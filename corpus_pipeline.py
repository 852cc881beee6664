"""The corpus pipeline: language, near copies, secrets, mix, tokens.

Each stage works on what the one before kept. Stages take (spark, docs, sf_dir); all but the last return the columns of
`documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, langid, mixing, neardup, secrets
from millrace.session import cut_lineage, new_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the learnt languages: without a letter, or with a code longer than its language's limit.

    The limits come from the code lengths of all labelled documents; texts of less than 200 bytes need a letter only. Null
    and empty texts go, repeated rows share one fate, very long texts are scored whole, an empty table stays empty. Any
    column names are kept.
    """
    model = langid.learn(docs)
    found = langid.identify(docs, model)
    known = (F.col("lang_pred") != langid.UNKNOWN) & langid.within(langid.limits(docs, model), F.col("row.text"))
    return found.filter(known).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest id; repeated rows count as copies.

    Documents that are alone in their group pass without a shuffle; only the others are joined to the ones that stay. Null,
    empty and wordless texts are groups of their own. An empty table stays empty; any column names are kept.
    """
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text",
                        F.xxhash64("text").alias("key"))
    found = neardup.near_duplicates(keyed, keep=["doc_id", "key"])
    # A document without words is a group of its own.
    group = F.coalesce("component", F.xxhash64("row.doc_id", "row.key"))
    named = cut_lineage(found.select("row.doc_id", "row.key", group.alias("group")))
    groups = named.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min(
        F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("k"))
    staying = groups.select(F.col("k.doc_id").alias("kept_id"), F.col("k.key").alias("kept_key"))
    several = cut_lineage(named.join(groups.filter("n > 1").select("group"), "group").select("key").distinct())
    alone = neardup.may_hold(keyed, several, "key", inside=False)
    rest = neardup.may_hold(keyed, several, "key").join(
        staying, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")))
    first = rest.dropDuplicates(["kept_id", "kept_key"])
    return alone.select("row.*").unionByName(first.select("row.*"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is masked; all documents stay.

    Null texts stay null, texts without a secret as they are; `n_chars` follows the text. Repeated rows are masked alike,
    an empty table stays empty, long texts are scanned whole and any column names are kept.
    """
    found = secrets.scan(docs, secrets.learn(docs), redact=True)
    fresh = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return found.select(*(fresh.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words; null, empty and wordless texts go. An empty table stays empty."""
    return mixing.repeated(mixing.mix(docs)).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text beside doc_id, lang and source; null and empty texts have none. An empty table stays
    empty."""
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    encoded = bpe.encode(docs, vocabulary, keep=["doc_id", "lang", "source"])
    return encoded.select("row.*", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode_texts),
]
# Language ID, the tagger and BPE merges are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
