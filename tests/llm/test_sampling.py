"""Samples keep their bound and every labelled language, however often a text is copied."""

from pyspark.sql import functions as F

from millrace.llm import langid, secrets
from millrace.llm.sampling import distinct_texts


def copies(spark, texts, times):
    """(text, lang): each text once, the one of the smallest hash `times` times more."""
    rows = spark.createDataFrame([(x, "many") for x in texts], "text string, lang string")
    most = rows.orderBy(F.xxhash64("text")).limit(1).crossJoin(spark.range(times)).select("text", "lang")
    return rows.unionByName(most)


def test_sample_is_strict(spark):
    docs = copies(spark, [f"text number {k}" for k in range(500)], 2000)
    assert sorted(r.text for r in distinct_texts(docs, 40).collect()) == sorted(
        r.text for r in docs.select("text").distinct().orderBy(F.xxhash64("text")).limit(40).collect())
    assert distinct_texts(docs, 1000).count() == 500
    assert distinct_texts(docs.limit(0), 10).count() == 0


def test_every_language_is_learnt(spark):
    docs = copies(spark, [f"text number {k}" for k in range(500)], 2000)
    # One text a language, copied more often than is sampled: drawing by its hash alone misses most of them.
    alone = spark.range(20).select(F.concat(F.lit("only "), "id").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    many = alone.crossJoin(spark.range(30).select()).unionByName(docs)
    assert langid.learn(many, sample_docs=3).languages == sorted(["many", *(f"l{k}" for k in range(20))])


def test_secrets_sample_is_bounded(spark, monkeypatch):
    docs = copies(spark, [f"text number {k}" for k in range(500)], 2000)
    sizes, windows = [], secrets.training_windows
    monkeypatch.setattr(secrets, "training_windows", lambda taken, *a: sizes.append(taken.count()) or windows(taken, *a))
    secrets.learn(docs, sample_docs=50)
    assert sizes == [50]
