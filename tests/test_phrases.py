"""Phrase tables: each entry is found and mended, and guards hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from proseframe.functions import phrase_tables as T
from proseframe.operators import phrases


def mended(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r.x for r in rows.select("i", column(F.col("text")).alias("x")).orderBy("i").collect()]


def test_each_filler_and_swap(spark):
    words = [w for _, w in phrases.of_surface(T.FILLERS, "document")]
    assert mended(spark, phrases.without_fillers, [f"It {w} fails." for w in words]) == ["It fails."] * len(words)
    swaps = phrases.of_surface(T.SWAPS, "document")
    assert mended(spark, phrases.with_short_phrases, [f"It waits {a} it ends" for _, a, _ in swaps]) == [f"It waits {b} it ends" for _, _, b in swaps]


def test_guards(spark):
    texts = ["It `simply` waits", 'He says "simply" so', "See [simply](x) there", "A simply-typed term", "un-simply put", "Simply put, it simply waits", None, ""]
    got = mended(spark, phrases.without_fillers, texts)
    assert got == [*texts[:5], "Put, it waits", None, ""]


def test_unapproved_words(spark):
    docs = spark.createDataFrame([(1, "They utilise it. UTILISE and Utilise stand."), (2, None)], "doc_id long, text string")
    listed = spark.createDataFrame([("utilise", ["use"]), ("utilise", ["use"])], "word string, approved array<string>")
    assert [(r.word, r.approved) for r in phrases.unapproved_words(docs, listed).collect()] == [("utilise", ["use"])]
