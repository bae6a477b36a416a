"""Names that one text uses and nothing else in the corpus holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segment as S
from ..functions.wordlists import NAME_LETTERS, NAMES_PER_TEXT


def document_frequency(docs: DataFrame, wanted: Column | None = None) -> DataFrame:
    """word, n_docs over identifier words; with `wanted`, a test of the column word, only of those, so that no other word is shuffled."""
    words = docs.select("doc_id", F.explode(F.array_distinct(S.identifier_words_of(F.col("text")))).alias("word"))
    words = words if wanted is None else words.where(wanted)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


def identifier_shaped(word: Column) -> Column:
    """Eight letters or more with an inner capital after a small letter, or an underscore between letters."""
    return (F.length(word) >= NAME_LETTERS) & word.rlike("[a-z][A-Z]|[A-Za-z]_[A-Za-z]") & word.rlike("^[A-Za-z_]")


def dead_names(docs: DataFrame, candidate: Column | None = None, most_names: int = NAMES_PER_TEXT) -> DataFrame:
    """doc_id, name: candidate words that stand once in their text and in no other document.

    A text with more candidates than most_names answers nothing. `candidate` tests the column word.
    """
    found = S.identifier_words_of(F.col("text"))
    candidate = identifier_shaped(F.col("word")) if candidate is None else candidate
    rows = docs.select("doc_id", F.explode(found).alias("word")).where(candidate)
    per_text = rows.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = per_text.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_names")).where(F.col("n_names") <= most_names)
    # one pass: a word of one document has that document's id as its least
    once = per_text.groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"), F.min("doc_id").alias("doc_id")).where("n_docs = 1 and n = 1")
    return once.join(counts.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("word").alias("name"))


def without_file_names(names: DataFrame, paths: DataFrame) -> DataFrame:
    """names(doc_id, name) that are no word of a path(path) and no beginning of a path's last part."""
    words = paths.select(F.explode(S.identifier_words_of(F.col("path"))).alias("name")).distinct()
    base = paths.select(F.element_at(F.split("path", "/"), -1).alias("base")).withColumn("head", F.substring("base", 1, NAME_LETTERS))
    names = names.join(words, "name", "left_anti").withColumn("head", F.substring("name", 1, NAME_LETTERS))
    return names.join(base, (names["head"] == base["head"]) & base["base"].startswith(names["name"]), "left_anti").select("doc_id", "name")
