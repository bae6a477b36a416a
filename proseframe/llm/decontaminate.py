"""Benchmark decontamination: prefix-filtered set join of word shingles, then exact containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, written

#: What separates words, fixed by the contract: ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, -1), lambda w: w != "")


def _shingle(words: Column, at: Column, size: int) -> Column:
    """The 64-bit name of `size` words from the 0-based place `at`."""
    return F.xxhash64(F.lit(size), *(F.get(words, at + k) for k in range(size)))


def _shingles(words: Column, size: int) -> Column:
    """All shingles of a word array, by place."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _shingle(words, i, size))).otherwise(
        F.array().cast("array<bigint>")
    )


def item_windows(benchmark: DataFrame, window_words: int, shingle_words: int) -> DataFrame:
    """Distinct windows(window array<string>, size, items array<string>, shingles array<struct<offset, size, shingle>>).

    A window is window_words consecutive words of an item, or all its words if it has fewer, but
    not none. Its shingles have shingle_words words, or as many as a shorter window has.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    width = F.least(F.lit(window_words), F.size("words"))
    windows = (
        items.where(F.size("words") > 0)
        .withColumn("width", width)
        .select("item_id", "words", "width", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width"))).alias("at"))
        .select("item_id", F.slice("words", F.col("at") + 1, F.col("width")).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item_id").alias("items"))
    )
    def placed(n: int) -> Column:
        fits = F.size("window") >= n if n == shingle_words else F.size("window") == n
        shingles = F.when(fits, _shingles(F.col("window"), n)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(shingles, lambda s, i: F.struct(i.alias("offset"), F.lit(n).alias("size"), s.alias("shingle")))

    by_size = [placed(n) for n in range(1, shingle_words + 1)]
    return windows.select(
        "window", F.size("window").alias("size"), "items", F.flatten(F.array(*by_size)).alias("shingles")
    )


def find_contamination(documents: DataFrame, benchmark: DataFrame, window_words: int = 10, shingle_words: int = 3) -> DataFrame:
    """Mark document words inside any occurrence of an item window.

    A window is contained in a document only where all its shingles are, so its prefix is one
    shingle: the one rarest in the documents. Documents are joined by these prefix shingles alone.
    A match at place p of a shingle at offset o of a window can only be the window at p - o, which
    has to lie inside the document (positional and length bounds); the words there are compared.

    Null or empty texts have no words, no hits and are not contaminated. Items without words are
    ignored; a null item_id has windows but no name in items. Identical windows of several items
    count for each. Repeated document rows are each returned. Other columns are ignored.
    Columns doc_id and text are required. Empty tables on either side give rows without hits, or
    none.

    Returns doc_id, text, n_words, n_hit, items array<string> sorted.
    """
    windows = written(item_windows(benchmark, window_words, shingle_words), "windows")
    sizes = [r["size"] for r in windows.select(F.explode("shingles").alias("s")).select("s.size").distinct().collect()]  # 3 at most
    vocabulary = written(windows.select(F.explode("shingles.shingle").alias("shingle")).distinct(), "benchmark-shingles")

    docs = documents.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("row"))
    worded = docs.select("row", words_of(F.col("text")).alias("words"))
    of_document = F.flatten(F.array(*(_shingles(F.col("words"), n) for n in sizes))) if len(sizes) > 1 else _shingles(F.col("words"), (sizes or [1])[0])
    # how often each shingle of the benchmark stands in the documents: its rarity
    seen = (
        worded.select(F.explode(of_document).alias("shingle"))
        .join(vocabulary, "shingle", "left_semi")
        .groupBy("shingle")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    seen = written(seen, "shingle-counts")
    rarest = (
        windows.select("window", "size", F.explode("shingles").alias("s"))
        .select("window", F.col("size").alias("window_size"), "s.*")
        .join(seen, "shingle", "left")
        .groupBy("window", "window_size")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "size", "shingle")).alias("p"))
        .where(F.col("p.n") > 0)  # a window with a shingle in no document is in none
        .select("window", "window_size", "p.offset", "p.size", "p.shingle")
    )
    rarest = written(rarest, "prefixes")
    prefix_places = rarest.select("shingle", "size").distinct()

    places = [
        worded.select("row", F.posexplode(_shingles(F.col("words"), n)).alias("place", "shingle")).withColumn("size", F.lit(n)) for n in sizes
    ]
    if not places:
        return docs.select("doc_id", "text", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    found = places[0]
    for more in places[1:]:
        found = found.unionByName(more)
    matched = found.join(prefix_places, ["shingle", "size"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("shingle", "place")).alias("matches"))
    matched = written(matched, "prefix-matches")

    # exact containment where the bounds allow it; a match takes along only the words around it
    first = lambda m: F.greatest(m["place"] - (window_words - 1), F.lit(0))
    around = lambda m: F.struct(
        m["shingle"].alias("shingle"), m["place"].alias("place"), first(m).alias("first"),
        F.slice("words", first(m) + 1, 2 * window_words).alias("near"),
    )
    starts = (  # what matched grows with the documents, so it is never broadcast
        docs.join(matched.hint("merge"), "row")
        .select("row", words_of(F.col("text")).alias("words"), "matches")
        .select("row", F.explode(F.transform("matches", around)).alias("m"))
        .join(rarest, F.col("m.shingle") == F.col("shingle"))
        .withColumn("start", F.col("m.place") - F.col("offset"))
        .where(F.col("start") >= 0)
        .where(F.slice("m.near", F.col("start") - F.col("m.first") + 1, F.col("window_size")) == F.col("window"))
        .select("row", "start", "window", "window_size")
    )
    hits = (
        starts.join(windows.select("window", "items"), "window")
        .groupBy("row")
        .agg(
            F.collect_set(F.struct("start", "window_size")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["window_size"] - 1))))
    hits = hits.select("row", F.size(covered).cast("long").alias("n_hit"), "items")
    counted = docs.withColumn("n_words", F.size(words_of(F.col("text"))).cast("long"))  # below the join, which then needs no text
    return counted.join(hits, "row", "left").select(
        "doc_id",
        "text",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
