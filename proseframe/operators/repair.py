"""Set-oriented repair: edits of texts, and messages without the sentences that were reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import segment as S


def gate_edits(docs: DataFrame, edits: DataFrame, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(admitted, refused) of edits(doc_id, start, end, text): characters from zero, end exclusive.

    Edits are read in the order of their starts, then ends. Refused are those outside the text, those
    that overlap an edit admitted before, and with scope(doc_id, start, end) those that no range of
    it holds.
    """
    keep = ["doc_id", "start", "end", "text"]
    rows = edits.join(docs.select("doc_id", F.length("text").alias("_n")), "doc_id", "left")
    inside = (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("_n"))
    if scope is not None:
        ranges = scope.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("_ranges"))
        rows = rows.join(ranges, "doc_id", "left")
        inside = inside & F.exists("_ranges", lambda r: (r["start"] <= F.col("start")) & (F.col("end") <= r["end"]))
    rows = rows.withColumn("_ok", F.coalesce(inside, F.lit(False)))
    ordered = rows.where("_ok").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("_edits"))
    start = F.array().cast("array<struct<start: int, end: int, text: string>>")
    free = lambda kept, e: (F.size(kept) == 0) | (e["start"] >= F.get(kept, F.size(kept) - 1)["end"])
    cast = F.col("_edits").cast("array<struct<start: int, end: int, text: string>>")
    kept = F.aggregate(cast, start, lambda kept, e: F.when(free(kept, e), F.array_append(kept, e)).otherwise(kept))
    admitted = ordered.select("doc_id", F.explode(kept).alias("e")).select("doc_id", "e.*")
    return admitted, edits.select(keep).exceptAll(admitted.select(keep))


def splice(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the text after non-overlapping edits; the text is read once from left to right."""
    own = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("text").alias("instead")))).alias("_edits"))
    rows = docs.join(own, "doc_id", "left")

    def piece(e: Column, i: Column) -> Column:
        before = F.coalesce(F.get(F.col("_edits"), i - 1)["end"], F.lit(0))
        before = F.when(i == 0, F.lit(0)).otherwise(before)
        return F.concat(F.expr("text").substr(before + 1, e["start"] - before), e["instead"])

    last = F.element_at("_edits", -1)["end"]
    spliced = F.concat(F.array_join(F.transform("_edits", piece), ""), F.col("text").substr(last + 1, F.length("text")))
    return rows.withColumn("text", F.when(F.size("_edits") > 0, spliced).otherwise(F.col("text"))).drop("_edits")


def cut_sentences(text: Column, reported: callable) -> Column:
    """A message without its reported sentences; its lines stay lines, and a line of which nothing is left goes."""
    def of_line(line: Column) -> Column:
        sentences = S.message_sentences_of(line)
        flagged = F.exists(sentences, reported)
        return F.when(flagged, F.array_join(F.filter(sentences, lambda s: ~reported(s)), " ")).otherwise(line)

    ls = S.lines_of(text)
    kept = F.transform(ls, lambda s: F.struct(s.alias("was"), of_line(s).alias("now")))
    kept = F.filter(kept, lambda p: (p["now"] != "") | (p["was"] == ""))
    return F.array_join(F.transform(kept, lambda p: p["now"]), "\n")


def divided(text: Column, chars: int, words: int) -> Column:
    """The sentences of a block as parts: a part ends before the sentence that takes it over either target."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, s: Column) -> Column:
        longer = F.when(state["open"] == "", s).otherwise(F.concat(state["open"], F.lit(" "), s))
        over = (state["open"] != "") & ((F.length(longer) > chars) | (S.word_count(longer) > words))
        done = F.when(over, F.array_append(state["done"], state["open"])).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(over, s).otherwise(longer).alias("open"))

    return F.aggregate(S.sentences_of(text), start, step, lambda st: F.when(st["open"] == "", st["done"]).otherwise(F.array_append(st["done"], st["open"])))


def joined_lines(text: Column) -> Column:
    """A document with each prose block on one line; verbatim lines stay as they are.

    The words of the result are those of the text in the same order, else the text stays.
    """
    raw = lambda ls, b: F.array_join(F.slice(ls, b["start_line"], b["end_line"] - b["start_line"] + 1), "\n")
    one = lambda ls: F.transform(S.blocks_of(text), lambda b: F.when(b["kind"] == "prose", F.concat(b["indent"], b["text"])).otherwise(raw(ls, b)))
    new = F.array_join(S.let(S.lines_of(text), one), "\n")
    flat = lambda t: F.btrim(F.regexp_replace(t, r"\s+", " "))
    return S.let(new, lambda n: F.when(flat(n) == flat(text), n).otherwise(text))


def sections_to_move(sections: DataFrame, total: Column, target: int) -> DataFrame:
    """Of sections(doc_id, section_no, n_chars), the largest ones that have to move until total less moved fits the target."""
    place = W.partitionBy("doc_id").orderBy(F.desc("n_chars"), "section_no")
    rows = sections.withColumn("_before", F.coalesce(F.sum("n_chars").over(place.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.where(total - F.col("_before") > target).drop("_before")
