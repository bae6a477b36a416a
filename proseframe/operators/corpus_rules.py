"""Rules that need more than one text: each is a join or a grouping over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wordlists as L
from . import dead_names, near_lines, phrases, references
from .rules import HIT, Case, Segments, hit, wide_rule


@wide_rule("repo/near-duplicate", cases=(Case("first", "one\ntwo\nthree\nfour", False), Case("copy", "one\ntwo\nthree\nfour"), Case("other", "five\nsix", False)))
def near_duplicate(s: Segments) -> DataFrame:
    """A document that shares nearly all its lines with an earlier one; the first of a group is none."""
    found = near_lines.near_duplicates(s.docs, s.limits.get("near_share", L.NEAR_DUPLICATE_SHARE))
    said = F.concat(F.lit("document "), F.col("doc_a").cast("string"))
    made = hit(F.lit(1), F.lit(1), "nearly the lines of an earlier document", said, "Keep one of them.", F.floor(100 * F.col("share")))
    return found.select(F.col("doc_b").alias("doc_id"), made.alias("h")).select("doc_id", "h.*")


@wide_rule("tombstones/name-nothing-in-the-repository-defines", cases=(Case("gone", "It calls oldHelperName there."), Case("known", "It calls sharedHelper, and sharedHelper again.", False)))
def dead_name(s: Segments) -> DataFrame:
    """A name that stands once in one text and nowhere else; names of files are none."""
    names = dead_names.dead_names(s.docs)
    if "path" in s.docs.columns:
        names = dead_names.without_file_names(names, s.docs)
    made = hit(F.lit(0), F.lit(0), "a name that nothing defines", F.col("name"), "Name what is there now.")
    return names.select("doc_id", made.alias("h")).select("doc_id", "h.*")


@wide_rule("ste/dictionary", "warning", cases=(Case("listed", "They utilise it."), Case("name", "UTILISE and Utilise stand.", False)))
def dictionary_word(s: Segments) -> DataFrame:
    """A word that the caller's dictionary(word, approved) does not approve, in the limit `dictionary`; without one there are none."""
    listed = s.limits.get("dictionary")
    if listed is None:
        return s.docs.sparkSession.createDataFrame([], f"doc_id {dict(s.docs.dtypes)['doc_id']}, {HIT}")
    found = phrases.unapproved_words(s.docs, listed)
    made = hit(F.col("start_line"), F.col("end_line"), F.concat(F.lit("an unapproved word for: "), F.array_join("approved", ", ")), F.col("word"), "Write an approved one.")
    return found.select("doc_id", made.alias("h")).select("doc_id", "h.*")


@wide_rule("counts/section-number", cases=(Case("cited", "See section 7.3 there."), Case("plain", "See the sections there.", False)))
def section_number(s: Segments) -> DataFrame:
    """A section cited by its number, which the next edit moves; where the heading is known, its link is the fix."""
    found = references.section_citations(s.docs)
    what = F.when(F.col("anchor").isNull(), "a section by a number that no heading has").otherwise(F.concat(F.lit("a section by its number, in place of #"), F.col("anchor")))
    made = hit(F.lit(0), F.lit(0), what, F.concat_ws(" ", F.nullif("name", F.lit("")), F.concat(F.lit("§"), F.col("number"))), "Link the heading.")
    return found.select("doc_id", made.alias("h")).select("doc_id", "h.*")
