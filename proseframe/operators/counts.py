"""Rules about numbers that texts state and that go stale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import kinds as K
from ..functions import numbers as N
from ..functions import segment as S
from ..functions.wordlists import COMMENT_CHARS, class_words
from .rewrites import Rewrite
from .rules import At, Case, hit, rule


@rule("counts/stated-count", "block", cases=(
    Case("digits", "It has 3 rules."), Case("word", "It reads two files."), Case("measure", "It waits 30 seconds."), Case("thousands", "It reads 1,000 rows."),
    Case("code", "It prints `3 rules` there.", False), Case("status", "It answers 404 responses.", False), Case("label", "See version 2 files.", False)))
def stated_count(b: At) -> Column:
    found = N.number_phrases(b.masked, "gate")
    return F.transform(found, lambda h: b.here("a count that goes stale", h["text"], "Name the things, or leave the number out.", h["value"]))


@rule("counts/inventory-count", "block", place=20, rewrites=(Rewrite(N.RESTATED, N.restated, behind=N.RESTATED_BEHIND, near=r"(?<=\s)", holds=N.ANY_NUMBER),), cases=(
    Case("tally", "It ships three hooks.", want="It ships hooks."), Case("measure", "The read has about 20 seconds.", want="The read has several seconds."),
    Case("ceiling", "It has at most 5 rows.", want="It has a bounded number of rows."), Case("ceiling behind", "It takes 25 words or fewer.", want="It takes a bounded number of words."),
    Case("floor", "It needs at least 2 keys.", want="It needs a couple of keys."), Case("above", "It needs more than 5 keys.", want="It needs several keys."),
    Case("possessive", "This repo's 15 plugins ride along.", want="This repo's plugins ride along."), Case("no frame", "Cut it into three parts.", False)))
def inventory_count(b: At) -> Column:
    found = N.number_phrases(b.masked, "prose")
    return F.transform(found, lambda h: b.here("a count of what is here", h["text"], "Leave the number out, or say a vague one.", h["value"]))


@rule("counts/postdeterminer", "block", "warning", cases=(Case("the", "It reads the two files."), Case("unit", "It waits the 30 seconds.", False), Case("bare", "It reads the files.", False)))
def postdeterminer(b: At) -> Column:
    """A number behind a determiner; measures need theirs."""
    behind = lambda h: F.lower(F.regexp_extract(F.substring(b.masked, F.lit(1), h["start"]), r"([A-Za-z]+)\s+$", 1)).isin("the", *class_words("determiner"))
    found = F.filter(N.number_phrases(b.masked, "gate"), lambda h: behind(h) & ~h["noun"].isin(N.MEASURES))
    return F.transform(found, lambda h: b.here("a number behind a determiner", h["text"], "Leave the number out.", h["value"]))


@rule("comments/number", "document", cases=(
    Case("comment", "x = 1\n// it holds 3 rows"), Case("no comment", "It holds 3 rows.", False), Case("measure", "// it waits 30 seconds"), Case("status", "// it exits 121 there", False)))
def comment_number(d: At) -> Column:
    """Numbers in comments, but for those that name a thing, a value or a place."""
    found = lambda r: F.transform(N.number_phrases(r["text"], "comment"), lambda h: hit(r["start_line"], r["end_line"], "a number in a comment", h["text"], "Leave the number out, or name the constant.", h["value"]))
    return F.flatten(F.transform(F.filter(S.comment_runs_of(d.text), lambda r: ~K.is_license_notice(r["text"])), found))


@rule("comments/length", "document", cases=(
    Case("heavy", "// " + "it says a lot about one line " * 6 + "\nx = 1"), Case("balanced", "// " + "word " * 20 + "\n" + "value = compute(a, b, c)\n" * 8, False),
    Case("short", "// a note\nx = 1", False), Case("license", "// Copyright 2020 " + "holders of the rights " * 8 + "\nx = 1", False)))
def comment_length(d: At) -> Column:
    """A comment of COMMENT_CHARS characters or more that weighs more than the code below it, up to a blank line; white space weighs nothing."""
    size = lambda c: F.length(F.regexp_replace(c, r"\s", ""))
    least = d.limit("comment_chars", COMMENT_CHARS)

    def of(ls: Column) -> Column:
        def judged(r: Column) -> Column:
            rest = F.slice(ls, r["end_line"] + 1, F.size(ls))
            ends = F.array_position(F.transform(rest, lambda x: x.rlike(r"^\s*$") | x.rlike(r"^\s*(//|#|--)")), F.lit(True))
            code = F.array_join(F.slice(rest, F.lit(1), F.when(ends > 0, ends.cast("int") - 1).otherwise(F.size(rest))), "")
            weighs = (size(r["text"]) >= least) & (size(r["text"]) > size(code)) & ~K.is_license_notice(r["text"])
            return F.when(weighs, hit(r["start_line"], r["end_line"], "a comment that weighs more than its code", r["text"], "Shorten it.", size(r["text"])))

        return F.array_compact(F.transform(S.comment_runs_of(d.text), judged))

    return F.when(d.text.rlike(r"(?m)^\s*(//|#|--)"), S.let(S.lines_of(d.text), of))
