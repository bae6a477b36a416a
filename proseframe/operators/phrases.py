"""Phrase and pattern tables over texts: what is cut, swapped, reported, and what guards a rewrite."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kinds as K
from ..functions import phrase_tables as T
from ..functions import segment as S
from ..functions import wordlists as L
from ..plans.prefilter import matches
from . import messages, references
from .rewrites import OPEN, SHUT, SPANS, Rewrite, applied, cut, lookup, template
from .rules import At, Case, Segments, hit, only, rule

def of_surface(rows: list[tuple], surface: str) -> list[tuple]:
    """Rows of a table (surface, ...) that a surface (document, comment, message) reads."""
    return [r for r in rows if r[0] in ("both", surface)]


def filler_pattern(surface: str) -> str:
    words = sorted((w for _, w in of_surface(T.FILLERS, surface)), key=len, reverse=True)
    return rf"(?i){OPEN}(?:{'|'.join(map(re.escape, words))}){SHUT},?\s*".replace(r"\ ", r"\s+")


def filler_rewrites(surface: str = "document") -> tuple[Rewrite, ...]:
    return (cut(filler_pattern(surface)),)


def swap_rewrites(surface: str = "document") -> tuple[Rewrite, ...]:
    return (lookup({a: b for _, a, b in of_surface(T.SWAPS, surface)}),)


def tell_rewrites(rule_id: str) -> tuple[Rewrite, ...]:
    return tuple(template(p, instead, noun=True) for n, p, instead in T.TELLS if n == rule_id)


def without_fillers(text: Column, surface: str = "document") -> Column:
    """Words that a text can do without are cut; one that would leave a sentence without its end stays a word of it."""
    return applied(text, filler_rewrites(surface))


def with_short_phrases(text: Column, surface: str = "document") -> Column:
    """Every long phrase by its short one, in one pass."""
    return applied(text, swap_rewrites(surface))


def _unguarded(text: Column) -> Column:
    return F.regexp_replace(text, SPANS, " ")


def _of_blocks(b: At, pattern: str, what: str, fix: str) -> Column:
    each = F.regexp_extract_all(_unguarded(b.text), F.lit(f"({pattern})"), 1)
    return F.when(matches(b.text, pattern), F.transform(each, lambda h: b.here(what, F.btrim(h), fix)))


@rule("english/filler", "block", rewrites=filler_rewrites(), place=40, cases=(
    Case("inner", "It simply works.", want="It works."), Case("first", "Needless to say, it works.", want="It works."), Case("code", "It prints `simply` there.", False), Case("part", "It adjusts the rows.", False)))
def filler(b: At) -> Column:
    return _of_blocks(b, filler_pattern("document"), "a word that the sentence can do without", "Cut it.")


@rule("english/phrase", "block", rewrites=swap_rewrites(), place=41, cases=(Case("first", "In order to read it, wait.", want="To read it, wait."), Case("label", "See [prior to](x.md) there.", False)))
def phrase(b: At) -> Column:
    return _of_blocks(b, swap_rewrites()[0].pattern, "a long form of a short phrase", "Write the short form.")


@rule("english/flagged", "block", cases=(Case("somehow", "It somehow works twice."), Case("quoted", 'It prints "no longer" there.', False)))
def flagged(b: At) -> Column:
    pattern = rf"(?i)(?<!\w)(?:{'|'.join(re.escape(p) for p in T.FLAGGED)})(?!\w)".replace(r"\ ", r"\s+")
    return _of_blocks(b, pattern, "a phrase that hides what is the case", "Say what holds now.")


@rule("comments/vague", "document", cases=(Case("now", "x = 1\n// for now it waits"), Case("hack", "# a hack\nx"), Case("prose", "It waits for now.", False), Case("part", "// a hacker\nx", False)))
def vague_comment(d: At) -> Column:
    """Wording of comments about a state that is past or open; license notices are none."""
    pattern = rf"(?i){OPEN}(?:{'|'.join(re.escape(p) for p in T.VAGUE_COMMENTS)}){SHUT}".replace(r"\ ", r"\s+")
    free = F.filter(S.comment_runs_of(d.text), lambda r: ~K.is_license_notice(r["text"]))
    found = lambda r: F.transform(F.regexp_extract_all(_unguarded(r["text"]), F.lit(f"({pattern})"), 1), lambda h: hit(r["start_line"], r["end_line"], "a comment that hides what is the case", h, "Say what holds now."))
    return F.flatten(F.transform(free, found))


TELL_CASES = {
    "tombstones/date": (Case("since", "It runs since 2024-05-06 at night.", want="It runs at night."), Case("number", "It holds 2024 rows.", False)),
    "tombstones/change-reference": (Case("pull request", "It waits see PR 77 and goes on.", want="It waits and goes on."), Case("none", "It reads the issue list.", False)),
    "tombstones/then-and-now-contrast": (Case("former", "It reads keys instead of the former rows.", want="It reads keys."), Case("plain", "It reads keys instead of rows.", False)),
    "tombstones/position-reference": (Case("above", "As noted above, it waits.", want="It waits."), Case("plain", "It stands above.", False)),
    "tombstones/hedged-time": (Case("now", "For now it waits.", want="It waits."), Case("inner", "It currently waits.", want="It waits."), Case("plain", "It waits now.", False)),
    "tombstones/unstated-value": (Case("open", "The size is TBD here.", want="The size has no set value here."), Case("plain", "The size is set.", False)),
    "tombstones/shrug": (Case("reason", "For some reason it waits.", want="It waits."), Case("plain", "It waits for a reason.", False)),
    "tombstones/unexplained-workaround": (Case("hack", "A hack around the lock.", want="A workaround for the lock."), Case("plain", "It hacks a path.", False)),
}


def _register_tells() -> None:
    for rule_id, cases in TELL_CASES.items():
        pattern = "|".join(f"(?:{p.removeprefix('(?i)')})" for n, p, _ in T.TELLS if n == rule_id)
        # inner groups would be counted among those that are extracted
        pattern = "(?i)" + re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)
        find: Callable[[At], Column] = functools.partial(_of_blocks, pattern=pattern, what="wording about a state that is past or open", fix="Cut it.")
        rule(rule_id, "block", rewrites=tell_rewrites(rule_id), place=20, cases=cases)(find)


_register_tells()


def punts_of(text: Column) -> Column:
    """array<struct<line, sentence, kind>>: each distinct sentence of what a message asserts that puts work off, at its first line; a pardoned one is none."""
    def judged(s: Column, at: Column) -> Column:
        kind = F.coalesce(*(F.when(matches(s, p), F.lit(k)) for k, p in T.PUNTS))
        pardoned = functools.reduce(lambda a, b: a | b, (s.rlike(p) for p in T.PARDONS))
        return S.let(kind, lambda k: F.when(k.isNotNull() & ~pardoned, F.struct(at.alias("line"), s.alias("sentence"), k.alias("kind"))))

    of_line = lambda x, i: F.array_compact(F.transform(S.message_sentences_of(x), lambda s: judged(s, i + 1)))
    found = F.flatten(F.transform(S.lines_of(S.asserted_text(text)), of_line))
    return S.let(found, lambda xs: F.filter(xs, lambda x, i: F.array_position(xs["sentence"], x["sentence"]) == i + 1))


def punts(messages_: DataFrame) -> DataFrame:
    """doc_id, at_line, sentence, kind of messages(doc_id, text)."""
    return messages_.select("doc_id", F.explode(punts_of(F.col("text"))).alias("p")).select("doc_id", F.col("p.line").alias("at_line"), "p.sentence", "p.kind")


@rule("laziness/punt", "document", cases=(
    Case("scope", "The reader fails. That is out of scope."), Case("asks", "Shall I mend it?"), Case("pardoned", "It was out of scope, and I already fixed it.", False), Case("quoted", "> out of scope", False)))
def punt(d: At) -> Column:
    return F.transform(punts_of(d.text), lambda p: hit(p["line"], p["line"], F.concat(F.lit("a punt: "), p["kind"]), p["sentence"], "Do the work."))


@rule("blame/deflection", "document", cases=(Case("fault", "This is not my fault."), Case("fenced", "```\nnot my fault\n```", False)))
def deflection(d: At) -> Column:
    found = messages.phrases_of(d.text, L.BLAME_PHRASES)
    return F.transform(found, lambda h: hit(F.lit(1), F.lit(1), "work is deflected", h["phrase"], "Mend it, or say what hinders."))


@rule("ask/prose-decision", "document", cases=(Case("question", "Which of them should it be?"), Case("deferral", "That is up to you."), Case("plain", "It reads the rows.", False)))
def prose_decision(d: At) -> Column:
    made = lambda line, detail: hit(line, line, "a decision is handed to the reader", detail, "Decide, or ask in a form that takes an answer.")
    asked = F.transform(messages.questions_of(d.text), lambda q: made(q["line_no"], q["line"]))
    return F.concat(asked, F.transform(messages.phrases_of(d.text, L.DEFERRALS), lambda h: made(F.lit(1), h["phrase"])))


@rule("tombstones/comment-volume", "document", cases=(Case("fifteen", "// a\n" * 15 + "x = 1"), Case("blank between", "// a\n" * 8 + "\n" + "// b\n" * 7, True), Case("fourteen", "// a\n" * 14 + "x = 1", False)))
def comment_volume(d: At) -> Column:
    runs = long_comment_runs_of(d.text, d.limit("comment_lines", L.COMMENT_LINES))
    return F.transform(runs, lambda r: hit(r["start_line"], r["end_line"], F.concat(F.lit("a comment of lines: "), r["n_lines"].cast("string")), "", "Shorten it.", r["n_lines"]))


def long_comment_runs_of(text: Column, most: int) -> Column:
    """array<struct<start_line, end_line, n_lines>> of comments of over `most` lines; blank lines neither count nor end one, and a license notice is none."""
    mark = r"^\s*(//|#|--)"

    def step(state: Column, x: Column) -> Column:
        n, kind = state["n"], x["kind"]
        start = F.when((kind == "c") & (n == 0), x["at"]).otherwise(state["start"])
        closed = F.when((kind == "x") & (n > most), F.array_append(state["runs"], F.struct(state["start"].alias("start_line"), state["last"].alias("end_line"), n.alias("n_lines")))).otherwise(state["runs"])
        return F.struct(
            closed.alias("runs"), F.when(kind == "c", n + 1).when(kind == "x", 0).otherwise(n).alias("n"), start.alias("start"),
            F.when(kind == "c", x["at"]).otherwise(state["last"]).alias("last"),
        )

    begun = F.struct(F.array().cast("array<struct<start_line: int, end_line: int, n_lines: int>>").alias("runs"), F.lit(0).alias("n"), F.lit(0).alias("start"), F.lit(0).alias("last"))
    kind = lambda x: F.when(K.is_license_notice(x), "x").when(x.rlike(mark), "c").when(x.rlike(r"^\s*$"), "b").otherwise("x")
    # an end mark closes the last run
    kinds = F.transform(F.concat(S.lines_of(text), F.array(F.lit("."))), lambda x, i: F.struct(kind(x).alias("kind"), (i + 1).alias("at")))
    return F.when(text.rlike(r"(?m)^\s*(//|#|--)"), F.aggregate(kinds, begun, step, lambda st: st["runs"]))


def long_comment_runs(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, start_line, end_line, n_lines of comments of over `most` lines."""
    return docs.select("doc_id", F.explode(long_comment_runs_of(F.col("text"), most)).alias("r")).select("doc_id", "r.*")


@rule("pins/download-version", "document", repair=lambda text: F.regexp_replace(text, r"(https?://[^\s<>\"')\]]*?)\?v=[^\s&#<>\"')\]]*(?=$|[\s<>\"')\]#])", "$1"), place=1000, cases=(
    Case("pinned", "get https://x.org/tool?v=1.2 now", want="get https://x.org/tool now"), Case("other", "get https://x.org/tool?w=1.2 now", False)))
def pinned_download(d: At) -> Column:
    urls = lambda x: F.regexp_extract_all(x, F.lit(r"(https?://[^\s<>\"')\]]+)"), 1)
    pinned = lambda x: F.filter(urls(x), lambda u: references.query_parameter(u, "v").isNotNull())
    found = lambda x, i: F.when(F.contains(x, F.lit("?")), F.transform(pinned(x), lambda u: hit(i + 1, i + 1, "a download that names its version", u, "Drop the version.")))
    return F.when(F.contains(d.text, F.lit("?")), F.flatten(F.array_compact(F.transform(S.lines_of(d.text), found))))


def unapproved_words(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, start_line, end_line, word, approved: words of prose that dictionary(word, approved array<string>) does not approve.

    Words in capitals are names and stand; so does a capitalised word inside a sentence.
    """
    tokens = Segments(docs).tokens
    name = F.col("word").rlike("^[A-Z]{2,}$") | ((F.col("pos") > 0) & F.col("word").rlike("^[A-Z]"))
    listed = dictionary.select(F.lower("word").alias("lower"), "approved").dropDuplicates(["lower"])
    return tokens.where(~name).join(listed, "lower").select("doc_id", "start_line", "end_line", "word", "approved")
