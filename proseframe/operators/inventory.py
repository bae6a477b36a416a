"""Enumerations: sentences, lists and tables that name what is there and say nothing about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import segment as S
from .rules import At, Case, hit, rule

MARK = "□"
#: Members of an enumeration are code spans, paths, file names, flags and identifiers.
MEMBER = r"`[^`]+`|[\w.-]+/[\w./-]+|\w[\w-]*\.[a-z]{1,5}|--?[a-z][\w-]+|[A-Za-z]+_\w+|[a-z]+[A-Z]\w*"
#: Begun at the edge of a word alone, or a long word would be read from each of its letters.
HOLDS_MEMBER = rf"(?<![\w./-])(?:{MEMBER})"
TOKEN = r"`[^`]+`[.,;:!?]*|\S+"
DETERMINERS, JOINERS = "a an the each every this these those any".split(), "and or plus &".split()
#: So many members, or sentences of one frame, or rows of names in a row, are an enumeration.
LEAST = 3


def tokens_of(text: Column) -> Column:
    """What white space divides, with code spans in one piece."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, r"^[(\[\"'*_]+|[.,;:!?)\]\"'*_]+$", "")


def is_member(token: Column, member: str = MEMBER) -> Column:
    return _bare(token).rlike(rf"^(?:{member})$")


def frame_key(sentence: Column, member: str = MEMBER) -> Column:
    """A sentence in lower case with each member as one mark; null where it names none.

    Sentences with one key differ only in what they name, so a run of them is an enumeration.
    """
    def of(ts: Column) -> Column:
        words = F.transform(ts, lambda t: F.when(is_member(t, member), F.lit(MARK)).otherwise(F.lower(_bare(t))))
        return F.when(F.exists(ts, lambda t: is_member(t, member)), F.array_join(words, " "))

    return S.let(tokens_of(sentence), of)


def equal_runs(keys: Column, least: int = LEAST) -> Column:
    """array<struct<start, n, key>> of runs of at least `least` equal keys that follow one another; places count from 0, nulls end a run."""
    def of(ks: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ks) - 1)
        starts = F.filter(places, lambda i: (i == 0) | ~F.get(ks, i).eqNullSafe(F.get(ks, i - 1)))

        def runs(ss: Column) -> Column:
            run = lambda s, k: F.struct(s.alias("start"), (F.coalesce(F.get(ss, k + 1), F.size(ks)) - s).alias("n"), F.get(ks, s).alias("key"))
            return F.filter(F.transform(ss, run), lambda r: (r["n"] >= least) & r["key"].isNotNull())

        return F.when(F.size(ks) >= least, S.let(starts, runs)).otherwise(F.array().cast("array<struct<start: int, n: int, key: string>>"))

    return S.let(keys, of)


def members_in_a_row(sentence: Column) -> Column:
    """The number of members of the longest list in a sentence: members divided by commas, with `and` or `or` before the last."""
    def letter(t: Column) -> Column:
        member = is_member(t)
        return (
            F.when(member & t.rlike(r",[)\"'*_]*$"), "c").when(member & ~t.rlike(r"[.;:!?]$"), "m").when(member, "e")
            .when(F.lower(t).isin(JOINERS), "j").when(F.lower(t).isin(DETERMINERS), "d").otherwise("x")
        )

    letters = F.array_join(F.transform(tokens_of(sentence), letter), "")
    lists = F.regexp_extract_all(letters, F.lit(r"((?:d?c)+(?:d?mj|j)?d?[cme])"), 1)
    return F.coalesce(F.array_max(F.transform(lists, lambda x: F.length(F.regexp_replace(x, "[jd]", "")))), F.lit(0))


def names_only(text: Column) -> Column:
    """How many members a text names, if it says nothing about them but for one short label in parentheses; else 0."""
    plain = F.regexp_replace(text, r"^([^(]*)\(\s*[^()\s`]+(?:\s+[^()\s`]+){0,2}\s*\)([^(]*)$", "$1 $2")

    def of(ts: Column) -> Column:
        silent = lambda t: F.lower(_bare(t)).isin(JOINERS) | ~t.rlike(r"[\p{L}\p{N}]")
        return F.when(F.forall(ts, lambda t: is_member(t) | silent(t)), F.size(F.filter(ts, lambda t: is_member(t)))).otherwise(0)

    return S.let(tokens_of(plain), of)


def listed_names(line: Column) -> Column:
    """Members of a list item or of the cells of a table row that name and say nothing; 0 for any other line, null for the rule under a table's head."""
    item = F.regexp_replace(line, S.LIST_MARKER, "")
    cells = F.split(F.regexp_replace(line, r"^\s*\||\|\s*$", ""), r"\|", -1)
    counts = lambda cs: F.when(F.forall(cs, lambda c: names_only(c) > 0), F.size(cs)).otherwise(0)
    return (
        F.when(line.rlike(r"^[\s|:-]*-[\s|:-]*$") & F.contains(line, F.lit("|")), F.lit(None).cast("int"))
        .when(line.rlike(r"^\s*\|.*\|\s*$"), counts(cells)).when(line.rlike(S.LIST_MARKER), names_only(item)).otherwise(0)
    )


@rule("counts/inventory-list", "block", cases=(
    Case("names", "The commands are `check`, `hook`, `lsp` and `help`."), Case("frame", "The tool reads `a`. The tool reads `b`. The tool reads `c`."), Case("files", "I changed a.go, b.go, and c.go."),
    Case("two", "It reads `a` and `b`.", False), Case("statements", "The `a` reads. The `b` writes. The `c` waits.", False), Case("words", "It reads rows, keys, and files.", False)))
def inventory_list(b: At) -> Column:
    """Sentences that list members, and runs of sentences that differ in one member alone."""
    sentences = S.sentences_of(b.text)
    fix = "Say what they have in common, or leave the list to the code."

    def of(ss: Column) -> Column:
        counted = F.transform(ss, lambda s: F.struct(s.alias("s"), members_in_a_row(s).alias("n")))
        lists = F.transform(F.filter(counted, lambda c: c["n"] >= LEAST), lambda c: b.here("a list of names", c["s"], fix, c["n"]))
        runs = F.transform(equal_runs(F.transform(ss, lambda s: frame_key(s))), lambda r: b.here("sentences that differ in a name alone", F.get(ss, r["start"]), fix, r["n"]))
        return F.concat(lists, runs)

    return F.when(b.text.rlike(HOLDS_MEMBER), S.let(sentences, of))


@rule("counts/inventory-rows", "document", cases=(
    Case("items", "- `a`\n- `b` (old)\n- `c` and `d`"), Case("table", "| Name | Kind |\n|---|---|\n| `a` | `b` |\n| `c` | `d` |\n| `e` | `f` |"),
    Case("described", "- `a` reads\n- `b` writes\n- `c` waits", False), Case("two", "- `a`\n- `b`", False), Case("fence", "```\n- `a`\n- `b`\n- `c`\n```", False)))
def inventory_rows(d: At) -> Column:
    """Runs of list items or table rows that hold names alone; code fences are content."""
    def of(ls: Column) -> Column:
        keys = F.zip_with(ls, S.fenced_mask(ls), lambda x, fenced: F.when(~fenced & (F.coalesce(listed_names(x), F.lit(0)) > 0), F.lit("names")))
        made = lambda r: hit(r["start"] + 1, r["start"] + r["n"], "rows that name and say nothing", F.get(ls, r["start"]), "Say what each does, or leave the list to the code.", r["n"])
        return F.transform(equal_runs(keys), made)

    return F.when(d.text.rlike(HOLDS_MEMBER) & d.text.rlike(r"(?m)^\s*([-*+|]|[0-9]+[.)])"), S.let(S.lines_of(d.text), of))
