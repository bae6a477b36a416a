"""Guarded rewrites of texts: all selected ones in one pass, repeated inside the row until nothing changes."""

from __future__ import annotations

import dataclasses
import itertools
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import segment as S
from ..functions import wordlists as L
from ..plans.prefilter import holds_any, needed_literals

GUARDED, MATCH = "\u0001", "\u0002"
#: What no rewrite reads: code spans, quotations, labels of links.
SPANS = r"(`+[^`]+`+|\"[^\"\n]*\"|“[^”\n]*”|\[[^\]\n]*\](?=\())"
#: A sentence ends at these, unless they stand inside a name or number.
SENTENCE_END = r"[.!?](?!\w)"
#: The edges of a word, accented ones too.
OPEN, SHUT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
NEGATION = r"(?i)(?<![A-Za-z0-9_])(?<!whether or )(?:not|no|never|none|nothing|cannot|[a-z]+n['’]t)(?![A-Za-z0-9_])"


@dataclass(frozen=True)
class Rewrite:
    """What replaces each match of a pattern; `noun` says that a cut takes the object of what stands before it.

    `behind` is what has to stand before the pattern, as a look-behind; `near` is one that asks less of
    it, of a single character, and is tried first. `holds`: a pattern that costs little, and that stands in
    every text, given in lower case, in which the rewrite's does, where the pattern's own literals say too little.
    """

    pattern: str
    instead: Callable[[Column], Column]
    noun: bool = False
    behind: str = ""
    near: str = ""
    holds: str = ""

    @property
    def plain(self) -> str:
        """The pattern as part of an alternation: its own flag, and no group that counts.

        A look-behind of many words costs at every place of a text, so it comes after a look at the pattern itself.
        """
        inner = re.sub(r"(?<!\\)\((?!\?)", "(?:", self.pattern)
        flag, inner = ("?i:", inner[4:]) if inner.startswith("(?i)") else ("?:", inner)
        return f"({flag}{self.near}(?={inner}){self.behind}{inner})" if self.behind else f"({flag}{inner})"

    @property
    def alone(self) -> str:
        """What a match is by itself, without what stands before it."""
        return dataclasses.replace(self, behind="").plain

    @property
    def needs(self) -> str | tuple[str, ...]:
        """What stands in every text with a match: `holds`, or literals of the pattern."""
        return self.holds or tuple(needed_literals(self.pattern) or ())

    def may_stand(self, folded: Column) -> Column:
        """Whether a text, given in lower case, holds what every match needs; true where that is not known."""
        if isinstance(self.needs, str):
            return folded.rlike(self.needs)
        return holds_any(folded, self.needs) if self.needs else F.lit(True)


def cut(pattern: str, noun: bool = False) -> Rewrite:
    return Rewrite(pattern, lambda was: F.lit(""), noun)


def template(pattern: str, instead: str, noun: bool = False) -> Rewrite:
    """`instead` may name groups of the pattern as $1, $2."""
    return Rewrite(pattern, lambda was: F.regexp_replace(was, pattern, instead), noun)


def lookup(table: dict[str, str]) -> Rewrite:
    """Whole phrases by a table in lower case; any white space stands for a blank."""
    phrases = sorted(table, key=len, reverse=True)
    pattern = rf"(?i){OPEN}(?:{'|'.join(map(re.escape, phrases))}){SHUT}".replace(r"\ ", r"\s+")
    entries = lambda: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return Rewrite(pattern, lambda was: F.element_at(entries(), F.lower(F.regexp_replace(was, r"\s+", " "))))


def keeps_negation(before: Column, after: Column) -> Column:
    """A rewrite loses no negation."""
    return F.regexp_count(after, F.lit(NEGATION)) >= F.regexp_count(before, F.lit(NEGATION))


def _any_word(text: Column, names: Sequence[str]) -> Column:
    words = sorted({w for n in names for w in L.class_words(n)})
    return text.rlike(rf"(?i)(?<![A-Za-z])(?:{'|'.join(words)})(?![A-Za-z])")


def _upper_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))


def _leaves_a_sentence(rewrite_is_noun: Column, lead: Column, was: Column, rest: Column, more: Column) -> Column:
    """What stands before a cut and after it still makes a sentence, by closed word classes.

    Something has to be left; a verb is not lost with the cut; no preposition or article loses its
    word, and no auxiliary what it says of its subject. `more`: the sentence goes on across a guarded span.
    """
    last = F.lower(F.regexp_extract(lead, r"([A-Za-z']+)\s*$", 1))
    followed = rest.rlike(r"^\s*[\w\"'(\[§]") | more
    opens = last.isin(sorted({*L.class_words("preposition"), *L.class_words("article")}))
    links = last.isin(sorted({*L.class_words("auxiliary"), *L.class_words("conjunction"), *L.class_words("determiner")}))
    both = F.concat_ws(" ", lead, rest)
    verb = ["finite-verb", "auxiliary"]
    return (
        (both.rlike(r"\p{L}") | more)
        & (~_any_word(was, verb) | _any_word(both, verb) | more)
        & ~(opens & (rewrite_is_noun | ~followed)) & ~(links & ~followed)
    )


def _which(rewrites: Sequence[Rewrite], was: Column, at: int = 0) -> Column:
    """The number of the first rewrite that the whole of `was` matches, by halves; null if none does."""
    if len(rewrites) == 1:
        return F.when(was.rlike(rf"^{rewrites[0].alone}\z"), F.lit(at))
    n = len(rewrites) // 2
    any_of = "|".join(r.alone for r in rewrites[:n])
    first = F.lit(at) if n == 1 else _which(rewrites[:n], was, at)
    return F.when(was.rlike(rf"^(?:{any_of})\z"), first).otherwise(_which(rewrites[n:], was, at + n))


def _now(rewrites: Sequence[Rewrite], was: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body(number of the rewrite that a match is one of, what that makes of it)."""

    def of(k: Column) -> Column:
        return S.let(F.coalesce(*(F.when(k == n, r.instead(was)) for n, r in enumerate(rewrites)), was), lambda now: body(k, now))

    return S.let(_which(rewrites, was), of)


_HAS_WORD = r"[\p{L}\p{N}]"


def _plain(rewrites: Sequence[Rewrite], was: Column) -> Column:
    """What a match becomes where that hangs on nothing around it; null for cuts, and for those that stay as they are."""

    def of(_: Column, now: Column) -> Column:
        shouted = was.rlike(r"^\P{L}*\p{Lu}\P{Ll}*\p{Lu}\P{Ll}*$")
        kept = F.when(shouted, F.upper(now)).when(was.rlike(r"^\P{L}*\p{Lu}") & now.rlike(r"^\p{Ll}"), _upper_first(now)).otherwise(now)
        return F.when(now.rlike(_HAS_WORD) & keeps_negation(was, now), F.nullif(kept, was))

    return _now(rewrites, was, of)


def _cut(rewrites: Sequence[Rewrite], was: Column, before: Column, after: Column, comes_from: Column, goes_on: Column) -> Column:
    """What a match that `_plain` leaves open becomes: struct(text, begins, kept), begins if it was a cut at the start of a sentence.

    comes_from and goes_on: something else of the text stands before `before`, and after `after`.
    """

    def of(k: Column, now: Column) -> Column:
        is_cut = ~now.rlike(_HAS_WORD)
        stop = F.regexp_extract(was, r"([.!?]?)$", 1)  # a cut keeps the end of the sentence
        ended = before.rlike(SENTENCE_END)
        lead = F.regexp_replace(before, rf"(?s)^.*{SENTENCE_END}", "")
        rest = F.when(stop != "", "").otherwise(F.regexp_extract(after, r"^(?:[^.!?\n]|[.!?](?=\w))*", 0))
        more = (goes_on & (rest == after) & (stop == "")) | (comes_from & ~ended)
        noun = F.coalesce(*(F.when(k == n, F.lit(r.noun)) for n, r in enumerate(rewrites)), F.lit(False))
        fine = is_cut & keeps_negation(was, now) & _leaves_a_sentence(noun, lead, was, rest, more)
        begins = ~lead.rlike(r"\S") & (ended | ~comes_from) & was.rlike(r"^\P{L}*\p{Lu}")
        to = F.when(now.rlike(r"\S"), now).otherwise(stop)
        made = lambda to: F.struct(to.alias("text"), begins.alias("begins"), (to == was).alias("kept"))
        return F.when(fine, S.let(to, made)).otherwise(F.struct(was.alias("text"), F.lit(False).alias("begins"), F.lit(True).alias("kept")))

    return _now(rewrites, was, of)


def _chain(rewrites: Sequence[Rewrite], plain: Column, parts: Column, s: Column, e: Column, first: Column, last: Column) -> Column:
    """What the matches at s, s + 2, ..., e, with nothing but blanks between them, become: struct(text, begins, kept).

    They are decided from left to right, so that each knows what stands before it. Behind one that stays
    as it is, the others stay too. `plain` maps matches to what they become by themselves.
    """
    made = lambda text, begins, kept: F.struct(text.alias("text"), begins.alias("begins"), kept.alias("kept"))

    def step(state: Column, i: Column) -> Column:
        part = lambda at: F.get(parts, at)
        was = F.when(state["begins"], _upper_first(F.ltrim(part(i)))).otherwise(part(i))
        so_far = F.when((i == s) | state["begins"], state["text"]).otherwise(F.concat(state["text"], part(i - 1)))

        def of(was: Column, so_far: Column) -> Column:
            by_itself = F.when(state["begins"], _plain(rewrites, was)).otherwise(F.element_at(plain, was))
            in_place = _cut(rewrites, was, F.concat(part(s - 1), so_far), part(i + 1), ~first | (s > 1), ~last | (i < F.size(parts) - 2))
            found = lambda p: F.when(p.isNotNull(), made(p, F.lit(False), F.lit(False))).otherwise(in_place)
            joined = lambda d: made(F.concat(so_far, d["text"]), d["begins"], d["kept"])
            return F.when(state["kept"], made(F.concat(so_far, was), F.lit(False), F.lit(True))).otherwise(S.let(by_itself, lambda p: S.let(found(p), joined)))

        return S.let(was, lambda w: S.let(so_far, lambda t: of(w, t)))

    return F.aggregate(F.sequence(s, e, F.lit(2)), made(F.lit(""), F.lit(False), F.lit(False)), step)


def applied(text: Column, rewrites: Sequence[Rewrite]) -> Column:
    """A text after one pass of rewrites; where several match, the first of them does.

    None reads code spans, quotations and link labels, nor begins or ends at the hyphen of a
    compound, nor reaches across a guarded span. A capital at the start of a match passes to what
    replaces it, or, where a cut began a sentence, to the next word; a match in capitals is replaced in
    capitals. A rewrite that would lose a negation, and a cut that would leave no sentence, are not made.
    """

    def of_piece(piece: Column, whole: Column, first: Column, last: Column) -> Column:
        marked = F.regexp_replace(piece, F.concat(F.lit(r"(?<!\w-)("), whole, F.lit(r")(?!-\w)")), F.lit(MATCH + "$1" + MATCH))

        def chains(ps: Column, plain: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(ps) - 2, F.lit(2)), lambda i: (i == 1) | F.get(ps, i - 1).rlike(r"\S"))
            behind = lambda begins, p: F.when(begins, _upper_first(F.ltrim(p))).otherwise(p)
            of_chain = lambda s, e: S.let(_chain(rewrites, plain, ps, s, e, first, last), lambda d: F.concat(d["text"], behind(d["begins"], F.get(ps, e + 1))))

            def decided(at: Column) -> Column:
                end = lambda k: F.coalesce(F.get(at, k + 1), F.size(ps)) - 2
                return F.transform(at, lambda s, k: S.let(end(k), lambda e: of_chain(s, e)))

            return S.let(starts, lambda at: F.concat(F.get(ps, F.lit(0)), F.array_join(decided(at), "")))

        def rewritten(ps: Column) -> Column:
            # equal matches are decided once; where all hang on themselves alone, their places do not matter
            found = F.array_distinct(F.filter(ps, lambda p, i: i % 2 == 1))
            plain = S.let(found, lambda ws: F.map_from_arrays(ws, F.transform(ws, lambda w: _plain(rewrites, w))))
            each = lambda m: F.array_join(F.transform(ps, lambda p, i: F.when(i % 2 == 1, F.element_at(m, p)).otherwise(p)), "")
            return S.let(plain, lambda m: F.when(F.exists(F.map_values(m), F.isnull), chains(ps, m)).otherwise(each(m)))

        return S.let(F.split(marked, MATCH, -1), lambda ps: F.when(F.size(ps) > 1, rewritten(ps)).otherwise(piece))

    def mended(text: Column, whole: Column) -> Column:
        pieces = F.split(F.regexp_replace(text, SPANS, GUARDED + "$1" + GUARDED), GUARDED, -1)
        own = lambda ps: F.transform(ps, lambda p, k: F.when(k % 2 == 0, of_piece(p, whole, k == 0, k == F.size(ps) - 1)).otherwise(p))
        return S.let(pieces, lambda ps: F.array_join(own(ps), ""))

    def patterns(text: Column) -> Column:
        """Those of the rewrites that may stand in a text, as one; the empty string if none may."""
        alike = [list(g) for _, g in itertools.groupby(rewrites, lambda r: r.needs)]
        return S.let(F.lower(text), lambda low: F.concat_ws("|", *(F.when(g[0].may_stand(low), F.lit("|".join(r.plain for r in g))) for g in alike)))

    # texts that hold the marks themselves are left as they are
    marks = lambda t: F.contains(t, F.lit(GUARDED)) | F.contains(t, F.lit(MATCH))
    return S.let(text, lambda t: S.let(patterns(t), lambda whole: F.when((whole == "") | marks(t) | ~F.rlike(t, whole), t).otherwise(mended(t, whole))))


def pass_of(rewrites: Sequence[Rewrite]) -> Callable[[Column], Column]:
    """The pass as a function of a text."""
    return lambda text: applied(text, rewrites)


def settled(text: Column, once: Callable[[Column], Column], rounds: int) -> Column:
    """once applied to a text again and again until it changes nothing, at most `rounds` times; the plan holds it once."""
    state = lambda t, done: F.struct(t.alias("text"), done.alias("done"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(S.let(once(s["text"]), lambda new: state(new, new == s["text"])))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state(text, F.lit(False)), step, lambda s: s["text"])
