"""Matches over word classes: what stands in a slot is named by class, where a pattern over letters has no way to say it."""

from __future__ import annotations

import functools
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segment as S
from ..functions import wordlists as L

#: Letters stand for words, from here on; a match may have so many different terms.
FIRST_LETTER, MOST_TERMS = 0x4E00, 12
FOUND, GROUP, END, PAUSE = "\u0001", "\u0002", "\u0003", "\u0004"


@dataclass(frozen=True)
class WordClass:
    """Words of one slot: listed, by their endings, digits alone, or any word that no class lists and `barred` classes do not hold."""

    words: tuple[str, ...] = ()
    endings: tuple[str, ...] = ()
    digits: bool = False
    open: bool = False
    barred: tuple[str, ...] = ()


Lexicon = Mapping[str, WordClass]


def closed_lexicon() -> dict[str, WordClass]:
    """The closed classes of the word lists; `open` is every other word."""
    return {name: WordClass(tuple(L.class_words(name))) for name in L.CLASSES} | {"open": WordClass(open=True), "number": WordClass(digits=True)}


@dataclass(frozen=True)
class Term:
    """One place of a match: a word, or any of `classes` that is in all of `also` too; `many` takes as many as fit, none included."""

    word: str = ""
    classes: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    name: str = ""
    many: bool = False


def parse_match(match: str, lexicon: Lexicon) -> tuple[Term, ...]:
    """The terms of a match: {class}, {a|b}, {a+b}, {class:name}, {class*:name} and bare words. A malformed one and an unknown class are errors."""
    terms = []
    for field in match.split():
        if not field.startswith("{"):
            terms.append(Term(word=field))
            continue
        inner, _, name = field[1:-1].partition(":")
        many = inner.endswith("*")
        either, *also = inner.removesuffix("*").split("+")
        classes = either.split("|")
        if not field.endswith("}") or not all(classes) or not all(also):
            raise ValueError(f"the term {field!r} is malformed")
        if unknown := [c for c in [*classes, *also] if c not in lexicon]:
            raise ValueError(f"the term {field!r} names no known class: {', '.join(unknown)}")
        terms.append(Term("", tuple(classes), tuple(also), name, many))
    if not terms or all(t.many for t in terms):
        raise ValueError(f"the match {match!r} has no term that takes a word")
    if len(set(terms)) > MOST_TERMS:
        raise ValueError(f"the match {match!r} has over {MOST_TERMS} different terms")
    return tuple(terms)


def in_class(word: Column, name: str, lexicon: Lexicon) -> Column:
    """Whether a word in lower case belongs to a class."""
    c = lexicon[name]
    listed = sorted({w for x in lexicon.values() for w in x.words})
    tests = [word.isin([w.lower() for w in c.words])] if c.words else []
    tests += [word.endswith(e) & (F.length(word) > len(e)) for e in c.endings]
    if c.digits:
        tests.append(word.rlike("^[0-9]+$"))
    if c.open:
        barred = [in_class(word, b, lexicon) for b in c.barred]
        tests.append(functools.reduce(lambda a, b: a & ~b, barred, ~word.isin(listed) if listed else F.lit(True)))
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


def _fits(term: Term, word: Column, lexicon: Lexicon, sensitive: bool) -> Column:
    if term.word:
        return word == term.word if sensitive else F.lower(word) == term.word.lower()
    lower = F.lower(word)
    any_of = functools.reduce(lambda a, b: a | b, (in_class(lower, c, lexicon) for c in term.classes))
    return functools.reduce(lambda a, b: a & b, (in_class(lower, c, lexicon) for c in term.also), any_of)


def _marked(words: Column, pauses: Column | None, terms: tuple[Term, ...], lexicon: Lexicon, sensitive: bool) -> Column:
    """The sentence as letters, one for each word by which terms it fits, with every match marked and its terms set apart."""
    kinds = list(dict.fromkeys(Term(t.word, t.classes, t.also) for t in terms))
    bits = lambda w: functools.reduce(lambda a, b: a + b, (F.when(_fits(t, w, lexicon, sensitive), F.lit(1 << k)).otherwise(F.lit(0)) for k, t in enumerate(kinds)))
    # a character by its code; char() takes only those of one byte
    alphabet = F.lit("".join(chr(FIRST_LETTER + k) for k in range(1 << len(kinds))))
    letter = lambda w: F.substring(alphabet, bits(w) + 1, F.lit(1))
    lead = lambda i: F.when(F.get(pauses, i), F.lit(PAUSE)).otherwise(F.lit("")) if pauses is not None else F.lit("")
    text = F.array_join(F.transform(words, lambda w, i: F.concat(lead(i), letter(w))), "")
    klass = lambda t: "[" + "".join(chr(FIRST_LETTER + x) for x in range(1 << len(kinds)) if x >> kinds.index(Term(t.word, t.classes, t.also)) & 1) + "]"
    pattern = "".join(f"({klass(t)}{'*+' if t.many else ''})" for t in terms)
    return F.regexp_replace(text, pattern, FOUND + GROUP.join(f"${k + 1}" for k in range(len(terms))) + END)


def matched(words: Column, match: str, lexicon: Lexicon, sensitive: bool = False, pauses: Column | None = None) -> Column:
    """array<struct<start, end, captures>> of the matches in an array of words, from the left, none over another.

    Places count from 0, `end` is behind the last word, `captures` maps each name to the words that
    its term took, as they are written. A term with * takes all words that fit and gives none back. A
    literal ignores case unless `sensitive`; classes always do. `pauses` says of each word whether no match
    reaches across what stands before it.
    """
    terms = parse_match(match, lexicon)
    size = lambda s: F.length(F.translate(s, PAUSE + GROUP, ""))

    def of_parts(ws: Column, parts: Column) -> Column:
        def step(state: Column, part: Column) -> Column:
            is_match = F.size(state["sizes"]) % 2 == 1
            groups = F.transform(F.split(part, GROUP, -1), F.length)
            start, end = state["at"], state["at"] + size(part)
            before = lambda k: F.aggregate(F.slice(groups, 1, k), start, lambda a, b: a + b)
            names = [(k, t.name) for k, t in enumerate(terms) if t.name]
            entries = [x for k, n in names for x in (F.lit(n), F.array_join(F.slice(ws, before(F.lit(k)) + 1, F.get(groups, F.lit(k))), " "))]
            captures = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
            found = F.struct(start.alias("start"), end.alias("end"), captures.alias("captures"))
            return F.struct(
                end.alias("at"), F.array_append(state["sizes"], end).alias("sizes"),
                F.when(is_match, F.array_append(state["found"], found)).otherwise(state["found"]).alias("found"),
            )

        begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sizes"), F.array().cast("array<struct<start: int, end: int, captures: map<string, string>>>").alias("found"))
        return F.aggregate(parts, begun, step, lambda s: s["found"])

    return S.let(words, lambda ws: of_parts(ws, F.split(_marked(ws, pauses, terms, lexicon, sensitive), f"[{FOUND}{END}]", -1)))


def class_matches(sentences: DataFrame, lexicon: Lexicon, matches: Mapping[str, str], text: str = "sentence") -> DataFrame:
    """The columns of sentences with match_id, start, end, captures and phrase of each match in their words; words are those of segment.words_of."""
    rows = sentences.withColumn("_words", S.words_of(F.col(text)))
    named = lambda k: lambda x: F.struct(F.lit(k).alias("id"), x.alias("m"))
    each = F.concat(*(F.transform(matched(F.col("_words"), m, lexicon), named(k)) for k, m in matches.items()))
    rows = rows.withColumn("_m", F.explode(each))
    phrase = F.array_join(F.slice("_words", F.col("_m.m.start") + 1, F.col("_m.m.end") - F.col("_m.m.start")), " ")
    return rows.select(*sentences.columns, F.col("_m.id").alias("match_id"), "_m.m.start", "_m.m.end", "_m.m.captures", phrase.alias("phrase"))


def rephrased(text: Column, match: str, instead: str, lexicon: Lexicon) -> Column:
    """A text with each match replaced; `instead` names captures as {name}, and a name that caught nothing writes nothing.

    A match does not reach across a mark between words. A capital at its start passes on.
    """
    terms = parse_match(match, lexicon)
    parts = instead.split()
    names = {t.name for t in terms if t.name}
    if unknown := [p for p in parts if p.startswith("{") and p[1:-1] not in names]:
        raise ValueError(f"the replacement writes {', '.join(unknown)}, which no term captures")

    def of(ws: Column, gaps: Column) -> Column:
        pauses = F.transform(ws, lambda w, i: ~F.get(gaps, i).rlike(r"^\s+$") & (i > 0))

        def replaced(found: Column) -> Column:
            def written(m: Column) -> Column:
                said = F.array(*(F.element_at(m["captures"], p[1:-1]) if p.startswith("{") else F.lit(p) for p in parts)) if parts else F.array().cast("array<string>")
                new = F.array_join(F.filter(said, lambda x: x != ""), " ")
                capital = F.get(ws, m["start"]).rlike(r"^\p{Lu}")
                return F.when(capital, F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)

            def word_at(w: Column, i: Column) -> Column:
                own = F.get(F.filter(found, lambda m: (m["start"] <= i) & (i < m["end"])), F.lit(0))
                plain = F.concat(F.get(gaps, i), w)
                # a match is written at its first word; with nothing to write, the blank before goes as well
                return S.let(own, lambda m: F.when(m.isNull(), plain).when(m["start"] < i, F.lit("")).otherwise(
                    S.let(written(m), lambda new: F.when(new == "", F.rtrim(F.get(gaps, i))).otherwise(F.concat(F.get(gaps, i), new)))))

            whole = F.concat(F.array_join(F.transform(ws, word_at), ""), F.element_at(gaps, -1))
            return F.when(F.size(found) > 0, whole)

        return S.let(matched(ws, match, lexicon, pauses=pauses), replaced)

    made = S.let(S.words_of(text), lambda ws: S.let(F.split(text, S.WORD, -1), lambda gaps: of(ws, gaps)))
    return F.coalesce(made, text)
