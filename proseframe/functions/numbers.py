"""Numbers that texts state: where they stand, what they count, and what makes one no count."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .segment import let
from .wordlists import class_words

# Number words of each kind of text, and what they are worth.
UNITS = "two three four five six seven eight nine ten eleven twelve"
TEENS = "thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
TENS = "twenty thirty forty fifty sixty seventy eighty ninety"
SCALES = {"dozen": 12, "hundred": 100, "thousand": 1000, "million": 10**6, "billion": 10**9, "trillion": 10**12}
WORD_VALUES = {w: n for n, w in enumerate((UNITS + " " + TEENS).split(), 2)} | {w: 10 * n for n, w in enumerate(TENS.split(), 2)} | SCALES
# Words that frame a count of what is there.
FRAMING = (
    "has have had hold holds ship ships carries carry contain contains cover covers include includes list lists define defines register registers install installs "
    "answer answers serve serves provide provides expose exposes declare declares embed embeds bundle bundles comprise comprises span spans measure measures measured "
    "take takes took cost costs need needs use uses used finish finishes"
)
DURATIVE, DURATION, EXISTENCE, DEICTIC = "run runs complete completes finish finishes", "in for", "are were", "below above here"
HEDGES = "only just exactly all about roughly around under over"
# Words around a number that make it a name, a status or a measure.
LABELS = "http migration migrations rfc pr issue version release port revision pid section".split()
STATUS_NOUNS = (
    "response responses reply replies answer answers status statuses code codes error errors redirect redirects ok created accepted conflict forbidden unauthorized gone found"
).split()
EXIT_WORDS = "exit exits exited status errno signal".split()
SINGULAR_VERBS = "is was has does fits equals".split()
GAP_WORDS = "of the a an in on to for and or is are was were that this with from by at as but if so than then when while not no it its".split()
CHOOSERS = "one either neither any each none both all".split()
#: Words that end in s and are no plural noun.
NO_PLURALS = sorted({*"is was has does this its as us thus always perhaps plus less unless across towards yes his hers".split(), *(w for w in class_words("finite-verb") if w.endswith("s"))})

# What may stand in front of a number, by what it makes of it.
APPROXIMATIONS = "about roughly around approximately nearly almost only just exactly some precisely".split()
RATES = "every each per".split()
CEILINGS = ["at most", "up to", "no more than", "fewer than", "less than", "not more than", "under", "below", "within", "max", "maximum"]
FLOORS = ["at least", "no fewer than", "no less than", "not less than"]
FLOORS_ABOVE = ["more than"]
MEASURES = (
    "seconds minutes hours days weeks months years milliseconds bits bytes kilobytes megabytes gigabytes terabytes columns characters pixels percent degrees meters grams tokens".split()
)

_either = lambda words: "|".join(words.split() if isinstance(words, str) else words)
def _phrases(rows: list[str]) -> str:
    return "|".join(p.replace(" ", r"\s+") for p in sorted(rows, key=len, reverse=True))


THOUSANDS = r"[0-9]{1,3}(?:,[0-9]{3})+"
#: A number is not the tail of another, of a name or of a sum of money, nor bound by a hyphen or a sign of an expression.
OPEN, SHUT = r"(?<![\w.,$#§\[\"'=<>/*+^-])(?<![0-9] [-–+*/x×] )(?<![0-9]–)", r"(?![\w]|[.,:][0-9]|[-–/][\w])"


@dataclass(frozen=True)
class Substrate:
    """A kind of text: the pattern of what it may count (the number first, in group 1) and the exemptions that hold there."""

    pattern: str
    exempt: tuple[str, ...]


@dataclass(frozen=True)
class Place:
    """A match and what stands around it: the number, the words after it in the match, two words before and two behind, in lower case."""

    number: Column
    inner: Column
    before: Column
    before_two: Column
    behind: Column
    behind_two: Column
    left: Column

    @property
    def noun(self) -> Column:
        return F.try_element_at(self.inner, F.lit(-1))

    @property
    def is_digits(self) -> Column:
        return self.number.rlike("^[0-9,]+$")


def _status(word: Column) -> Column:
    return word.rlike("^[1-5][0-9]{2}$")


#: Each says of a match that it counts nothing.
EXEMPTIONS: dict[str, Callable[[Place], Column]] = {
    "function word between": lambda p: F.exists(F.slice(p.inner, 1, F.greatest(F.size(p.inner) - 1, F.lit(0))), lambda w: w.isin(GAP_WORDS)),
    "no plural noun": lambda p: F.coalesce(p.noun.isin(NO_PLURALS), F.lit(False)),
    "behind an article": lambda p: p.before.isin("a", "an"),
    "choice among a set": lambda p: (p.before == "of") & p.before_two.isin(CHOOSERS),
    "label": lambda p: p.before.isin(LABELS) & p.is_digits,
    "status code": lambda p: _status(p.number) & (
        F.coalesce(F.get(p.inner, F.lit(0)).isin(STATUS_NOUNS), F.lit(False)) | (p.before == "status") | _status(p.before)
        | (p.before.isin("or", "and", "nor") & _status(p.before_two)) | (p.behind.isin("or", "and", "nor") & _status(p.behind_two))),
    "exit status": lambda p: p.is_digits & (p.before.isin(EXIT_WORDS) | (p.before.isin("code", "codes") & p.before_two.isin(EXIT_WORDS))),
    "word size": lambda p: p.number.isin("8", "16", "32", "64", "128") & F.coalesce(F.coalesce(F.get(p.inner, F.lit(0)), p.behind).isin("bits", "bit"), F.lit(False)),
    "one measure": lambda p: p.behind.isin(SINGULAR_VERBS) & F.coalesce(p.noun.endswith("s"), F.lit(False)),
    "measure behind": lambda p: p.behind.endswith("s") & p.behind_two.isin(SINGULAR_VERBS),
    "list marker": lambda p: p.is_digits & p.left.rlike(r"(?:^|\n)[ \t/#*;]*$"),
    "operand": lambda p: p.left.rlike(r"[=<>+*/^%]\s*$"),
}

#: What may stand between a frame and its number.
BOUNDS = _phrases([*HEDGES.split(), *APPROXIMATIONS, *RATES, *CEILINGS, *FLOORS, *FLOORS_ABOVE])
_GAP = r"[a-z][a-z-]*\s+"
_PROSE = rf"(?:{THOUSANDS}|[0-9]{{1,4}}|{_either([*UNITS.split(), *TEENS.split(), *TENS.split(), 'dozen'])})"
#: What stands in every text with a number in prose, given in lower case.
ANY_NUMBER = rf"(?<!\w)(?:[0-9]|(?:{_either([*UNITS.split(), *TEENS.split(), *TENS.split(), 'dozen'])})(?!\w))"
_QUANTITY = rf"{OPEN}({_PROSE}){SHUT}\s+(?:{_GAP}){{0,3}}?[a-z][a-z-]{{2,}}s\b"
#: Where a count says what is there: behind a verb of having, behind a possessive, or in front of a pointer.
FRAMES = (
    rf"(?<=\b(?:{_either(FRAMING)})\s)(?:(?:{BOUNDS})\s+)*{_QUANTITY}",
    rf"(?<=\b(?:{_either(DURATIVE)})\s(?:{_either(DURATION)})\s)(?:(?:{BOUNDS})\s+)*{_QUANTITY}",
    rf"(?<=\bthere\s(?:{_either(EXISTENCE)})\s)(?:(?:{BOUNDS})\s+)*{_QUANTITY}",
    rf"(?<=\b(?:this|these|our|the)\s(?:[a-z-]{{1,40}}\s)?(?:[a-z-]{{1,40}}\s)?[a-z-]{{1,40}}'s\s){_QUANTITY}",
    rf"(?<=\b(?:the|these|those)\s){_QUANTITY}(?=\s+(?:\S+\s+){{0,2}}?(?:{_either(DEICTIC)})\b)",
)
QUANTITY_EXEMPT = ("function word between", "no plural noun", "label", "status code", "word size", "one measure", "operand")
SUBSTRATES = {
    "gate": Substrate(rf"(?i){OPEN}({THOUSANDS}|[0-9]+|{_either(UNITS)}){SHUT}\s+(?:{_GAP}){{0,2}}?[a-z]+s\b", (*QUANTITY_EXEMPT, "behind an article", "choice among a set")),
    "prose": Substrate("(?i)(?:" + "|".join(FRAMES) + ")", QUANTITY_EXEMPT),
    "comment": Substrate(rf"(?i){OPEN}({THOUSANDS}|[0-9]+|{_either(WORD_VALUES)}){SHUT}", ("label", "exit status", "list marker", "operand", "measure behind", "word size")),
}
_MARK = "\u0001"


def number_value(number: Column) -> Column:
    """What digits, with commas between thousands or without, or a number word are worth; null for anything else."""
    words = F.create_map(*(F.lit(x) for w, n in WORD_VALUES.items() for x in (w, n)))
    return F.coalesce(F.translate(number, ",", "").try_cast("long"), F.element_at(words, F.lower(number)))


def number_phrases(text: Column, substrate: str) -> Column:
    """array<struct<start, text, number, value, noun>> of what a text counts, from the left; places count from 0.

    gate: a number and a plural noun, anywhere. prose: the same, where the sentence claims that the
    things are here. comment: the number alone. Each leaves out what its exemptions say counts nothing.
    """
    kind = SUBSTRATES[substrate]
    number_of = lambda found: F.regexp_extract(F.lower(found), rf"(?<![\w,])({THOUSANDS}|[0-9]+|{_either(WORD_VALUES)})(?![\w])", 1)
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    word = lambda ws, k: F.coalesce(bare(F.get(ws, k)), F.lit(""))

    def of_parts(parts: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            left = F.array_join(F.slice(parts, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), "")  # the two parts before, the match before this one among them
            right = F.concat_ws("", F.get(parts, i + 1), F.get(parts, i + 2))
            number = number_of(p)
            inner = F.filter(F.split(F.lower(F.regexp_replace(p, rf"(?i)^.*?(?:{THOUSANDS}|[0-9]+|\b(?:{_either(WORD_VALUES)})\b)(?![\w])", "")), r"\s+"), lambda w: w != "")

            def judged(ws: Column) -> Column:
                ls, rs = ws["left"], ws["right"]
                place = Place(ws["number"], ws["inner"], word(ls, F.size(ls) - 1), word(ls, F.size(ls) - 2), word(rs, F.lit(0)), word(rs, F.lit(1)), left)
                exempt = functools.reduce(lambda a, b: a | b, (F.coalesce(EXEMPTIONS[e](place), F.lit(False)) for e in kind.exempt))
                noun = F.coalesce(F.try_element_at(ws["inner"], F.lit(-1)), F.lit(""))
                found = F.regexp_replace(p, rf"(?i)^(?:(?:{BOUNDS})\s+)*", "")
                start = F.length(F.array_join(F.slice(parts, F.lit(1), i), "")) + F.length(p) - F.length(found)
                return F.when(~exempt, F.struct(start.alias("start"), found.alias("text"), ws["number"].alias("number"), number_value(ws["number"]).alias("value"), noun.alias("noun")))

            split = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
            return let(F.struct(split(left).alias("left"), split(right).alias("right"), number.alias("number"), inner.alias("inner")), judged)

        return F.array_compact(F.transform(parts, lambda p, i: F.when(i % 2 == 1, one(p, i))))

    marked = F.regexp_replace(text, f"(?i)({kind.pattern.removeprefix('(?i)')})", _MARK + "$1" + _MARK)
    return F.when(text.rlike(kind.pattern) & ~F.contains(text, F.lit(_MARK)), let(F.split(marked, _MARK, -1), of_parts)).otherwise(
        F.array().cast("array<struct<start: int, text: string, number: string, value: bigint, noun: string>>"))


def vague_amount(n: Column) -> Column:
    """An amount that does not go stale when the count moves a little."""
    return F.when(n <= 2, "a couple of").when(n <= 5, "a few").when(n <= 20, "several").otherwise("many")


#: A framed count with all that hedges or bounds it, as a rewrite reads it.
RESTATED_BEHIND = rf"(?<=\b(?:{_either(FRAMING)}|there\sare|there\swere|[a-z]{{1,40}}'s)\s)"
RESTATED = rf"(?i)(?:(?:{BOUNDS})\s+)*(?:~|≤|<=)?(?:{_PROSE}){SHUT}\s+(?:{_GAP}){{0,3}}?[a-z][a-z-]{{2,}}s\b(?:\s+or\s+(?:fewer|less)\b)?"


def restated(was: Column) -> Column:
    """A framed count without its number: what bounds it decides what stands there instead, a measure gets a vague amount, and a plain tally none."""
    number = rf"(?i)(?:~|≤|<=)?(?:{_PROSE})(?![\w])\s+"
    value = number_value(F.regexp_extract(F.lower(was), rf"(?<![\w,])({_PROSE})(?![\w])", 1))
    lead = F.lower(F.regexp_replace(was, rf"{number}.*$", ""))
    rest = F.regexp_replace(F.regexp_replace(was, rf"^.*?{number}", ""), r"(?i)\s+or\s+(?:fewer|less)$", "")
    has = lambda rows: lead.rlike(rf"\b(?:{_phrases(rows)})\b")
    capped = has(CEILINGS) | was.rlike(r"≤|<=|(?i)\s+or\s+(?:fewer|less)$")
    instead = (
        F.when(capped, "a bounded number of").when(has(RATES), "every few").when(has(FLOORS_ABOVE), vague_amount(value + 1)).when(has(FLOORS), vague_amount(value))
        .when(F.lower(rest).rlike(rf"\b(?:{_either(MEASURES)})$"), vague_amount(value))
    )
    return F.concat_ws(" ", instead, rest)
