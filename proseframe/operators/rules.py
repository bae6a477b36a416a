"""Rules: registered objects that turn segmented texts into findings."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import segment as S
from ..functions import wordlists as L
from ..plans.prefilter import matches
from .rewrites import OPEN, SHUT, Rewrite, lookup, pass_of, template

FINDING = ["doc_id", "line", "end_line", "rule_id", "category", "rule", "detail", "fix", "severity", "repairable", "measured"]
HIT = "line: int, end_line: int, rule: string, detail: string, fix: string, measured: bigint"


def hit(line: Column, end_line: Column, what: Column | str, detail: Column | str, fix: str, measured: Column | None = None) -> Column:
    """One finding of a row rule; `measured` is the number that a limit was held against."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        line.cast("int").alias("line"), end_line.cast("int").alias("end_line"), as_column(what).alias("rule"), quoted(as_column(detail)).alias("detail"),
        F.lit(fix).alias("fix"), (F.lit(None) if measured is None else measured).cast("long").alias("measured"),
    )


def only(condition: Column, found: Column) -> Column:
    """The finding if the condition holds, as array; null for none."""
    return F.when(condition, F.array(found))


@dataclass(frozen=True)
class At:
    """What a row rule reads: of a document its text; of a block of prose also what surrounds it; of a sentence both."""

    text: Column
    limits: dict
    start: Column | None = None
    end: Column | None = None
    marker: Column | None = None
    masked: Column | None = None
    sentences: Column | None = None
    sentence: Column | None = None
    n_words: Column | None = None
    words: Column | None = None

    def limit(self, name: str, default: int) -> int:
        return self.limits.get(name, default)

    def here(self, what: Column | str, detail: Column | str, fix: str, measured: Column | None = None) -> Column:
        """A finding on the lines of the block."""
        return hit(self.start, self.end, what, detail, fix, measured)


@dataclass
class Segments:
    """One segmentation of the texts, that all rules of a run read."""

    docs: DataFrame
    limits: dict[str, int] = field(default_factory=dict)

    @functools.cached_property
    def blocks(self) -> DataFrame:
        return S.blocks(self.docs)

    @functools.cached_property
    def prose(self) -> DataFrame:
        return self.blocks.where("kind = 'prose'").withColumn("masked", S.mask_prose(F.col("text")))

    @functools.cached_property
    def sentences(self) -> DataFrame:
        rows = S.pos_exploded(self.prose, ["doc_id", "block_no", "start_line", "end_line", "marker"], S.sentences_of(F.col("masked")), "at", "sentence")
        return rows.withColumn("n_words", S.word_count(F.col("sentence")))

    @functools.cached_property
    def tokens(self) -> DataFrame:
        rows = S.pos_exploded(self.sentences, ["doc_id", "block_no", "start_line", "end_line", F.col("at").alias("sent_no")], S.words_of(F.col("sentence")), "pos", "word")
        return rows.withColumn("lower", F.lower("word"))

    def limit(self, name: str, default: int) -> int:
        return self.limits.get(name, default)


@dataclass(frozen=True)
class Case:
    """A text that shows a rule: what it finds in it, and what a repair makes of it."""

    name: str
    text: str
    fires: bool = True
    want: str | None = None


@dataclass(frozen=True)
class Rule:
    """A rule finds in a row (`find`, at a level: document, block or sentence), or by joins over all texts (`detect`)."""

    id: str
    detect: Callable[[Segments], DataFrame] | None = None
    severity: str = ""
    repair: Callable[[Column], Column] | None = None
    place: int = 1000
    cases: tuple[Case, ...] = ()
    rewrites: tuple[Rewrite, ...] = ()
    level: str = ""
    find: Callable[[At], Column] | None = None
    kinds: tuple[str, ...] = ()

    @property
    def category(self) -> str:
        return self.id.split("/")[0]


REGISTRY: dict[str, Rule] = {}
LEVELS = ("document", "block", "sentence")


def _registered(r: Rule) -> None:
    if "/" not in r.id or r.id in REGISTRY or not r.cases:
        raise ValueError(f"rule {r.id!r} needs a category, a new id and cases")
    REGISTRY[r.id] = r


def rule(id: str, level: str, severity: str = "", repair: Callable[[Column], Column] | None = None, place: int = 1000, cases: tuple[Case, ...] = (), rewrites: tuple[Rewrite, ...] = ()) -> Callable:
    """Register what finds in a row: At to an array of hits, null for none. All row rules of a run share one scan and one segmentation.

    An id without a category, a repeated id, a rule without cases and an unknown level are errors. A rule
    repairs by a function of the text, or by rewrites, which a run makes together with those of other rules.
    """

    def register(find: Callable[[At], Column]) -> Callable:
        if level not in LEVELS:
            raise ValueError(f"rule {id!r} has no level of {LEVELS}")
        own = pass_of(rewrites) if rewrites else repair
        _registered(Rule(id, None, severity, own, place, cases, rewrites, level, find))
        return find

    return register


def wide_rule(id: str, severity: str = "", cases: tuple[Case, ...] = ()) -> Callable:
    """Register a detector that needs joins: Segments to a DataFrame of doc_id and the columns of a hit."""

    def register(detect: Callable[[Segments], DataFrame]) -> Callable:
        _registered(Rule(id, detect, severity, cases=cases))
        return detect

    return register


def select_rules(names: list[str] | None = None) -> list[Rule]:
    """Rules by category or id, in the order of their ids; all without names. An unknown name is an error."""
    if names is None:
        return [REGISTRY[k] for k in sorted(REGISTRY)]
    unknown = [n for n in names if n not in REGISTRY and not any(r.category == n for r in REGISTRY.values())]
    if unknown:
        raise ValueError(f"no rule or category is named {', '.join(unknown)}")
    return [REGISTRY[k] for k in sorted(REGISTRY) if k in names or REGISTRY[k].category in names]


def quoted(text: Column, most: int = L.QUOTE_CHARS) -> Column:
    """A quotation of a text on one line, cut after `most` characters.

    Of a long text only the first characters are read, unless so many of them are white space that those do not fill it.
    """
    flat = lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "))
    cut = lambda x: F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)
    read = 4 * most
    return S.let(flat(F.substring(text, 1, read)), lambda x: F.when((F.length(x) > most) | (F.length(text) <= read), cut(x)).otherwise(S.let(flat(text), cut)))


def one_of(words: list[str]) -> str:
    return "|".join(words)


BOUND = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"  # an ASCII word boundary on each side


def row_findings(docs: DataFrame, rules: list[Rule], limits: dict) -> DataFrame:
    """Findings of all row rules in one pass over docs(doc_id, text).

    A document is segmented once: it is exploded to its blocks and one row for what concerns it as a
    whole; blocks are masked and cut into sentences there; each rule gives an array of hits, and these
    are exploded together. Nothing is shuffled, and levels that no rule reads are not made.
    """
    none = F.array().cast(f"array<struct<at: int, hit: struct<{HIT}>>>")

    def hits(level: str, at: At) -> list[Column]:
        tagged = lambda k, found: F.transform(F.coalesce(found, F.array().cast(f"array<struct<{HIT}>>")), lambda h: F.struct(F.lit(k).alias("at"), h.alias("hit")))
        return [tagged(k, r.find(at)) for k, r in enumerate(rules) if r.level == level]

    levels = {r.level for r in rules}
    whole = F.concat(none, *hits("document", At(F.col("text"), limits)))
    rows = docs.where("text is not null").select("doc_id", "text", whole.alias("of_text"))
    if levels - {"document"}:
        rows = rows.select("doc_id", "of_text", S.blocks_of(F.col("text")).alias("blocks"))
        prose = F.filter("blocks", lambda b: b["kind"] == "prose")
        part = lambda b, found: F.struct(b.alias("b"), found.alias("of_text"))
        parts = F.transform(prose, lambda b: part(b, none))
        if "document" in levels:
            parts = F.concat(F.array(part(F.get("blocks", F.lit(-1)), F.col("of_text"))), parts)
        rows = S.exploded(rows, ["doc_id"], parts, "p").select("doc_id", "p.of_text", "p.b").withColumn("masked", S.mask_prose(F.col("b.text")))
        rows = rows.withColumn("sentences", S.sentences_of(F.col("masked")))
        block = At(F.col("b.text"), limits, F.col("b.start_line"), F.col("b.end_line"), F.col("b.marker"), F.col("masked"), F.col("sentences"))
        of_blocks = F.concat(none, *hits("block", block))
        counted = lambda s, w: F.struct(w.alias("words"), F.when(F.contains(s, F.lit("(")), S.word_count(s)).otherwise(F.size(w)).alias("n_words"))
        # words live only as long as the rules read their sentence
        found_in = lambda s, c: F.concat(none, *hits("sentence", dataclasses.replace(block, sentence=s, n_words=c["n_words"], words=c["words"])))
        of_sentence = lambda s: S.let(S.let(S.words_of(s), lambda w: counted(s, w)), lambda c: found_in(s, c))
        of_sentences = F.coalesce(F.flatten(F.transform("sentences", of_sentence)), none) if "sentence" in levels else none
        rows = rows.select("doc_id", F.concat("of_text", of_blocks, of_sentences).alias("of_text"))
    found = S.exploded(rows, ["doc_id"], F.col("of_text"), "f").select("doc_id", "f.at", "f.hit.*")
    of_rule = lambda values: F.get(F.array(*map(F.lit, values)), F.col("at"))
    columns = {"rule_id": [r.id for r in rules], "category": [r.category for r in rules], "severity": [r.severity or "error" for r in rules], "repairable": [r.repair is not None for r in rules]}
    return found.withColumns({k: of_rule(v) for k, v in columns.items()}).select(FINDING)


def run_rule(r: Rule, segments: Segments) -> DataFrame:
    """The findings of one rule in the full schema."""
    if r.find:
        return row_findings(segments.docs, [r], segments.limits)
    rows = r.detect(segments).withColumns({"rule_id": F.lit(r.id), "category": F.lit(r.category), "severity": F.lit(r.severity or "error"), "repairable": F.lit(r.repair is not None)})
    return rows.select(FINDING)


@rule("ste/sentence-length", "sentence", cases=(Case("long", "One " + "word " * 30 + "ends."), Case("short", "It ends here.", False)))
def sentence_length(s: At) -> Column:
    cap = s.limit("sentence_words", L.SENTENCE_WORDS)
    what = F.concat(s.n_words.cast("string"), F.lit(f" words in a sentence that may have {cap}"))
    return only(s.n_words > cap, s.here(what, s.sentence, "Split it into shorter sentences.", s.n_words))


@rule("ste/instruction-length", "sentence", "warning", cases=(Case("long", "Add " + "word " * 20 + "now."), Case("no verb", "Word " * 22 + "now.", False)))
def instruction_length(s: At) -> Column:
    """Sentences of 21 to 25 words whose first word is a base verb of the list, in place of a tagger."""
    verbs = s.limits.get("instruction_verbs") or L.INSTRUCTION_VERBS
    long = s.n_words.between(L.INSTRUCTION_WORDS + 1, L.SENTENCE_WORDS)
    return only(long & F.lower(F.get(s.words, F.lit(0))).isin(verbs), s.here("an instruction of over 20 words", s.sentence, "Split the instruction.", s.n_words))


@rule("ste/paragraph-length", "block", "warning", cases=(Case("seven", "A b. " * 7), Case("list", "- " + "A b. " * 7, False)))
def paragraph_length(b: At) -> Column:
    cap, n = b.limit("paragraph_sentences", L.PARAGRAPH_SENTENCES), F.size(b.sentences)
    return only((n > cap) & (b.marker == ""), b.here(F.concat(n.cast("string"), F.lit(f" sentences in a paragraph that may have {cap}")), b.text, "Divide the paragraph.", n))


@rule("wrap/hard-wrap", "block", cases=(Case("wrapped", "one line\nand another"), Case("one", "one line", False)))
def hard_wrap(b: At) -> Column:
    begun = F.concat(F.lit("begun on line "), b.start.cast("string"))
    found = lambda at: hit(at, at, "a line that goes on with its paragraph", begun, "Join the lines.", b.start)
    return F.when(b.end > b.start, F.transform(F.sequence(b.start + 1, b.end), found))


@rule("wrap/long-block", "block", cases=(Case("long", "word " * 400), Case("short", "word", False)))
def long_block(b: At) -> Column:
    cap, n = b.limit("block_chars", L.BLOCK_CHARS), F.length(b.text)
    return only(n > cap, b.here(F.concat(n.cast("string"), F.lit(f" characters in a block that may have {cap}")), b.text, "Divide the block at a sentence end.", n))


def spliced_commas(text: Column) -> Column:
    """The parts `, [conjunction] subject [words] verb` of a text that join two clauses; without a conjunction a clause has to stand before the comma.

    Words are looked up by class in arrays: a sentence part is cut at its commas, and only the few
    words after a comma are classed; what stands before it is read where those fit.
    """
    in_class = lambda word, name: word.isin(L.class_words(name))
    lead = lambda word: F.regexp_extract(F.lower(word), "^([a-z0-9_]*)", 1)

    def stands_alone(before: Column) -> Column:
        def of_words(words: Column) -> Column:
            first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
            dependent = in_class(lead(first), "subordinator") | (in_class(F.lower(first), "subordinator-conjunction") & F.coalesce(in_class(lead(second), "subordinator"), F.lit(False)))
            has_verb = F.exists(words, lambda w: F.exists(F.split(F.lower(w), "[^a-z0-9_]+"), lambda x: in_class(x, "finite-verb")))
            return (F.size(words) >= 3) & ~dependent & has_verb

        return S.let(F.split(F.btrim(before, F.lit(" \t\n\r")), r"\s+", -1), of_words)

    def hit(pieces: Column, i: Column, words: Column) -> Column:
        # words[0] is empty where white space follows the comma
        joined = in_class(F.lower(F.get(words, F.lit(1))), "splice-conjunction")
        at = F.when(joined, 2).otherwise(1)

        def is_verb(v: Column) -> Column:
            between = F.slice(words, at + 2, v - at - 1)
            near = (v <= at + 3) | (F.lower(F.get(words, v - 1)) == "not")
            return in_class(lead(F.get(words, v)), "finite-verb") & near & F.forall(between, lambda w: w.rlike("^[A-Za-z0-9_]+$"))

        def made(v: Column) -> Column:
            end = F.substring(F.get(words, v), F.lit(1), F.length(lead(F.get(words, v))))
            return F.concat(F.lit(", "), F.array_join(F.concat(F.slice(words, F.lit(2), v - 1), F.array(end)), " "))

        verb = F.get(F.filter(F.sequence(at + 1, at + 4), lambda v: F.coalesce(is_verb(v), F.lit(False))), F.lit(0))
        opens = (F.get(words, F.lit(0)) == "") & in_class(F.lower(F.get(words, at)), "clause-subject")
        found = S.let(verb, lambda v: F.when(v.isNotNull() & (joined | stands_alone(F.array_join(F.slice(pieces, F.lit(1), i), ","))), made(v)))
        return F.when(opens, found)

    def of_sentence(sentence: Column) -> Column:
        pieces = F.split(sentence, ",", -1)
        # a white space, a conjunction, a subject, two words, a negation and a verb are seven at most
        each = lambda ps: F.transform(ps, lambda p, i: F.when(i > 0, S.let(F.split(p, r"\s+", 8), lambda words: hit(ps, i, words))))
        return F.array_compact(S.let(pieces, each))

    parts = F.split(F.regexp_replace(text, r"\([^()]*\)", " "), "[.!?:;—]", -1)
    return F.flatten(F.transform(F.filter(parts, lambda x: F.contains(x, F.lit(","))), of_sentence))


@rule("english/comma-splice", "block", cases=(Case("bare", "The cache holds rows, it drops them."), Case("list", "It holds rows, keys and files.", False), Case("dependent", "If the cache is cold, it waits.", False)))
def comma_splice(b: At) -> Column:
    found = lambda h: b.here("two full clauses meet at a comma", h, "End the sentence at the comma.")
    return F.when(F.contains(b.text, F.lit(",")), F.transform(spliced_commas(b.masked), found))


@rule("english/semicolon", "block", cases=(Case("one", "It runs; it stops."), Case("code", "It writes `a;b` there.", False)))
def semicolon(b: At) -> Column:
    return only(F.contains(b.masked, F.lit(";")), b.here("a semicolon joins two sentences", b.text, "Write two sentences."))


COMMA_NEVER = r"(?i),\s+never(?![A-Za-z0-9_])"


@rule("english/comma-never", "block", rewrites=(template(COMMA_NEVER, ", not"),), place=30, cases=(Case("one", "It reads rows, never files.", want="It reads rows, not files."), Case("word", "It reads rows, nevertheless it waits.", False)))
def comma_never(b: At) -> Column:
    return only(matches(b.masked, COMMA_NEVER), b.here("a contrast by `, never`", b.text, "Write `, not`."))


def written_out(was: Column) -> Column:
    """A contraction in full; a curly apostrophe is read as a straight one."""
    straight = F.translate(was, "’", "'")
    irregular = F.create_map(*(F.lit(x) for pair in L.IRREGULAR_CONTRACTIONS.items() for x in pair))
    full = straight
    for ending, words in L.CONTRACTION_ENDINGS.items():
        full = F.regexp_replace(full, f"(?i){ending}$", words)
    return F.coalesce(F.element_at(irregular, F.lower(straight)), full)


CONTRACTIONS = "(?i){}(?:{}){}".format(OPEN, one_of([*L.IRREGULAR_CONTRACTIONS, *("[a-z]+" + e for e in L.CONTRACTION_ENDINGS)]), SHUT).replace("'", "['’]")


@rule("ste/contraction", "sentence", rewrites=(Rewrite(CONTRACTIONS, written_out, holds="['’]"),), place=30, cases=(Case("nt", "It doesn't run.", want="It does not run."), Case("irregular", "Can't stop.", want="Cannot stop."), Case("possessive", "The job's log.", False)))
def contraction(s: At) -> Column:
    forms = one_of(["[a-z]+" + e for e in L.CONTRACTION_ENDINGS] + list(L.IRREGULAR_CONTRACTIONS))
    fits = lambda w: F.contains(w, F.lit("'")) & F.lower(w).rlike(f"^(?:{forms})$")
    return F.when(F.contains(s.sentence, F.lit("'")), F.transform(F.filter(s.words, fits), lambda w: s.here("a contraction", w, "Write it out.")))


@rule("ste/modal", "sentence", rewrites=(lookup(L.MODALS),), place=30, cases=(Case("should", "It should run.", want="It must run."), Case("must", "It must run.", False)))
def modal(s: At) -> Column:
    return F.transform(F.filter(s.words, lambda w: F.lower(w).isin(list(L.MODALS))), lambda w: s.here("a modal that hedges", w, "Use must, can or will."))


@rule("comments/tail", "block", cases=(Case("the", "It reads the"), Case("stop", "It reads what it reads from.", False)))
def comment_tail(b: At) -> Column:
    """A block whose last word, with no terminator after it, opens what never follows."""
    last = F.regexp_extract(F.element_at(F.split(b.text, r"\s"), -1), r"([A-Za-z']+)$", 1)
    return only(F.lower(last).isin(L.class_words("dangling")), hit(b.end, b.end, "the block stops on an opening word", last, "Finish the sentence."))


@rule("repo/budget", "document", cases=(Case("big", "x" * 40_001), Case("small", "x", False)))
def file_budget(d: At) -> Column:
    cap, n = d.limit("file_chars", L.FILE_CHARS), F.length(d.text)
    return only(n > cap, hit(F.lit(1), F.lit(1), F.concat(n.cast("string"), F.lit(f" characters in a text that may have {cap}")), "", "Split the file.", n))


@rule("wrap/wide-line", "document", "warning", cases=(Case("wide", "ab " * 60), Case("token", "x" * 200, False), Case("table", "| " + "ab " * 60 + "|", False)))
def wide_line(d: At) -> Column:
    """Lines over the column limit, but not in fences and tables, nor where no blank lets them break."""
    cap = d.limit("line_columns", L.LINE_COLUMNS)
    wide = lambda x: (F.length(x) > cap) & ~x.rlike(r"^\s*\|") & F.btrim(x).rlike(r"\s")

    def of_lines(ls: Column) -> Column:
        numbered = F.transform(F.zip_with(ls, S.fenced_mask(ls), lambda x, f: F.struct(x.alias("line"), f.alias("fenced"))), lambda x, i: F.struct((i + 1).alias("no"), x.alias("l")))
        kept = F.filter(numbered, lambda x: wide(x["l"]["line"]) & ~x["l"]["fenced"])
        return F.transform(kept, lambda x: hit(x["no"], x["no"], f"over {cap} columns", x["l"]["line"], "Wrap it.", F.length(x["l"]["line"])))

    return S.let(S.lines_of(d.text), lambda ls: F.when(F.exists(ls, wide), of_lines(ls)))


def closed_class_words() -> list[str]:
    return sorted({w for c in ("article", "determiner", "conjunction", "preposition", "auxiliary", "adverb", "pronoun") for w in L.class_words(c)})


def open_runs(lower: Column, over: int = L.NOUN_RUN) -> Column:
    """(start, n) of runs of over `over` words, of an array in lower case, that no closed class holds.

    What stands between two words of closed classes is a run, so a row is read once. A lexicon
    stands in for a tagger, so verbs count as open words.
    """
    closed = closed_class_words()

    def between(ends: Column) -> Column:
        runs = F.transform(F.slice(ends, F.lit(2), F.size(ends)), lambda end, i: F.struct((F.get(ends, i) + 1).alias("start"), (end - F.get(ends, i) - 1).cast("long").alias("n")))
        return F.filter(runs, lambda r: r["n"] > over)

    def ends_of(ws: Column) -> Column:
        inner = F.filter(F.transform(ws, lambda w, i: F.when(w.isin(closed), i)), lambda i: i.isNotNull())
        return S.let(F.concat(F.array(F.lit(-1)), inner, F.array(F.size(ws))), between)

    return S.let(lower, ends_of)


@rule("ste/noun-cluster", "sentence", "warning", cases=(Case("four", "The build cache key file is old."), Case("three", "The cache key file is old.", False)))
def noun_cluster(s: At) -> Column:
    words = lambda r: F.array_join(F.slice(s.words, r["start"] + 1, r["n"].cast("int")), " ")
    return F.transform(open_runs(F.transform(s.words, F.lower)), lambda r: s.here("over three nouns in a row", words(r), "Break the cluster up.", r["n"]))


def verb_forms(words: Column) -> Column:
    """Places and kinds of `be` + participle (passive), `have` + participle (perfect) and `be` + -ing (progressive)."""
    participles = sorted({p for _, _, p in L.VERBS})
    participle = lambda w: w.isin(participles) | w.rlike("^[a-z]{2,}ed$")

    def form(lower: Column, w: Column, i: Column) -> Column:
        before = F.get(lower, i - 1)
        kind = (
            F.when(before.isin(L.class_words("be")) & participle(w), "passive")
            .when(before.isin(L.class_words("have")) & participle(w), "perfect")
            .when(before.isin(L.class_words("be")) & w.rlike("^[a-z]{2,}ing$"), "progressive")
        )
        return F.when((i > 0) & kind.isNotNull(), F.struct(i.alias("pos"), kind.alias("kind"), F.concat_ws(" ", before, w).alias("form")))

    return F.array_compact(S.let(F.transform(words, F.lower), lambda lower: F.transform(lower, lambda w, i: form(lower, w, i))))


def _forms(s: At, kinds: list[str], what: str, fix: str) -> Column:
    return F.transform(F.filter(verb_forms(s.words), lambda v: v["kind"].isin(kinds)), lambda v: s.here(what, v["form"], fix))


@rule("ste/passive", "sentence", "warning", cases=(Case("was", "The file was written."), Case("active", "It wrote the file.", False)))
def passive(s: At) -> Column:
    """Reports the form wherever it stands, not only where a rewrite exists."""
    return _forms(s, ["passive"], "a passive clause", "Name who acts.")


@rule("ste/tense", "sentence", "warning", cases=(Case("has", "It has taken it."), Case("is", "It is running."), Case("simple", "It runs.", False)))
def tense(s: At) -> Column:
    return _forms(s, ["perfect", "progressive"], "a compound tense", "Use a simple tense.")
