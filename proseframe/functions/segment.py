"""Texts to lines, blocks, sentences and words, as column expressions that need no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What ends, closes and opens a sentence, and what ends in a period without ending one.
ENDS = r"[.!?]+"
CLOSERS = r"[)\]\"'*_”’»]*"
OPENERS = r"[\p{Lu}\p{Nd}(`'\"*_\[§¶“‘—–]"
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "cf", "al", "fig", "no", "approx", "dr", "mr", "mrs")
WORD = r"[A-Za-z]+(?:'[A-Za-z]+)?"
LIST_MARKER = r"^([ \t]*)([-*+]|[0-9]+[.)])[ \t]"
BREAK = "\u0001"

# looks back from a terminator only, so other places of a text cost nothing
_NO_ABBREVIATION = r"(?=[.!?])(?<!(?:^|[\s(])(?i:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")(?=\.))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for a row; inside higher-order functions it would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exploded(rows: DataFrame, keep: list[str | Column], values: Column, name: str) -> DataFrame:
    """keep, name: a row for each value of an array.

    The outer form, as Spark puts a filter on the array before an inner one and computes it twice for that.
    No array here holds nulls.
    """
    return rows.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def pos_exploded(rows: DataFrame, keep: list[str | Column], values: Column, at: str, name: str) -> DataFrame:
    """keep, at (from zero), name: a row for each value of an array, computed once as in `exploded`."""
    return rows.select(*keep, F.posexplode_outer(values).alias(at, name)).where(F.col(at).isNotNull())


def lines_of(text: Column) -> Column:
    """All lines of a text in order; a trailing line feed yields a last empty line."""
    return F.split(text, "\n", -1)


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no (from one), line."""
    return docs.select("doc_id", F.posexplode(lines_of(F.col(text))).alias("at", "line")).select(
        "doc_id", (F.col("at") + 1).alias("line_no"), "line"
    )


def sentences_of(text: Column) -> Column:
    """The trimmed sentences of a prose text.

    A sentence ends at terminators, with any closing marks after them, where white space and an
    opener follow, unless the terminator belongs to an abbreviation. File names, sections and
    lower-case identifiers open no sentence here, which a tagger would tell from ordinary words.
    """
    cut = F.regexp_replace(text, f"{_NO_ABBREVIATION}({ENDS}{CLOSERS})\\s+({OPENERS})", "$1" + BREAK + "$2")
    parts = F.split(cut, BREAK, -1)
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" \t\n\r"))), lambda s: s != "")


def message_sentences_of(text: Column) -> Column:
    """The sentences of a message: they end at a line feed, or at . ! ? unless a period stands between alphanumerics."""
    cut = F.regexp_replace(text, r"([.!?]+)([^A-Za-z0-9.!?]|$)", "$1" + BREAK + "$2")
    parts = F.split(F.translate(cut, "\n", BREAK), BREAK, -1)
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" \t\r"))), lambda s: s != "")


def words_of(sentence: Column) -> Column:
    """ASCII words with an inner apostrophe."""
    return F.regexp_extract_all(sentence, F.lit(f"({WORD})"), 1)


def word_count(sentence: Column) -> Column:
    """Number of words; what stands in parentheses counts as one."""
    return F.size(words_of(F.when(F.contains(sentence, F.lit("(")), F.regexp_replace(sentence, r"\([^()]*\)", " x ")).otherwise(sentence)))


def identifier_words_of(text: Column) -> Column:
    """Maximal runs of ASCII letters, digits and underscores."""
    return F.filter(F.split(text, r"[^A-Za-z0-9_]+", -1), lambda w: w != "")


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, sent_no (from one), sentence, n_words."""
    rows = pos_exploded(docs, ["doc_id"], sentences_of(F.col(text)), "at", "sentence")
    return rows.select("doc_id", (F.col("at") + 1).alias("sent_no"), "sentence", word_count(F.col("sentence")).alias("n_words"))


def words(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, pos (from zero), word of whole texts."""
    return pos_exploded(docs, ["doc_id"], words_of(F.col(text)), "pos", "word")


def fenced_mask(lines: Column, same_marker: bool = False) -> Column:
    """For each line, whether it is a code fence line or stands between two of them.

    The toggle form counts every fence line; the same-marker form closes a fence only with the
    marker that opened it.
    """
    is_fence = lambda s: s.rlike(r"^\s*(```|~~~)")
    if not same_marker:

        def toggled(ls: Column) -> Column:
            def spread(at: Column) -> Column:
                # after each fence line, as many lines as there are to the next one, inside if it opened
                n = lambda p, k: F.coalesce(F.get(at, k + 1), F.size(ls)) - p - 1
                parts = F.transform(at, lambda p, k: F.concat(F.array(F.lit(True)), F.array_repeat(k % 2 == 0, n(p, k))))
                return F.concat(F.array_repeat(F.lit(False), F.coalesce(F.get(at, F.lit(0)), F.size(ls))), F.flatten(parts))

            fences = F.filter(F.transform(ls, lambda s, i: F.when(is_fence(s), i)), lambda i: i.isNotNull())
            return let(fences, spread)

        return let(lines, toggled)
    marker = lambda s: F.regexp_extract(s, r"^\s*(```|~~~)", 1)
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<boolean>").alias("mask"))

    def step(state: Column, s: Column) -> Column:
        inside, m = state["open"] != "", marker(s)
        opened = F.when(~inside & (m != ""), m).when(inside & (m == state["open"]), F.lit("")).otherwise(state["open"])
        return F.struct(opened.alias("open"), F.array_append(state["mask"], inside | (m != "")).alias("mask"))

    return F.aggregate(lines, start, step, lambda state: state["mask"])


def asserted_text(text: Column) -> Column:
    """A message without what it quotes: fenced lines, block quotes and indented code become empty lines."""
    drop = lambda s, f: F.when(f | s.rlike(r"^(\s*>| {4}|\t)"), "").otherwise(s)
    return F.array_join(let(lines_of(text), lambda ls: F.zip_with(ls, fenced_mask(ls), drop)), "\n")


# Lines that are never prose.
VERBATIM = r"^\s*$|^ {0,3}#{1,6}(\s|$)|^\s*\||^\s*>|^\s*(```|~~~)|^( {4}|\t)|^\s*([-*_]\s*){3,}$|^\s*<[!/A-Za-z]|^[^\p{L}]*$"
DIRECTIVE = r"^\s*\{\{.*\}\}\s*$|^\s*\{%.*%\}\s*$|^\s*@[^\s@]+\s*$"
TRAILER = r"^[A-Z][A-Za-z-]*: \S"


def front_matter_end(lines: Column) -> Column:
    """Number of leading lines that are front matter between two lines of three dashes, else 0."""
    close = F.array_position(F.slice(lines, 2, 1 << 30), F.lit("---"))
    return F.when((F.get(lines, F.lit(0)) == "---") & (close > 0), close + 1).otherwise(F.lit(0))


def blocks_of(text: Column) -> Column:
    """Blocks of a document: array<struct<block_no, kind, start_line, end_line, marker, indent, text>>.

    Lines are classed by a grammar of single lines: blank lines, headings, table rows, quotes,
    fences and what they hold, indented code, rules, tags, directives, front matter and lines
    without a letter are verbatim, one block each, and so is a lone import of a path by `@`. Other lines that follow one another are one
    prose block; a list marker starts a new one. A prose block of trailer lines alone is verbatim.
    """
    def prose_of(ls: Column) -> Column:
        # one `^` before all branches: without it each of them is tried at every place of a line
        never = f"^(?:{VERBATIM}|{DIRECTIVE})"
        is_prose = lambda x, i, front: ~(x["fenced"] | (i < front) | x["line"].rlike(never))
        zipped = F.zip_with(ls, fenced_mask(ls), lambda s, f: F.struct(s.alias("line"), f.alias("fenced")))
        return let(front_matter_end(ls), lambda front: F.transform(zipped, lambda x, i: is_prose(x, i, front)))

    def starts_of(ls: Column, prose: Column) -> Column:
        starts = lambda i: (i == 0) | ~F.get(prose, i) | ~F.get(prose, i - 1) | F.get(ls, i).rlike(LIST_MARKER)
        return F.filter(F.sequence(F.lit(0), F.size(ls) - 1), starts)

    def block(ls: Column, prose: Column, starts: Column, s: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(ls))

        def made(own: Column) -> Column:
            first = F.get(own, F.lit(0))
            trimmed = F.filter(F.transform(own, lambda x: F.btrim(x, F.lit(" \t\n\r"))), lambda x: x != "")
            kind = F.when(F.get(prose, s) & ~F.forall(own, lambda x: x.rlike(TRAILER)), "prose").otherwise("verbatim")
            return F.struct(
                (k + 1).alias("block_no"), kind.alias("kind"), (s + 1).alias("start_line"), end.alias("end_line"),
                F.regexp_extract(first, LIST_MARKER, 2).alias("marker"), F.regexp_extract(first, r"^([ \t]*)", 1).alias("indent"),
                F.array_join(trimmed, " ").alias("text"),
            )

        return let(F.slice(ls, s + 1, end - s), made)

    return let(lines_of(text), lambda ls: let(prose_of(ls), lambda prose: let(
        starts_of(ls, prose), lambda starts: F.transform(starts, lambda s, k: block(ls, prose, starts, s, k)))))


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the columns of blocks_of, one row for each block."""
    return exploded(docs, ["doc_id"], blocks_of(F.col(text)), "b").select("doc_id", "b.*")


# What counts as no words of a prose text, and the placeholder that stands for it.
PLACEHOLDERS = (
    (r"(`+)[^`]+\1", " CODE "),
    (r"\[#x[0-9A-Fa-f]+(?:-#x[0-9A-Fa-f]+)?\]", " "),
    (r"\[§[^\]\s]*\]\([^)\s]*\)", "§"),
    (r"\]\([^)]*\)", "](URL)"),
    (r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});", " ENTITY "),
    (r"\"[^\"\n]*\"|“[^”\n]*”", " QUOTE "),
)


def mask_prose(text: Column) -> Column:
    """Code spans, character ranges, section links, link targets, entities and quotations become placeholder words."""
    masked = text
    for pattern, instead in PLACEHOLDERS:
        masked = F.regexp_replace(masked, pattern, instead)
    # each pattern holds one of these characters, and most texts hold none
    return F.when(text.rlike("[`\\]&\"“]"), masked).otherwise(text)


def sections(docs: DataFrame, level: int = 2, text: str = "text") -> DataFrame:
    """doc_id, section_no, heading, n_lines, n_chars: what each heading of at most `level` opens; 0 is what stands before the first."""
    heading = f"^#{{1,{level}}} "

    def of_lines(ls: Column, fence: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.get(ls, i).rlike(heading) & ~F.get(fence, i))

        def section(starts: Column, s: Column, k: Column) -> Column:
            is_head = F.get(ls, s).rlike(heading) & ~F.get(fence, s)
            opens = F.get(ls, F.lit(0)).rlike(heading) & ~F.get(fence, F.lit(0))
            own = F.slice(ls, s + 1, F.coalesce(F.get(starts, k + 1), F.size(ls)) - s)
            return F.struct(
                (k + F.when(opens, 1).otherwise(0)).alias("section_no"), F.when(is_head, F.regexp_replace(F.get(ls, s), "^#+ +", "")).alias("heading"),
                F.size(own).alias("n_lines"), F.length(F.array_join(own, "\n")).alias("n_chars"),
            )

        return let(F.array_distinct(F.concat(F.array(F.lit(0)), heads)), lambda starts: F.transform(starts, lambda s, k: section(starts, s, k)))

    found = let(lines_of(F.col(text)), lambda ls: let(fenced_mask(ls), lambda fence: of_lines(ls, fence)))
    return docs.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*")


def comment_runs_of(text: Column) -> Column:
    """array<struct<start_line, end_line, prefix, n_lines, text>> of runs of line comments (//, #, --); blank lines end a run."""
    mark = r"^\s*(//|#|--)"

    def of_lines(ls: Column) -> Column:
        marked = lambda i: F.coalesce(F.get(ls, i).rlike(mark), F.lit(False))
        starts = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: marked(i) & ((i == 0) | ~marked(i - 1)))
        ends = F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: marked(i - 1) & ~marked(i))

        def run(s: Column, end: Column) -> Column:
            own = F.slice(ls, s + 1, end - s)
            said = F.array_join(F.transform(own, lambda x: F.btrim(F.regexp_replace(x, mark + "+", ""), F.lit(" \t"))), " ")
            return F.struct((s + 1).alias("start_line"), end.alias("end_line"), F.regexp_extract(F.get(ls, s), mark, 1).alias("prefix"), (end - s).alias("n_lines"), said.alias("text"))

        return F.zip_with(starts, ends, run)

    return F.when(text.rlike(r"(?m)^\s*(//|#|--)"), let(lines_of(text), of_lines))


def comment_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the columns of comment_runs_of, one row for each run."""
    return docs.select("doc_id", F.explode(comment_runs_of(F.col(text))).alias("r")).select("doc_id", "r.*")


def table_cells(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no, cell_no, cell of Markdown table rows; delimiter rows hold no cell."""
    rows = lines(docs, text).where(F.col("line").rlike(r"^\s*\|.*\|\s*$") & ~F.col("line").rlike(r"^[\s|:-]+$"))
    inner = F.regexp_replace("line", r"^\s*\||\|\s*$", "")
    return rows.select("doc_id", "line_no", F.posexplode(F.split(inner, r"\|", -1)).alias("at", "cell")).select(
        "doc_id", "line_no", (F.col("at") + 1).alias("cell_no"), F.trim("cell").alias("cell")
    )


def canonical_json(text: Column) -> Column:
    """A JSON text in one form: the keys of every object in order, at any depth, and no white space.

    The variant type keeps fields by name, so writing one orders them. Of a repeated key of the
    outermost object the last value counts; null where the text is no JSON, or repeats a key further down.
    """
    whole = F.try_parse_json(text)
    key = lambda k: F.regexp_replace(F.to_json(F.create_map(k, F.lit(0))), r"^\{|0\}$", "")
    placed = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"), e["value"].alias("value")))
    last = lambda es: F.filter(es, lambda e, i: ~F.coalesce(F.get(es, i + 1)["key"] == e["key"], F.lit(False)))
    # a value that is no JSON by itself was a string
    value = lambda v: F.coalesce(F.to_json(F.try_parse_json(v)), F.regexp_extract(F.to_json(F.create_map(F.lit("v"), v)), r'(?s)^\{"v":(.*)\}$', 1))
    repeated = let(let(F.array_sort(placed), last), lambda es: F.concat(F.lit("{"), F.array_join(F.transform(es, lambda e: F.concat(key(e["key"]), value(e["value"]))), ","), F.lit("}")))
    return F.when(whole.isNotNull(), F.to_json(whole)).otherwise(F.when(text.rlike(r"^\s*\{"), repeated))
