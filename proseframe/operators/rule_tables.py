"""Rules that a user gives as a table: phrases are joined by an inverted index, patterns are expressions."""

from __future__ import annotations

import functools

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rewrites import SPANS, Rewrite, cut, lookup, template
from .rules import At, Case, Rule, Segments, quoted, row_findings

#: rule_id, kind (drop, rewrite, flag or pattern), match, replace, surface, case_sensitive, test_in, test_out, clean
COLUMNS = "rule_id string, kind string, match string, replace string, surface string, case_sensitive boolean, test_in string, test_out string, clean string"
KINDS = ("drop", "rewrite", "flag", "pattern")
PHRASES = ("drop", "rewrite", "flag")
#: Patterns are expressions of the plan, and so are the phrases that a repair replaces; there may be so many.
MOST_PATTERNS, MOST_REPAIRS = 200, 2000
#: A word, or one mark.
TOKEN = r"[\p{L}\p{N}_'’-]+|[^\s\p{L}\p{N}_'’-]"
EDGE = r"[\p{L}\p{N}_]"


def tokens_of(text: Column) -> Column:
    """Words and marks of a text, as written; what stands in code, quotations and link labels is one mark that no phrase holds."""
    return F.regexp_extract_all(F.regexp_replace(text, SPANS, " \u0001 "), F.lit(f"({TOKEN}|\u0001)"), 1)


def phrase_matches(texts: DataFrame, phrases: DataFrame, text: str = "text", own: str | None = None) -> DataFrame:
    """The columns of texts but `text`, with phrase_id, pos (from 0, in tokens) and found of each phrase of phrases(phrase_id, match, case_sensitive) in them.

    An inverted index: a phrase is filed under all its tokens in lower case, and the runs of tokens of the
    texts that are as long as some phrase are joined to that. So ten thousand phrases are one join, and a
    pair of it is a match, however many phrases have a token in common. Phrases without a token, and null
    texts, match nothing. `own` names a column of texts that has to equal phrase_id.
    """
    filed = phrases.select("phrase_id", F.coalesce("case_sensitive", F.lit(False)).alias("exact"), tokens_of(F.col("match")).alias("want")).where(F.size("want") > 0)
    sizes = sorted(r["n"] for r in filed.select(F.size("want").alias("n")).distinct().collect())
    filed = filed.select("phrase_id", "exact", F.array_join("want", " ").alias("want")).withColumn("_key", F.lower("want"))  # no token holds a blank
    keep = [c for c in texts.columns if c != text]
    rows = texts.select(*keep, tokens_of(F.col(text)).alias("_tokens"))
    rows = rows.select(*keep, "_tokens", F.explode(F.array(*map(F.lit, sizes or [1]))).alias("_n")).where(F.size("_tokens") >= F.col("_n"))
    # tokens are got one by one: a slice would copy the whole array for every run
    run = lambda i: F.coalesce(*(F.when(F.col("_n") == n, F.concat_ws(" ", *(F.get("_tokens", i + k) for k in range(n)))) for n in sizes or [1]))
    rows = rows.select(*keep, F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_tokens") - F.col("_n")), run)).alias("pos", "found"))
    rows = rows.withColumn("_key", F.lower("found"))
    on = rows["_key"] == filed["_key"]
    fits = ~F.col("exact") | (F.col("found") == F.col("want"))
    return rows.join(filed, on if own is None else on & (rows[own] == filed["phrase_id"])).where(fits).select(*keep, "phrase_id", "pos", "found")


def _replaced(text: Column, kind: Column, match: Column, instead: Column) -> Column:
    """What a phrase row makes of its own example."""
    phrase = F.concat(F.lit(rf"(?i)(?<!{EDGE})\Q"), match, F.lit(rf"\E(?!{EDGE})"), F.when(kind == "drop", r",?\s*").otherwise(""))
    return F.regexp_replace(text, F.when(kind == "pattern", match).otherwise(phrase), F.coalesce(instead, F.lit("")))


def _compiles(rows: DataFrame, pattern: str) -> bool:
    try:
        rows.sparkSession.range(1).select(F.lit("").rlike(pattern)).collect()
    except PySparkException:
        return False
    return True


def table_problems(rows: DataFrame) -> DataFrame:
    """rule_id, match, problem of every row of a rule table that can't be used: one that is malformed, repeats another, does not fire on its own example, makes something else of it, or fires on its clean text."""
    named = rows.withColumn("phrase_id", F.xxhash64("rule_id", "kind", "match", "surface", "replace"))
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    simple = (
        F.when(blank("rule_id") | ~F.coalesce(F.col("rule_id").rlike(r"^[\w-]+/[\w-]+$"), F.lit(False)), "it has no id with a category")
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "its kind is none of " + ", ".join(KINDS))
        .when(blank("match"), "it matches nothing").when(blank("test_in"), "it has no example")
        .when((F.col("kind") == "rewrite") & F.coalesce(F.lower("match") == F.lower("replace"), F.lit(True)), "it writes what it found")
    )
    bad = named.withColumn("problem", simple)
    broken = [r["match"] for r in rows.where("kind = 'pattern'").select("match").distinct().limit(MOST_PATTERNS + 1).collect() if not _compiles(rows, r["match"])]
    if broken:
        bad = bad.withColumn("problem", F.coalesce("problem", F.when((F.col("kind") == "pattern") & F.col("match").isin(broken), "its pattern does not compile")))
    usable = bad.where("problem is null")
    # each row's own example and clean text are texts of the index; only its own phrase is looked for there
    phrases = usable.where(F.col("kind").isin(*PHRASES)).select("phrase_id", "match", "case_sensitive").dropDuplicates(["phrase_id"])
    hits = lambda c: phrase_matches(usable.select(F.col("phrase_id").alias("of"), F.col(c).alias("text")), phrases, own="of").select(F.col("phrase_id").alias("of")).distinct().withColumn(f"hit_{c}", F.lit(True))
    tried = usable.join(hits("test_in"), usable["phrase_id"] == F.col("of"), "left").drop("of").join(hits("clean"), F.col("phrase_id") == F.col("of"), "left").drop("of")
    by_pattern = F.col("kind") == "pattern"
    fires = lambda c: F.coalesce(F.when(by_pattern, F.regexp_like(F.col(c), F.col("match"))).otherwise(F.col(f"hit_{c}")), F.lit(False))
    same = lambda a, b: F.lower(F.btrim(a)) == F.lower(F.btrim(b))
    made = _replaced(F.col("test_in"), F.col("kind"), F.col("match"), F.col("replace"))
    tested = F.when(~fires("test_in"), "it does not fire on its example").when(fires("clean"), "it fires on its clean text").when(
        (F.col("kind") != "flag") & F.col("test_out").isNotNull() & ~same(made, F.col("test_out")), "it makes something else of its example")
    found = bad.where("problem is not null").select("rule_id", "match", "problem").unionByName(tried.withColumn("problem", tested).where("problem is not null").select("rule_id", "match", "problem"))
    repeated = named.groupBy("rule_id", "match", "surface").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rule_id", "match", F.lit("it stands in the table twice").alias("problem"))
    return found.unionByName(repeated)


def load_rules(rows: DataFrame, surface: str = "document") -> DataFrame:
    """The rows of a rule table that a surface reads; an error names the first that can't be used."""
    problems = table_problems(rows).limit(20).collect()
    if problems:
        raise ValueError("; ".join(f"{r['rule_id']} {r['match']!r}: {r['problem']}" for r in problems))
    return rows.where(F.coalesce("surface", F.lit("both")).isin("both", surface))


def _patterns(rows: DataFrame) -> list:
    found = rows.where("kind = 'pattern'").orderBy("rule_id", "match").limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} patterns in one table; phrases may be as many as you like")
    return found


def _of_pattern(b: At, pattern: str) -> Column:
    free = F.regexp_replace(b.text, SPANS, " ")
    each = F.regexp_extract_all(free, F.lit(f"({template(pattern, '').plain})"), 1)
    return F.transform(each, lambda h: b.here("a pattern of the table", F.btrim(h), ""))


def table_findings(segments: Segments, rows: DataFrame) -> DataFrame:
    """Findings of a rule table in the full schema: all phrases by one join, all patterns in one scan."""
    named = rows.where(F.col("kind").isin(*PHRASES)).withColumn("phrase_id", F.xxhash64("rule_id", "kind", "match", "surface", "replace"))
    hits = phrase_matches(segments.prose.select("doc_id", "start_line", "end_line", "text"), named.select("phrase_id", "match", "case_sensitive"))
    what = F.when(F.col("kind") == "flag", "a flagged phrase").when(F.col("kind") == "drop", "a phrase that says nothing").otherwise("a phrase with a better one")
    fix = F.when(F.col("kind") == "drop", "Cut it.").when(F.col("kind") == "rewrite", F.concat(F.lit("Write "), F.col("replace"), F.lit("."))).otherwise("")
    found = hits.join(named.select("phrase_id", "rule_id", "kind", "replace"), "phrase_id").select(
        "doc_id", F.col("start_line").alias("line"), "end_line", "rule_id", F.substring_index("rule_id", "/", 1).alias("category"), what.alias("rule"),
        quoted(F.col("found")).alias("detail"), fix.alias("fix"), F.lit("error").alias("severity"), (F.col("kind") != "flag").alias("repairable"), F.lit(None).cast("long").alias("measured"),
    )
    patterns = _patterns(rows)
    if not patterns:
        return found
    made = [Rule(r["rule_id"], level="block", find=functools.partial(_of_pattern, pattern=r["match"]), cases=(Case("own", r["test_in"]),)) for r in patterns]
    return found.unionByName(row_findings(segments.docs, made, segments.limits))


def table_repairs(rows: DataFrame, place: int = 40) -> list[Rule]:
    """Rules that repair by the rows that replace something, for `repair`; each id is a rule."""
    chosen = rows.where(F.col("kind").isin("drop", "rewrite") | ((F.col("kind") == "pattern") & F.col("replace").isNotNull()))
    found = chosen.orderBy("rule_id", "match").limit(MOST_REPAIRS + 1).collect()
    if len(found) > MOST_REPAIRS:
        raise ValueError(f"over {MOST_REPAIRS} rows that repair in one table")
    made: dict[str, list[Rewrite]] = {}
    swaps: dict[str, dict[str, str]] = {}
    for r in found:
        if r["kind"] == "rewrite":
            swaps.setdefault(r["rule_id"], {})[r["match"].lower()] = r["replace"]
        elif r["kind"] == "drop":
            made.setdefault(r["rule_id"], []).append(cut(rf"(?i)(?<!{EDGE})\Q{r['match']}\E(?!{EDGE}),?\s*"))
        else:
            made.setdefault(r["rule_id"], []).append(template(r["match"], r["replace"]))
    for k, table in swaps.items():
        made.setdefault(k, []).append(lookup(table))
    return [Rule(k, repair=lambda t: t, place=place, rewrites=tuple(x)) for k, x in sorted(made.items())]
