"""Queries over the driver tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .functions import kinds as K
from .functions import segment as S
from .functions import wordlists as L
from .operators import dead_names, inventory, near_lines, numbering, references, repair, rule_tables, rules, sessions, snapshots
from .operators.word_match import WordClass, class_matches
from .plans import check as plan
from .sources.tables import file_kind, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- SQL parts -------------------------------------------------------------------------------------

BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
SQL_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"
SQL_WORD = "'[A-Za-z]+(?:''[A-Za-z]+)?'"


def sql_sentences(text: str) -> str:
    held = rf"regexp_replace({text}, '(?i)(^|[\s(])({'|'.join(a.replace('.', chr(92) + '.') for a in L_ABBREVIATIONS)})\.', '\1\2' || chr(2), 'g')"
    cut = rf"regexp_replace({held}, '([.!?]+[)\]\"''*_”’»]*)\s+([\p{{Lu}}\p{{Nd}}(`''\"*_\[§¶“‘—–])', '\1' || chr(1) || '\2', 'g')"
    return f"[trim(x, {BLANKS}) FOR x IN string_split(replace({cut}, chr(2), '.'), chr(1)) IF trim(x, {BLANKS}) <> '']"


L_ABBREVIATIONS = S.ABBREVIATIONS


def sql_count(sentence: str) -> str:
    return rf"len(regexp_extract_all(regexp_replace({sentence}, '\([^()]*\)', ' x ', 'g'), {SQL_WORD}))"


SQL_BLOCKS = rf"""
{SQL_LINES},
classed AS (SELECT *, NOT regexp_matches(line, '{S.VERBATIM}') AS prose, regexp_matches(line, '{S.LIST_MARKER}') AS listed FROM l),
opened AS (SELECT *, CASE WHEN line_no = 1 OR NOT prose OR listed OR NOT lag(prose) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 1 ELSE 0 END AS o FROM classed),
numbered AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM opened),
blocks AS (
  SELECT doc_id, block_no, CASE WHEN bool_and(prose) AND NOT bool_and(regexp_matches(line, '{S.TRAILER}')) THEN 'prose' ELSE 'verbatim' END AS kind,
    min(line_no) AS start_line, max(line_no) AS end_line, bool_or(listed) AS listed,
    coalesce(string_agg(trim(line, {BLANKS}), ' ' ORDER BY line_no) FILTER (WHERE trim(line, {BLANKS}) <> ''), '') AS text
  FROM numbered GROUP BY doc_id, block_no)"""
SQL_MASKED = r"regexp_replace(regexp_replace(regexp_replace(text, '`[^`]+`', ' CODE ', 'g'), '&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});', ' ENTITY ', 'g'), '\"[^\"\n]*\"|“[^”\n]*”', ' QUOTE ', 'g')"
SQL_PROSE = SQL_BLOCKS + f", prose AS (SELECT *, {SQL_MASKED} AS masked FROM blocks WHERE kind = 'prose')"
SQL_SENTENCES = SQL_PROSE + f""",
sent AS (SELECT doc_id, block_no, start_line, end_line, listed, unnest({sql_sentences('masked')}) AS sentence, unnest(range(len({sql_sentences('masked')}))) AS sent_no FROM prose),
s AS (SELECT *, {sql_count('sentence')} AS n_words FROM sent)"""
SQL_TOKENS = SQL_SENTENCES + f""",
t AS (SELECT doc_id, block_no, sent_no, start_line, end_line, unnest(regexp_extract_all(sentence, {SQL_WORD})) AS word,
  unnest(range(len(regexp_extract_all(sentence, {SQL_WORD})))) AS pos FROM s)"""


def quoted_sql(text: str) -> str:
    flat = rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) > 60 THEN substr({flat}, 1, 60) || '...' ELSE {flat} END"


def in_sql(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


# --- scans, segmentation ---------------------------------------------------------------------------


@query("SELECT source, lang, count(*) AS n_docs, sum(length(text)) AS n_chars FROM documents GROUP BY source, lang")
def a1_corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(p, '(^|/)\.github/workflows/') THEN 'workflow'
  WHEN regexp_matches(p, '(?i)\.(go|rs|py|js|ts|tsx|jsx|java|c|cc|cpp|h|hpp|cs|rb|php|sh|sql|swift|kt|scala)$') OR regexp_matches(p, '(?i)\.ya?ml$') THEN 'source'
  ELSE 'document' END AS kind, length(html) AS n_chars FROM (SELECT page_id, html, regexp_replace(url, '[?#].*$', '') AS p FROM pages)""")
def a2_file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", file_kind(F.regexp_replace("url", "[?#].*$", "")).alias("kind"), F.length("html").alias("n_chars"))


def lexicon_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, c) for c in L.CLASSES for w in L.class_words(c)], "word string, class string")


@query(f"WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, {SQL_WORD}))) AS word FROM documents), x(word, class) AS (VALUES "
       + ", ".join(f"('{w}', '{c}')" for c in L.CLASSES for w in L.class_words(c)) + ") SELECT class, count(*) AS n_words, count(DISTINCT doc_id) AS n_docs FROM w JOIN x USING (word) GROUP BY class")
def a6_rule_table_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = S.words(docs_of(spark, sf_dir)).select("doc_id", F.lower("word").alias("word"))
    found = words.join(lexicon_rows(spark), "word")
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("n_words"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {SQL_LINES} SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest, sha256(string_agg(line, '|' ORDER BY line_no)) AS digest FROM l GROUP BY doc_id")
def b1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.lines(docs_of(spark, sf_dir)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return rows.select("doc_id", F.size("l").alias("n_lines"), F.array_max(F.transform("l.line", F.length)).alias("longest"), F.sha2(F.array_join("l.line", "|"), 256).alias("digest"))


@query(f"WITH {SQL_BLOCKS} SELECT doc_id, block_no, kind, start_line, end_line, length(text) AS n_chars, md5(text) AS digest FROM blocks")
def b3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.blocks(docs_of(spark, sf_dir))
    return rows.select("doc_id", "block_no", "kind", "start_line", "end_line", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH s AS (SELECT doc_id, unnest({sql_sentences('text')}) AS sentence, unnest(range(1, len({sql_sentences('text')}) + 1)) AS sent_no FROM documents) SELECT doc_id, sent_no, md5(sentence) AS digest, {sql_count('sentence')} AS n_words FROM s")
def b7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sentences(docs_of(spark, sf_dir)).select("doc_id", "sent_no", F.md5(F.col("sentence").cast("binary")).alias("digest"), "n_words")


@query(r"""WITH m AS (SELECT conv_id, turn, [trim(x, ' ' || chr(9) || chr(13)) FOR x IN string_split(replace(regexp_replace(text, '([.!?]+)([^A-Za-z0-9.!?]|$)', '\1' || chr(1) || '\2', 'g'), chr(10), chr(1)), chr(1))
  IF trim(x, ' ' || chr(9) || chr(13)) <> ''] AS s FROM conversations)
SELECT conv_id, turn, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM m""")
def b8_message_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", S.message_sentences_of(F.col("text")).alias("s"))
    return rows.select("conv_id", "turn", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, {sql_count('text')} AS n_words, len(regexp_extract_all(text, {SQL_WORD})) AS n_raw FROM documents")
def b9_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_of(spark, sf_dir)
    return rows.select("doc_id", S.word_count(F.col("text")).alias("n_words"), F.size(S.words_of(F.col("text"))).alias("n_raw"))


@query("WITH w AS (SELECT doc_id, [x FOR x IN string_split_regex(text, '[^A-Za-z0-9_]+') IF x <> ''] AS w FROM documents) SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct FROM w")
def b10_identifier_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_of(spark, sf_dir).select("doc_id", S.identifier_words_of(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))


@query("""WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events)
SELECT event_id, '{"a":[{"k":' || k || '},1],"z":{"b":{"k":' || k || '},"y":null}}' AS canonical FROM k""")
def b14_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties inside objects and arrays, whose keys stand in no order."""
    nested = F.concat(F.lit('{ "z": {"y": null, "b":'), F.col("props"), F.lit('}, "a": ['), F.col("props"), F.lit(", 1.0]}"))
    return table(spark, sf_dir, "events").select("event_id", S.canonical_json(nested).alias("canonical"))


# --- filters, joins --------------------------------------------------------------------------------

WRAP_SQL = SQL_PROSE + f""", w AS (
  SELECT doc_id, unnest(range(start_line + 1, end_line + 1)) AS line, 'wrap/hard-wrap' AS rule_id FROM prose WHERE end_line > start_line
  UNION ALL SELECT doc_id, start_line, 'wrap/long-block' FROM prose WHERE length(text) > 1500
  UNION ALL SELECT doc_id, line_no, 'wrap/wide-line' FROM l WHERE length(line) > 150 AND NOT regexp_matches(line, '^\\s*\\|') AND regexp_matches(trim(line), '\\s'))"""
WARNING_SQL = "rule_id IN ('wrap/wide-line', 'ste/paragraph-length')"
#: The rules of the queries about a whole run, of several families, and their findings as the table w.
RUN_RULES = ["ste/paragraph-length", "ste/sentence-length", "wrap"]
RUN_SQL = WRAP_SQL.replace(SQL_PROSE, SQL_SENTENCES).replace(", w AS (", f""", w AS (
  SELECT doc_id, start_line AS line, 'ste/sentence-length' AS rule_id FROM s WHERE n_words > 25
  UNION ALL SELECT doc_id, start_line, 'ste/paragraph-length' FROM prose WHERE NOT listed AND len({sql_sentences('masked')}) > 6
  UNION ALL""")


@query(f"WITH {WRAP_SQL} SELECT rule_id, count(*) AS n_findings, count(DISTINCT doc_id) AS n_docs FROM w GROUP BY rule_id")
def c1_select_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.check(docs_of(spark, sf_dir), ["wrap"]).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("doc_id").alias("n_docs"))


@query(f"WITH {RUN_SQL} SELECT doc_id, bool_or(NOT {WARNING_SQL}) AS failed FROM w GROUP BY doc_id")
def c2_severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.check(docs_of(spark, sf_dir), RUN_RULES).groupBy("doc_id").agg(F.bool_or(F.col("severity") == "error").alias("failed"))


@query("WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS token FROM documents) SELECT doc_id, token FROM w WHERE regexp_matches(token, '^[0-9a-f]{7,40}$') AND regexp_matches(token, '[0-9]') AND regexp_matches(token, '[a-f]')")
def c6_sha_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.sha_references(docs_of(spark, sf_dir))


@query(f"WITH {SQL_BLOCKS} SELECT doc_id, block_no FROM blocks WHERE regexp_matches(text, '(?i)licen[sc]e')")
def c7_license_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(docs_of(spark, sf_dir)).where(K.is_license_notice(F.col("text"), "(?i)licen[sc]e")).select("doc_id", "block_no")


SQL_TRIMMED = f"{SQL_LINES}, tl AS (SELECT doc_id, line_no, trim(line, {BLANKS} || chr(11) || chr(12)) AS line FROM l WHERE trim(line, {BLANKS} || chr(11) || chr(12)) <> '')"
SQL_NEAR = SQL_TRIMMED + """,
k AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS occ FROM tl),
n AS (SELECT doc_id, count(*) AS n FROM tl GROUP BY doc_id),
c AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS common FROM k a JOIN k b ON a.line = b.line AND a.occ = b.occ AND a.doc_id < b.doc_id GROUP BY 1, 2),
sh AS (SELECT doc_a, doc_b, 2.0 * common / (x.n + y.n) AS share FROM c JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b),
near AS (SELECT min(doc_a) AS doc_a, doc_b, arg_min(share, doc_a) AS share FROM sh WHERE share >= 0.95 GROUP BY doc_b),
have AS (SELECT doc_id, line, max(occ) AS have FROM k GROUP BY doc_id, line),
held AS (SELECT near.doc_a, near.doc_b, k.line_no FROM near JOIN k ON k.doc_id = near.doc_b JOIN have h ON h.doc_id = near.doc_a AND h.line = k.line WHERE k.occ <= h.have),
isl AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_a, doc_b ORDER BY line_no) AS i FROM held),
por AS (SELECT doc_a, doc_b, min(line_no) AS "start", max(line_no) AS "end" FROM isl GROUP BY doc_a, doc_b, i)"""


@query(f"WITH {SQL_NEAR} SELECT doc_a, doc_b, CAST(share AS DOUBLE) AS share FROM near")
def d4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_lines.near_duplicates(docs_of(spark, sf_dir))


SQL_WORDS_OF = "w AS (SELECT doc_id, unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS word FROM documents)"


@query(f"""WITH {SQL_WORDS_OF}, df AS (SELECT word, count(DISTINCT doc_id) AS n_docs FROM w WHERE word <> '' GROUP BY word),
c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE regexp_matches(word, '^[A-Za-z]{{8,}}$') GROUP BY doc_id, word),
few AS (SELECT doc_id FROM c GROUP BY doc_id HAVING count(*) <= 40)
SELECT doc_id, word AS name FROM c JOIN df USING (word) WHERE n = 1 AND n_docs = 1 AND doc_id IN (SELECT doc_id FROM few)""")
def d5_dead_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_names.dead_names(docs_of(spark, sf_dir), F.col("word").rlike("^[A-Za-z]{8,}$"))


@query(f"WITH {SQL_WORDS_OF} SELECT word, count(DISTINCT doc_id) AS n_docs FROM w WHERE word <> '' GROUP BY word")
def e2_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dead_names.document_frequency(docs_of(spark, sf_dir))


# two snapshots: the head is all documents, the base lacks one language and, in every text, the lines of lengths that 7 divides
SQL_SNAPSHOTS = f"""{SQL_LINES},
bl AS (SELECT l.* FROM l JOIN documents d USING (doc_id) WHERE d.lang <> 'es' AND length(line) % 7 <> 0),
base AS (SELECT doc_id, coalesce((SELECT 1), 1) AS one FROM documents WHERE lang <> 'es'),
hk AS (SELECT doc_id, line, line_no, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS occ FROM l),
bk AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS occ FROM bl),
own AS (SELECT doc_id, line_no, line FROM hk WHERE NOT EXISTS (SELECT 1 FROM bk WHERE bk.doc_id = hk.doc_id AND bk.line = hk.line AND bk.occ = hk.occ))"""


def snapshots_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(base, head)."""
    rows = table(spark, sf_dir, "documents")
    kept = F.array_join(F.filter(S.lines_of(F.col("text")), lambda s: F.length(s) % 7 != 0), "\n")
    return rows.where("lang != 'es'").select("doc_id", kept.alias("text"), F.col("source").alias("path")), rows.select("doc_id", "text", F.col("source").alias("path"))


@query(f"WITH {SQL_SNAPSHOTS} SELECT doc_id, line_no, md5(line) AS digest FROM own")
def d7_changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshots.changed_lines(*snapshots_of(spark, sf_dir))
    return rows.select("doc_id", "line_no", F.md5(F.col("line").cast("binary")).alias("digest"))


@query("SELECT doc_id FROM documents WHERE lang = 'es'")
def d8_new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.new_documents(*snapshots_of(spark, sf_dir)).select("doc_id")


SQL_BASE_TEXT = f"""{SQL_LINES}, bt AS (SELECT doc_id, source, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE length(line) % 7 <> 0), '') AS text FROM l JOIN documents d USING (doc_id) WHERE d.lang <> 'es' GROUP BY doc_id, source)"""


@query(f"WITH {SQL_BASE_TEXT} SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM bt WHERE bt.source = d.source AND bt.text = d.text)")
def d9_without_known_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = snapshots_of(spark, sf_dir)
    return snapshots.without_known_versions(head, base).select("doc_id")


@query(f"WITH {SQL_SNAPSHOTS}, {SQL_PROSE.replace(SQL_LINES + ',', '')} SELECT doc_id, start_line AS line, end_line FROM prose WHERE length(text) > 1500 AND EXISTS (SELECT 1 FROM own WHERE own.doc_id = prose.doc_id AND own.line_no BETWEEN start_line AND end_line)")
def d10_owned_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = snapshots_of(spark, sf_dir)
    return plan.check(head, ["wrap/long-block"], owned=snapshots.changed_lines(base, head)).select("doc_id", "line", "end_line")


@query("""WITH s AS (SELECT 's' || CAST(turn AS VARCHAR) AS snapshot, turn AS seq, conv_id AS path, md5(text) AS digest FROM conversations),
h AS (SELECT conv_id AS path, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id),
d AS (SELECT snapshot, seq, count(*) AS n, count(h.digest) AS common, count(*) FILTER (WHERE h.digest = s.digest) AS same FROM s LEFT JOIN h USING (path) GROUP BY snapshot, seq)
SELECT snapshot, n + (SELECT count(*) FROM h) - common - same AS n_diff FROM d ORDER BY n_diff, seq DESC LIMIT 1""")
def d11_nearest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn numbers are snapshots of all conversations; the head has each conversation's last text."""
    rows = table(spark, sf_dir, "conversations").withColumn("digest", F.md5(F.col("text").cast("binary")))
    head = rows.groupBy(F.col("conv_id").alias("path")).agg(F.max_by("digest", "turn").alias("digest"))
    old = rows.select(F.concat(F.lit("s"), F.col("turn").cast("string")).alias("snapshot"), F.col("turn").alias("seq"), F.col("conv_id").alias("path"), "digest")
    return snapshots.nearest_snapshot(head, old)


@query(f"""WITH {SQL_BASE_TEXT}, hn AS (SELECT doc_id, count(*) AS n_head FROM l WHERE length(line) > 150 AND regexp_matches(trim(line), '\\s') AND NOT regexp_matches(line, '^\\s*\\|') GROUP BY doc_id),
bln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM bt),
bn AS (SELECT doc_id, count(*) AS n_base FROM bln WHERE length(line) > 150 AND regexp_matches(trim(line), '\\s') AND NOT regexp_matches(line, '^\\s*\\|') GROUP BY doc_id)
SELECT doc_id, 'wrap/wide-line' AS rule_id, coalesce(n_base, 0) AS n_base, n_head FROM hn LEFT JOIN bn USING (doc_id) WHERE n_head > coalesce(n_base, 0)""")
def d12_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = snapshots_of(spark, sf_dir)
    return snapshots.regressions(plan.check(base, ["wrap/wide-line"]), plan.check(head, ["wrap/wide-line"]))


@query(f"WITH {SQL_BASE_TEXT} SELECT d.doc_id, length(d.text) AS n_chars, length(d.text) - coalesce(length(bt.text), 0) AS n_grown FROM documents d LEFT JOIN bt USING (doc_id)")
def d17_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.growth(*snapshots_of(spark, sf_dir))


DETERMINER, PREPOSITION = L.class_words("determiner") + L.class_words("article"), L.class_words("preposition")


@query(f"""WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, {SQL_WORD}))) AS w, unnest(range(len(regexp_extract_all(text, {SQL_WORD})))) AS pos FROM documents),
x AS (SELECT doc_id, pos, w, lead(w) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, w || ' ' || w1 || ' ' || w2 AS phrase FROM x WHERE w IN {in_sql(DETERMINER)} AND w1 NOT IN {in_sql(rules.closed_class_words())} AND w2 IN {in_sql(PREPOSITION)}""")
def d19_class_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A determiner, an open word and a preposition in a row, in the match language."""
    lexicon = {"determiner": WordClass(tuple(DETERMINER)), "preposition": WordClass(tuple(PREPOSITION)), "closed": WordClass(tuple(rules.closed_class_words())), "open": WordClass(open=True)}
    found = class_matches(docs_of(spark, sf_dir), lexicon, {"phrase": "{determiner} {open} {preposition}"}, "text")
    return found.select("doc_id", F.col("start").alias("pos"), F.lower("phrase").alias("phrase"))


# --- aggregations ----------------------------------------------------------------------------------


@query(f"WITH {RUN_SQL} SELECT CASE WHEN grouping(rule_id) = 1 AND grouping(category) = 1 THEN NULL ELSE category END AS category, rule_id, severity, count(*) AS n_findings FROM (SELECT *, split_part(rule_id, '/', 1) AS category, CASE WHEN {WARNING_SQL} THEN 'warning' ELSE 'error' END AS severity FROM w) GROUP BY ROLLUP (category, rule_id, severity)")
def e1_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.summary(plan.check(docs_of(spark, sf_dir), RUN_RULES))


@query(f"WITH {SQL_PROSE} SELECT doc_id, start_line AS line, len({sql_sentences('masked')}) AS n FROM prose WHERE NOT listed AND len({sql_sentences('masked')}) > 6")
def e3_long_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.check(docs_of(spark, sf_dir), ["ste/paragraph-length"])
    return rows.select("doc_id", "line", F.col("measured").alias("n"))


@query("SELECT user_id, date_trunc('day', ts) AS day, string_agg(event_type, chr(10) ORDER BY event_type) AS sig, count(*) AS n_calls FROM events GROUP BY 1, 2")
def e5_turn_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day is a turn, an event type a call."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return sessions.turn_signatures(rows, ["user_id", "day"], "event_type")


@query(f"WITH {SQL_TRIMMED} SELECT DISTINCT doc_id, line FROM tl WHERE regexp_matches(line, '(?i)(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)')")
def e9_distinct_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_lines.trimmed_lines(docs_of(spark, sf_dir)).where(F.col("line").rlike("(?i)(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])"))
    return rows.select("doc_id", "line").dropDuplicates()


SQL_TURNS = "tn AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations)"


@query(f"WITH {SQL_TURNS} SELECT conv_id AS session, bool_or(length(text) > 200) AS used FROM tn WHERE turn_no = (SELECT max(turn_no) FROM tn t2 WHERE t2.conv_id = tn.conv_id) GROUP BY conv_id")
def e11_used_in_last_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a record since the last user's one is longer than 200 characters."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session")
    return sessions.used_tool(rows, "session", ["turn"], F.col("role") == "user", F.length("text") > 200)


SQL_MARKS = {k: f"len([x FOR x IN string_split(html, chr(10)) IF regexp_matches(x, '{p}')])" for k, p in K.MARKS.items()}


@query("SELECT page_id, " + ", ".join(f"{v} AS n_{k}" for k, v in SQL_MARKS.items()) + " FROM pages")
def e12_language_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = K.mark_counts(F.split("html", "\n", -1))
    return table(spark, sf_dir, "pages").select("page_id", *(v.alias(f"n_{k}") for k, v in counts.items()))


# --- windows ---------------------------------------------------------------------------------------

SQL_STREAKS = """e AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER p AS pt, lag(ts) OVER p AS pts FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(CASE WHEN pt = event_type AND epoch_us(ts) - epoch_us(pts) <= 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e),
r AS (SELECT user_id AS session, any_value(event_type) AS sig, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM i GROUP BY user_id, island)"""


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a turn of no length of its user."""
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("session"), F.col("event_type").alias("sig"), F.col("ts").alias("started_at"), F.col("ts").alias("ended_at"), "event_id")


@query(f"WITH {SQL_STREAKS} SELECT session, sig, n, first_at, last_at FROM r WHERE n >= 3")
def g1_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three equal types of a user with gaps of six hours or less."""
    rows = sessions.streaks(event_turns(spark, sf_dir), 6 * 3600, ("started_at", "event_id")).where("n >= 3")
    return rows.select("session", "sig", "n", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_at", "last_at")))


@query(f"WITH {SQL_TURNS} SELECT conv_id, turn_no, count(*) AS n_records, sum(length(text)) AS n_chars FROM tn GROUP BY conv_id, turn_no")
def g2_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.turn_numbers(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.col("role") == "user")
    return rows.groupBy("conv_id", "turn_no").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.length("text")).alias("n_chars"))


@query("""SELECT event_id, user_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last_ts FROM events) WHERE epoch_us(ts) >= epoch_us(last_ts) - 86400000000""")
def g4_recent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of each user."""
    return sessions.recent_records(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "ts", 86_400).select("event_id", "user_id")


@query(f'WITH {SQL_NEAR} SELECT doc_a, doc_b, "start", "end" FROM por')
def g5_copied_portions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    return near_lines.copied_portions(docs, near_lines.near_duplicates(docs))


SQL_RANGES = SQL_SENTENCES + """, lg AS (SELECT doc_id, start_line AS s, end_line AS e FROM s WHERE n_words > 25 UNION ALL SELECT doc_id, line_no, line_no + 2 FROM l WHERE length(line) > 150)"""


@query(f"""WITH {SQL_RANGES}, m AS (SELECT doc_id, s, e, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lg),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT doc_id, min(s) AS "start", max(e) AS "end" FROM g GROUP BY doc_id, i""")
def g6_merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of long sentences, and of wide lines with the two lines after them, merged."""
    docs = docs_of(spark, sf_dir)
    long = rules.Segments(docs).sentences.where("n_words > 25").select("doc_id", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    wide = S.lines(docs).where(F.length("line") > 150).select("doc_id", F.col("line_no").alias("start"), (F.col("line_no") + 2).alias("end"))
    return near_lines.merged_ranges(long.union(wide), ["doc_id"])


@query(f"""WITH {SQL_SNAPSHOTS}, f AS (SELECT l.doc_id, l.line_no, own.line IS NOT NULL AS owned, regexp_matches(l.line, '[\\p{{L}}\\p{{N}}]') AS worded FROM l LEFT JOIN own USING (doc_id, line_no)),
n AS (SELECT *, last_value(CASE WHEN worded THEN owned END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up,
  first_value(CASE WHEN worded THEN owned END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down FROM f)
SELECT doc_id, line_no FROM n WHERE owned OR (NOT worded AND coalesce(up, false) AND coalesce(down, false))""")
def g7_claimed_wordless_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = snapshots_of(spark, sf_dir)
    return snapshots.claim_wordless(head, snapshots.changed_lines(base, head))


@query(f"WITH {SQL_SNAPSHOTS}, {SQL_BLOCKS.replace(SQL_LINES + ',', '')}, hit AS (SELECT DISTINCT b.doc_id, b.block_no, b.start_line, b.end_line FROM blocks b JOIN own ON own.doc_id = b.doc_id AND own.line_no BETWEEN b.start_line AND b.end_line) SELECT doc_id, unnest(range(start_line, end_line + 1)) AS line_no FROM hit")
def g8_widened_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = snapshots_of(spark, sf_dir)
    return snapshots.widen_to_blocks(head, snapshots.changed_lines(base, head))


G9_MEMBER = "[A-Za-zÀ-ÿ]{3,}"


@query(rf"""WITH s AS (SELECT doc_id, unnest({sql_sentences('text')}) AS s, unnest(range(len({sql_sentences('text')}))) AS pos FROM documents),
t AS (SELECT doc_id, pos, [regexp_replace(x, '^[(\[\"''*_]+|[.,;:!?)\]\"''*_]+$', '', 'g') FOR x IN regexp_extract_all(s, '`[^`]+`[.,;:!?]*|[^\s\x0B]+')] AS w FROM s),
k AS (SELECT doc_id, pos, CASE WHEN len([x FOR x IN w IF regexp_full_match(x, '{G9_MEMBER}')]) > 0 THEN array_to_string([CASE WHEN regexp_full_match(x, '{G9_MEMBER}') THEN '□' ELSE lower(x) END FOR x IN w], ' ') END AS key FROM t),
n AS (SELECT *, CASE WHEN key IS NOT DISTINCT FROM lag(key) OVER (PARTITION BY doc_id ORDER BY pos) AND pos > 0 THEN 0 ELSE 1 END AS new FROM k),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM n)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start, CAST(count(*) AS INTEGER) AS n, any_value(key) AS key FROM i WHERE key IS NOT NULL GROUP BY doc_id, run HAVING count(*) > 1""")
def g9_runs_of_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that follow one another with one frame, where any word of three letters or more counts as a member."""
    keys = F.transform(S.sentences_of(F.col("text")), lambda s: inventory.frame_key(s, G9_MEMBER))
    return docs_of(spark, sf_dir).select("doc_id", F.explode(inventory.equal_runs(keys, least=2)).alias("r")).select("doc_id", "r.*")


SQL_SLUG = r"array_to_string([w FOR w IN string_split_regex(lower(title), '[^\p{L}\p{N}]+') IF w <> ''][1:3], '-')"


@query(f"""WITH t AS (SELECT doc_id, source, string_split(text, chr(10))[1] AS title FROM documents), s AS (SELECT *, {SQL_SLUG} AS slug FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY source, slug ORDER BY doc_id) AS rn FROM s)
SELECT doc_id, CASE WHEN rn = 1 THEN slug ELSE slug || '-' || CAST(rn AS VARCHAR) END AS slug FROM n""")
def g10_unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of a document as its title; equal slugs of a source are numbered."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", references.slug(F.get(S.lines_of(F.col("text")), F.lit(0))).alias("slug"))
    return numbering.numbered(rows, ["source", "slug"], "doc_id").select("doc_id", F.when(F.col("rn") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("rn").cast("string"))).alias("slug"))


@query(f"""WITH {RUN_SQL}, r AS (SELECT doc_id, line, rule_id, row_number() OVER (PARTITION BY doc_id ORDER BY {WARNING_SQL}, NOT {WARNING_SQL} AND rule_id LIKE 'wrap/%', line, rule_id) AS rn, count(*) OVER (PARTITION BY doc_id) AS total FROM w)
SELECT doc_id, line, rule_id, rn, CASE WHEN rn = 5 AND total > 5 THEN total - 5 ELSE 0 END AS hidden FROM r WHERE rn <= 5""")
def g11_top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five findings of each document, warnings last."""
    rows = plan.top_findings(plan.check(docs_of(spark, sf_dir), RUN_RULES), 5)
    return rows.select("doc_id", "line", "rule_id", "rn", "hidden")


@query(f"WITH {SQL_PROSE} SELECT doc_id, unnest(range(start_line + 1, end_line + 1)) AS line, start_line FROM prose WHERE end_line > start_line")
def g13_hard_wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.check(docs_of(spark, sf_dir), ["wrap/hard-wrap"])
    return rows.select("doc_id", "line", F.col("measured").alias("start_line"))


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, unnest({sql_sentences('text')}) AS s, unnest(range(len({sql_sentences('text')}))) AS n FROM documents),
z AS (SELECT doc_id, n, length(s) AS c, {sql_count('s')} AS w FROM s),
d AS (SELECT doc_id, n, c, w, 1 AS part FROM z WHERE n = 0
  UNION ALL SELECT z.doc_id, z.n, CASE WHEN d.c + 1 + z.c > 1000 OR d.w + z.w > 120 THEN z.c ELSE d.c + 1 + z.c END,
    CASE WHEN d.c + 1 + z.c > 1000 OR d.w + z.w > 120 THEN z.w ELSE d.w + z.w END, CASE WHEN d.c + 1 + z.c > 1000 OR d.w + z.w > 120 THEN d.part + 1 ELSE d.part END
  FROM d JOIN z ON z.doc_id = d.doc_id AND z.n = d.n + 1)
SELECT doc_id, part, max(c) AS n_chars FROM d GROUP BY doc_id, part""")
def g15_divided_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts divided at sentence ends into parts of at most 1000 characters and 120 words, where sentences allow it."""
    parts = repair.divided(F.col("text"), 1000, 120)
    rows = S.pos_exploded(docs_of(spark, sf_dir), ["doc_id"], parts, "at", "part")
    return rows.select("doc_id", (F.col("at") + 1).alias("part"), F.length("part").alias("n_chars"))


@query(f"""WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, {SQL_WORD}))) AS w, unnest(range(len(regexp_extract_all(text, {SQL_WORD})))) AS pos FROM documents),
o AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM t WHERE w NOT IN {in_sql(rules.closed_class_words())})
SELECT doc_id, 0 AS sent_no, min(pos) AS "start", count(*) AS n FROM o GROUP BY doc_id, i HAVING count(*) > 3""")
def g17_open_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of more than three open words; a whole text is one sequence here."""
    lower = F.transform(S.words_of(F.col("text")), F.lower)
    return docs_of(spark, sf_dir).select("doc_id", F.lit(0).alias("sent_no"), F.explode(rules.open_runs(lower)).alias("r")).select("doc_id", "sent_no", "r.*")


PARTICIPLES = sorted({p for _, _, p in L.VERBS})


@query(f"""WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, {SQL_WORD}))) AS w, unnest(range(len(regexp_extract_all(text, {SQL_WORD})))) AS pos FROM documents),
x AS (SELECT doc_id, pos, w, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM t),
y AS (SELECT *, CASE WHEN b IN {in_sql(L.class_words('be'))} AND (w IN {in_sql(PARTICIPLES)} OR regexp_matches(w, '^[a-z]{{2,}}ed$')) THEN 'passive'
  WHEN b IN {in_sql(L.class_words('have'))} AND (w IN {in_sql(PARTICIPLES)} OR regexp_matches(w, '^[a-z]{{2,}}ed$')) THEN 'perfect'
  WHEN b IN {in_sql(L.class_words('be'))} AND regexp_matches(w, '^[a-z]{{2,}}ing$') THEN 'progressive' END AS kind FROM x)
SELECT doc_id, pos, kind, b || ' ' || w AS form FROM y WHERE kind IS NOT NULL""")
def g18_verb_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_of(spark, sf_dir).select("doc_id", F.explode(rules.verb_forms(S.words_of(F.col("text")))).alias("v"))
    return rows.select("doc_id", "v.pos", "v.kind", "v.form")


# --- sorts, limits, sets ---------------------------------------------------------------------------


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) >= ceil(1500 * 0.975) ORDER BY n_chars DESC, doc_id LIMIT 20")
def h1_worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest documents near or over a budget of 1500 characters."""
    return plan.worst_first(docs_of(spark, sf_dir), cap=1500, most=20)


@query(f"WITH {RUN_SQL} SELECT doc_id, line, rule_id FROM w")
def h2_ordered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.report(plan.check(docs_of(spark, sf_dir), RUN_RULES)).select("doc_id", "line", "rule_id")


@query(f"WITH {SQL_SENTENCES}, x AS (SELECT doc_id, start_line AS line, 'ste/sentence-length' AS rule_id FROM s WHERE n_words > 25 UNION ALL SELECT doc_id, start_line, 'wrap/long-block' FROM prose WHERE length(text) > 1500) SELECT rule_id, count(*) AS n, sum(doc_id * 31 + line) AS digest FROM x GROUP BY rule_id")
def h3_union_of_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.check(docs_of(spark, sf_dir), ["ste/sentence-length", "wrap/long-block"])
    return rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("doc_id") * 31 + F.col("line")).alias("digest"))


@query(f"""WITH {SQL_SNAPSHOTS}, wide AS (SELECT doc_id, line_no FROM l WHERE length(line) > 100), whole AS (SELECT doc_id FROM documents WHERE lang = 'es')
SELECT doc_id, line_no FROM own WHERE (doc_id, line_no) IN (SELECT doc_id, line_no FROM wide) UNION SELECT doc_id, line_no FROM wide WHERE doc_id IN (SELECT doc_id FROM whole)""")
def h4_intersected_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines and wide lines; new documents are whole in the first scope."""
    base, head = snapshots_of(spark, sf_dir)
    changed = snapshots.changed_lines(base, head).select("doc_id", "line_no")
    wide = S.lines(head).where(F.length("line") > 100).select("doc_id", "line_no")
    none = head.select("doc_id").where(F.lit(False))
    return snapshots.intersect_scopes(changed, snapshots.new_documents(base, head).select("doc_id"), wide, none)


@query(f"WITH {RUN_SQL} SELECT doc_id FROM documents EXCEPT ALL SELECT DISTINCT doc_id FROM w")
def h5_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    return docs.select("doc_id").exceptAll(plan.check(docs, RUN_RULES).select("doc_id").distinct())


@query(f"WITH {RUN_SQL}, chosen AS (SELECT unnest(['ste/paragraph-length', 'ste/sentence-length', 'wrap/hard-wrap', 'wrap/long-block', 'wrap/wide-line', 'repo/budget', 'english/semicolon']) AS rule_id) SELECT rule_id FROM chosen EXCEPT ALL SELECT DISTINCT rule_id FROM (SELECT rule_id FROM w UNION ALL SELECT 'repo/budget' FROM documents WHERE length(text) > 40000 UNION ALL SELECT 'english/semicolon' FROM documents WHERE contains(text, ';'))")
def h5_rules_without_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the selected rules those that find nothing in any document."""
    chosen = [*RUN_RULES, "repo/budget", "english/semicolon"]
    return plan.rules_without_findings(plan.check(docs_of(spark, sf_dir), chosen), chosen)


# --- scalar rules ----------------------------------------------------------------------------------


@query(f"WITH {SQL_SENTENCES} SELECT doc_id, start_line AS line, n_words, {quoted_sql('sentence')} AS detail FROM s WHERE n_words > 25")
def k5_long_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.check(docs_of(spark, sf_dir), ["ste/sentence-length"])
    return rows.select("doc_id", "line", F.col("measured").alias("n_words"), "detail")


SPLICE_SQL = r"regexp_matches(masked, '(?i),\s+(?:(?:" + "|".join(L.class_words("splice-conjunction")) + r")\s+)(?:" + "|".join(L.class_words("clause-subject")) + r")\s+(?:[A-Za-z0-9_]+\s+){0,2}?(?:not\s+)?(?:" + "|".join(L.class_words("finite-verb")) + r")\b')"


@query(f"WITH {SQL_PROSE.replace(SQL_MASKED, 'regexp_replace(' + SQL_MASKED + ', ' + chr(39) + chr(92) + '([^()]*' + chr(92) + ')' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} SELECT doc_id, block_no FROM prose WHERE {SPLICE_SQL}")
def k4_spliced_conjunctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that join two clauses by a comma and a conjunction, the form that asks for no clause before it."""
    conjunction = "|".join(L.class_words("splice-conjunction"))
    rows = rules.Segments(docs_of(spark, sf_dir)).prose.where(F.contains("text", F.lit(",")))
    hits = F.filter(rules.spliced_commas(F.col("masked")), lambda m: m.rlike(rf"(?i)^,\s+(?:{conjunction})\s"))
    return rows.where(F.size(hits) > 0).select("doc_id", "block_no")


@query(f"WITH {SQL_SENTENCES} SELECT doc_id, start_line AS line, n_words FROM s WHERE n_words BETWEEN 21 AND 25 AND lower(regexp_extract(sentence, {SQL_WORD})) IN ('the', 'in', 'a', 'of')")
def k6_long_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts hold no verbs, so four frequent words stand in for the verb list."""
    rows = rules.Segments(docs_of(spark, sf_dir), {"instruction_verbs": ["the", "in", "a", "of"]})
    found = rules.run_rule(rules.REGISTRY["ste/instruction-length"], rows)
    first = rows.sentences.where(F.col("n_words").between(21, 25) & F.lower(F.get(S.words_of(F.col("sentence")), F.lit(0))).isin("the", "in", "a", "of"))
    return first.select("doc_id", F.col("start_line").alias("line"), "n_words").join(found.select("doc_id", "line").distinct(), ["doc_id", "line"], "left_semi")


@query(f"WITH {SQL_BLOCKS}, j AS (SELECT doc_id, string_agg(CASE WHEN kind = 'prose' THEN text ELSE (SELECT string_agg(line, chr(10) ORDER BY line_no) FROM numbered n WHERE n.doc_id = blocks.doc_id AND n.block_no = blocks.block_no) END, chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY doc_id) SELECT doc_id, md5(j.text) AS digest FROM j")
def k17_joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", F.md5(repair.joined_lines(F.col("text")).cast("binary")).alias("digest"))


@query(f"WITH {SQL_PROSE} SELECT doc_id, start_line AS line, length(text) AS n_chars FROM prose WHERE length(text) > 1500")
def k18_long_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.check(docs_of(spark, sf_dir), ["wrap/long-block"])
    return rows.select("doc_id", "line", F.col("measured").alias("n_chars"))


@query(f"WITH {WRAP_SQL} SELECT doc_id, line FROM w WHERE rule_id = 'wrap/wide-line'")
def k19_wide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.check(docs_of(spark, sf_dir), ["wrap/wide-line"]).select("doc_id", "line")


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) > 1500")
def k20_over_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan.check(docs_of(spark, sf_dir), ["repo/budget"], {"file_chars": 1500})
    return rows.select("doc_id", F.col("measured").alias("n_chars"))


@query("SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%b %-d %-I:%M %p') AS shown FROM events")
def k21_twelve_hour_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", K.twelve_hour(F.col("ts"), "+02:00").alias("shown"))


@query(r"""SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page,
  regexp_replace(regexp_replace(regexp_replace(url, '([?&])page=[^&#]*', '\1', 'g'), '([?&])&+', '\1', 'g'), '[?&](#|$)', '\1', 'g') AS unpinned
FROM pages WHERE regexp_matches(url, '[?&]page=')""")
def k22_pinned_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").withColumn("page", references.query_parameter(F.col("url"), "page")).where("page is not null")
    return rows.select("page_id", "page", references.without_query_parameter(F.col("url"), "page").alias("unpinned"))


@query(f"""SELECT page_id, CASE WHEN {SQL_MARKS['xml']} > 0 THEN 'xml' WHEN {SQL_MARKS['html']} > 0 THEN 'html' WHEN regexp_matches(html, '^\\s*[\\[{{]') AND json_valid(html) THEN 'json'
  WHEN {SQL_MARKS['sql']} > 0 THEN 'sql' WHEN {SQL_MARKS['python']} > 0 THEN 'python' WHEN {SQL_MARKS['javascript']} > 0 THEN 'javascript' ELSE 'other' END AS kind FROM pages""")
def k25_content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = K.content_kind(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(kind.isin("xml", "html", "json", "sql", "python", "javascript"), kind).otherwise("other").alias("kind"))


@query(r"SELECT doc_id, replace(regexp_replace(lower(trim(string_split(text, chr(10))[1])), '[^\p{L}\p{N} _-]', '', 'g'), ' ', '-') AS anchor FROM documents")
def k26_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", references.anchor(F.get(S.lines_of(F.col("text")), F.lit(0))).alias("anchor"))


@query(f"WITH {SQL_PROSE} SELECT doc_id, end_line AS line, regexp_extract(text, '([A-Za-z'']+)\\s*$', 1) AS detail FROM prose WHERE lower(regexp_extract(text, '([A-Za-z'']+)\\s*$', 1)) IN {in_sql(L.class_words('dangling'))}")
def k27_dangling_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.check(docs_of(spark, sf_dir), ["comments/tail"]).select("doc_id", "line", "detail")


@query("""WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) SELECT event_id, key, json_extract_string(props, '$."' || key || '"') AS value FROM k""")
def k31_json_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.explode(K.json_entries(F.col("props"))).alias("key", "value"))


@query(f"SELECT conv_id, turn, {quoted_sql('text')} AS shown FROM conversations")
def k35_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.quoted(F.col("text")).alias("shown"))


# --- repair ----------------------------------------------------------------------------------------


@query(f"WITH {SQL_SENTENCES}, c AS (SELECT source, lang, count(*) AS n_sentences, count(*) FILTER (WHERE n_words > 25) AS n_long, sum(n_words) AS n_words FROM s JOIN documents USING (doc_id) GROUP BY source, lang) SELECT * FROM c")
def sentence_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    found = rules.Segments(rows.select("doc_id", "text")).sentences.join(rows.select("doc_id", "source", "lang"), "doc_id")
    return found.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if(F.col("n_words") > 25).alias("n_long"), F.sum("n_words").alias("n_words"))


@query("WITH j AS (SELECT doc_id, text, replace(text, chr(10), ' ') AS new FROM documents) SELECT doc_id, md5(new) AS digest FROM j WHERE new <> text")
def a8_changed_rows_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line feeds become blanks; rows without one are not written."""
    rows = docs_of(spark, sf_dir).withColumn("new", F.translate("text", "\n", " "))
    return rows.where("new != text").select("doc_id", F.md5(F.col("new").cast("binary")).alias("digest"))


@query(f"WITH {SQL_SENTENCES} SELECT doc_id, start_line AS line, end_line, 'ste/sentence-length' AS rule_id, 'ste' AS category, CAST(n_words AS VARCHAR) || ' words in a sentence that may have 25' AS rule, {quoted_sql('sentence')} AS detail, 'Split it into shorter sentences.' AS fix, 'error' AS severity, false AS repairable, n_words AS measured FROM s WHERE n_words > 25")
def a7_wire_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.check(docs_of(spark, sf_dir), ["ste/sentence-length"]).select(plan.WIRE)


SQL_EDITS = """e AS (SELECT doc_id, length(text) AS n, text, least(10, length(text)) AS e1, instr(text, '. ') AS dot FROM documents)"""


@query(f"WITH {SQL_EDITS} SELECT doc_id, md5('[' || CAST(n AS VARCHAR) || ']' || CASE WHEN dot > 10 THEN substr(text, 11, dot - 11) || '!' || substr(text, dot + 1) ELSE substr(text, 11) END) AS digest FROM e")
def r2_spliced_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten characters become the length; the first period after them a mark; an edit inside the first ten is refused."""
    docs = docs_of(spark, sf_dir)
    first = docs.select("doc_id", F.lit(0).alias("start"), F.least(F.lit(10), F.length("text")).alias("end"), F.concat(F.lit("["), F.length("text").cast("string"), F.lit("]")).alias("text"))
    dot = docs.select("doc_id", (F.instr("text", ". ") - 1).alias("start")).where("start >= 0").select("doc_id", "start", (F.col("start") + 1).alias("end"), F.lit("!").alias("text"))
    admitted, _ = repair.gate_edits(docs, first.union(dot))
    return repair.splice(docs, admitted).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


# words of the driver's texts, what stands for them so that rules have something to repair, and what the rules make of that
REPAIRED_WORDS = [("of", "could", "can"), ("and", "don't", "do not"), ("the", "make use of", "use"), ("und", "in order to", "to"), ("de", "prior to", "before"), ("la", "it's", "it is")]


def _sql_replaced(text: str, at: int, to: int) -> str:
    for row in REPAIRED_WORDS:
        text = f"replace({text}, ' {row[at].replace(chr(39), chr(39) * 2)} ', ' {row[to].replace(chr(39), chr(39) * 2)} ')"
    return text


MARKED_SQL = _sql_replaced("translate(text, '`\"“”[' || chr(1) || chr(2), '')", 0, 1)


def _marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents without quotation marks, where wording that rules repair stands for common words."""
    text = F.translate(F.col("text"), '`"“”[\u0001\u0002', "")
    for word, instead, _ in REPAIRED_WORDS:
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {instead} "))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(f"WITH r AS (SELECT doc_id, {MARKED_SQL} AS text FROM documents), n AS (SELECT doc_id, text, {_sql_replaced('text', 1, 2)} AS now FROM r) SELECT doc_id, md5(now) AS digest, now <> text AS changed FROM n")
def r1_repaired_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered repairs, in up to four rounds, over whole documents that hold what modal, contraction and phrase rules repair."""
    return plan.repair(_marked_texts(spark, sf_dir)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "changed")


@query(r"""WITH ln AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM conversations),
m AS (SELECT *, [trim(x, ' ' || chr(9) || chr(13)) FOR x IN string_split(regexp_replace(line, '([.!?]+)([^A-Za-z0-9.!?]|$)', '\1' || chr(1) || '\2', 'g'), chr(1)) IF trim(x, ' ' || chr(9) || chr(13)) <> ''] AS s FROM ln),
c AS (SELECT conv_id, turn, no, line, CASE WHEN len([x FOR x IN s IF length(x) > 150]) > 0 THEN array_to_string([x FOR x IN s IF length(x) <= 150], ' ') ELSE line END AS now FROM m)
SELECT conv_id, turn, md5(coalesce(string_agg(now, chr(10) ORDER BY no) FILTER (WHERE now <> '' OR line = ''), '')) AS digest FROM c GROUP BY conv_id, turn""")
def r3_messages_without_long_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of over 150 characters are cut."""
    text = repair.cut_sentences(F.col("text"), lambda s: F.length(s) > 150)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.cast("binary")).alias("digest"))


@query(f"""WITH {SQL_NEAR.replace('share >= 0.95', 'share >= 0.6')}, cut AS (SELECT DISTINCT doc_b AS doc_id, unnest(range("start", "end" + 1)) AS line_no FROM por)
SELECT l.doc_id, count(*) AS n_kept, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM l WHERE (doc_id, line_no) NOT IN (SELECT doc_id, line_no FROM cut) AND doc_id IN (SELECT doc_b FROM near) GROUP BY l.doc_id""")
def r4_later_copies_without_portions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of later copies that share 0.6 of their lines; those of which nothing is left have no row."""
    docs = docs_of(spark, sf_dir)
    pairs = near_lines.near_duplicates(docs, 0.6)
    ranges = near_lines.copied_portions(docs, pairs).select(F.col("doc_b").alias("doc_id"), "start", "end")
    later = docs.join(pairs.select(F.col("doc_b").alias("doc_id")), "doc_id", "left_semi")
    left = near_lines.without_ranges(later, near_lines.merged_ranges(ranges, ["doc_id"]))
    total = later.select("doc_id", F.size(S.lines_of(F.col("text"))).alias("n")).join(ranges.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("cut")), "doc_id", "left")
    rows = left.join(total, "doc_id").select("doc_id", (F.col("n") - F.coalesce("cut", F.lit(0))).alias("n_kept"), F.md5(F.col("text").cast("binary")).alias("digest"))
    return rows.where("n_kept > 0")


@query("SELECT true AS clean, true AS fixed_point, count(*) AS n_docs FROM documents")
def r5_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joining wrapped lines leaves no wrapped line, and joining again changes nothing."""
    docs = docs_of(spark, sf_dir).select("doc_id", repair.joined_lines(F.col("text")).alias("text"))
    wrapped = F.exists(S.blocks_of(F.col("text")), lambda b: (b["kind"] == "prose") & (b["end_line"] > b["start_line"]))
    again = repair.joined_lines(F.col("text")) == F.col("text")
    return docs.agg(F.bool_and(~wrapped).alias("clean"), F.bool_and(again).alias("fixed_point"), F.count(F.lit(1)).alias("n_docs"))


SQL_PHRASE_TOKENS = r"regexp_extract_all(regexp_replace(text, '`+[^`]+`+|\"[^\"\n]*\"|“[^”\n]*”', ' ' || chr(1) || ' ', 'g'), '[\p{L}\p{N}_''’-]+|[^\s\p{L}\p{N}_''’-]')"


@query(f"""WITH t AS (SELECT doc_id, [x FOR x IN {SQL_PHRASE_TOKENS} IF x <> chr(1)] AS shown, {SQL_PHRASE_TOKENS} AS tokens FROM documents),
p AS (SELECT DISTINCT array_to_string(shown[1:3], ' ') AS phrase, [lower(x) FOR x IN shown[1:3]] AS want FROM t WHERE len(shown) >= 3),
placed AS (SELECT doc_id, [lower(x) FOR x IN tokens] AS low, unnest(range(1, len(tokens) + 1)) AS i FROM t)
SELECT phrase, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM placed JOIN p ON low[i:i + 2] = want GROUP BY phrase""")
def u3_table_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table made of the first three tokens of every document, held against all documents by the inverted index."""
    docs = docs_of(spark, sf_dir)
    shown = F.filter(rule_tables.tokens_of(F.col("text")), lambda t: t != "\u0001")
    phrases = docs.select(shown.alias("t")).where(F.size("t") >= 3).select(F.array_join(F.slice("t", 1, 3), " ").alias("match")).distinct()
    phrases = phrases.select(F.col("match").alias("phrase_id"), "match", F.lit(False).alias("case_sensitive"))
    found = rule_tables.phrase_matches(docs, phrases)
    return found.groupBy(F.col("phrase_id").alias("phrase")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def findings_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the sentence, block and line rules by source."""
    rows = table(spark, sf_dir, "documents")
    found = plan.check(rows.select("doc_id", "text"), ["ste/sentence-length", "ste/paragraph-length", "wrap", "comments/tail"])
    return found.join(rows.select("doc_id", "source"), "doc_id").groupBy("source", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("doc_id").alias("n_docs"))
