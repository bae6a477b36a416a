"""The numbered operators as queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats
from .common import table
from .decontaminate import find_contamination
from .embedding_dedup import embedding_duplicates
from .fingerprint import compare_edited
from .hard_negatives import hard_negatives
from .line_dedup import drop_common_lines
from .lm_score import pseudo_likelihood
from .minhash import near_duplicates
from .packing import pack
from .phrases import mine_phrases
from .suffix_dedup import remove_repeated_strings
from .toxicity import score_toxicity
from .url_filter import filter_urls

#: The tokenizer that the contract of operator 4 fixes.
TOKENIZER = "word_bpe_49k.json"
#: The rules that the contract of operator 3 fixes.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


OP2 = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM roots LEFT JOIN counts USING (vec_id)
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


OP3 = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM (SELECT DISTINCT host, path FROM parts) p
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(rverdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=4096, end_id=2)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_strings(table(spark, sf_dir, "documents"), length=200)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window_words=10)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6 = r"""
WITH d AS (
  SELECT doc_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF w <> ''] AS words FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, [w FOR w IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF w <> ''] AS words FROM benchmark),
bw AS (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS w FROM bw),
sizes AS (SELECT DISTINCT n FROM windows),
dw AS (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n),
places AS (SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS w FROM dw),
hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows USING (n, w)),
hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_common_lines(table(spark, sf_dir, "documents"), min_documents=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


OP7 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common USING (key) GROUP BY doc_id
"""


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle FROM places),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM roots LEFT JOIN n USING (doc_id)
"""


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP10 = r"""
WITH c AS (
  SELECT conv_id, list('r' || coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) ORDER BY turn, role, text) AS turns,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM conversations GROUP BY conv_id),
u AS (SELECT min(conv_id) AS conv_id, turns FROM c GROUP BY turns),
snapshots AS (SELECT a.conv_id FROM u a JOIN u b ON a.turns[1] = b.turns[1] AND len(a.turns) < len(b.turns) AND b.turns[1:len(a.turns)] = a.turns)
SELECT c.conv_id, CAST(len(c.turns) AS BIGINT) AS n_turns, c.rendered FROM c JOIN u USING (conv_id)
WHERE c.conv_id NOT IN (SELECT conv_id FROM snapshots)
"""


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"), min_count=100, most_words=5, top=2000)


OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS words FROM pieces),
starts AS (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(words) >= m),
counted AS (SELECT lang, m, words[i:i + m - 1] AS p, count(*) AS a FROM starts GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counted WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, m, p, array_to_string(p, ' ') AS phrase, a FROM counted WHERE a >= 100),
cuts AS (SELECT lang, m, p, phrase, a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, x.a AS l, y.a AS r, n, CAST((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.p[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.p[k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sizes AS (SELECT lang, p, m, a, unnest(range(2, m)) AS j FROM f WHERE m > 2),
parts AS (SELECT lang, p, j, a, unnest(range(1, m - j + 2)) AS i FROM sizes),
longer AS (SELECT lang, array_to_string(p[i:i + j - 1], ' ') AS phrase, max(a) AS longest FROM parts GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE longest IS NULL OR 100 * longest < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=5, share=(80, 100), scale=256)


OP12 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
e AS (
  SELECT doc_id, text, n, coalesce(lead(doc_id) OVER o, min(doc_id) OVER ()) AS next_id,
    substr(text, 1, n - n // 4) || substr(coalesce(lead(text) OVER o, first_value(text) OVER o), 1, n // 4) AS edited
  FROM d WINDOW o AS (ORDER BY doc_id)),
lines AS (
  SELECT doc_id, 1 AS kind, unnest(string_split(text, chr(10))) AS p FROM e
  UNION ALL SELECT doc_id, 2, unnest(string_split(edited, chr(10))) FROM e),
pieces AS (SELECT doc_id, kind, CAST('0x' || substr(md5(x), 1, 4) AS BIGINT) AS bits FROM (
  SELECT doc_id, kind, unnest(regexp_extract_all(p, '[^ ]+(?: +[^ ]+){0,3}')) AS x FROM lines)),
units AS (
  SELECT doc_id, kind, k AS lane, CAST('0x' || substr(sha256(p), CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT) AS value FROM lines, range(8) AS r(k)
  UNION ALL SELECT doc_id, kind, 8 + bits % 128, CASE WHEN bits % 256 < 128 THEN 1 ELSE -1 END FROM pieces),
sums AS (SELECT doc_id, kind, lane, CAST(sum(value) AS BIGINT) AS value FROM units GROUP BY ALL),
dense AS (
  SELECT a.doc_id, a.kind, k AS lane, coalesce(value, 0) AS value, CASE WHEN k < 8 THEN 4294967296 ELSE 65536 END AS m
  FROM (SELECT DISTINCT doc_id, kind FROM lines) a CROSS JOIN range(136) AS r(k)
  LEFT JOIN sums s ON s.doc_id = a.doc_id AND s.kind = a.kind AND s.lane = k),
reduced AS (SELECT doc_id, kind, lane, ((value % m) + m) % m AS value FROM dense),
prints AS (
  SELECT doc_id, kind, string_agg(CASE WHEN lane < 8 THEN printf('%08x', value) ELSE printf('%04x', value) END, '' ORDER BY lane) AS fp,
    list(CAST(CASE WHEN value >= 32768 THEN value - 65536 ELSE value END AS DOUBLE) ORDER BY lane) FILTER (WHERE lane >= 8) AS v
  FROM reduced GROUP BY doc_id, kind),
joined AS (
  SELECT e.doc_id, n, edited, a.fp, b.fp AS edited_fp, c.fp AS next_fp, list_inner_product(a.v, b.v) AS ab, list_inner_product(a.v, c.v) AS ac,
    list_inner_product(a.v, a.v) AS aa, list_inner_product(b.v, b.v) AS bb, list_inner_product(c.v, c.v) AS cc
  FROM e JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 1 JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 2
  JOIN prints c ON c.doc_id = e.next_id AND c.kind = 1)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fp AS fingerprint, edited_fp AS edited_fingerprint,
  CASE WHEN fp = edited_fp THEN 1.0::DOUBLE WHEN aa = 0 OR bb = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ab / sqrt(aa * bb))) END AS near_edited,
  CASE WHEN fp = next_fp THEN 1.0::DOUBLE WHEN aa = 0 OR cc = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ac / sqrt(aa * cc))) END AS near_next
FROM joined
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_embedding_dedup, op3_url_filter, op4_packing, op5_suffix_dedup, op6_decontamination,
        op7_line_dedup, op8_minhash_dedup, op9_lm_score, op10_chat_format, op11_phrases, op12_hard_negatives, op13_fingerprint,
    )
}

ORACLE_SQL = {
    "op2_embedding_dedup": OP2,
    "op3_url_filter": OP3,
    "op6_decontamination": OP6,
    "op7_line_dedup": OP7,
    "op8_minhash_dedup": OP8,
    "op10_chat_format": OP10,
    "op11_phrases": OP11,
    "op12_hard_negatives": OP12,
    "op13_fingerprint": OP13,
}
