"""Rules from tables: the index against brute force, tables that can't be used, and tables as rules."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from proseframe.operators import rule_tables as T
from proseframe.plans import check as plan

ROWS = [
    ("own/filler", "drop", "by and large", None, "both", None, "By and large, it works.", "it works.", "By, and large"),
    ("own/short", "rewrite", "with regard to", "about", "both", None, "It talks with regard to rows.", "It talks about rows.", "with `regard` to"),
    ("own/short", "rewrite", "at all times", "always", "message", None, "It runs at all times.", "It runs always.", None),
    ("own/flag", "flag", "TBD", None, None, True, "It is TBD.", None, "It is tbd."),
    ("own/year", "pattern", r"(?i)in the year (\d{4})", "in $1", "both", None, "In the year 1999 it ran.", "in 1999 it ran.", "in the year"),
]


def table(spark, rows):
    return spark.createDataFrame(rows, T.COLUMNS)


def test_a_table_becomes_rules(spark):
    rows = T.load_rules(table(spark, ROWS))
    docs = spark.createDataFrame([(1, "By and large, it is TBD. In the year 1999 it ran."), (2, "A text\nwith regard to `with regard to` it."), (3, "at all times tbd"), (4, None), (5, "")], "doc_id long, text string")
    found = {(r.doc_id, r.rule_id, r.detail, r.line) for r in plan.check(docs, ["own"], table=rows).collect()}
    assert found == {(1, "own/filler", "By and large", 1), (1, "own/flag", "TBD", 1), (1, "own/year", "In the year 1999", 1), (2, "own/short", "with regard to", 1)}
    assert {r.rule_id for r in plan.check(docs, ["own/flag", "wrap"], table=rows).collect()} == {"own/flag", "wrap/hard-wrap"}
    got = {r.doc_id: r.text for r in plan.repair(docs, T.table_repairs(rows)).collect()}
    assert got == {1: "It is TBD. In 1999 it ran.", 2: "A text\nabout `with regard to` it.", 3: "at all times tbd", 4: None, 5: ""}


@pytest.mark.parametrize(("change", "problem"), [
    ({"rule_id": None}, "no id"), ({"rule_id": "plain"}, "no id"), ({"kind": "swap"}, "kind"), ({"match": " "}, "matches nothing"), ({"test_in": None}, "no example"), ({"kind": "rewrite", "replace": "BY and large"}, "writes what it found"),
    ({"test_in": "by, and large"}, "does not fire"), ({"clean": "it works by and large"}, "clean"), ({"test_out": "works"}, "something else"), ({"kind": "pattern", "match": "by ("}, "compile"), ({"kind": "pattern", "match": "nothing"}, "does not fire"),
])
def test_tables_that_cannot_be_used(spark, change, problem):
    names = [c.split()[0] for c in T.COLUMNS.split(", ")]
    row = tuple((dict(zip(names, ROWS[0], strict=True)) | change)[n] for n in names)
    with pytest.raises(ValueError, match=problem):
        T.load_rules(table(spark, [row, *ROWS[1:]]))


def test_repeated_rows_are_refused(spark):
    with pytest.raises(ValueError, match="twice"):
        T.load_rules(table(spark, [*ROWS, ROWS[0]]))


def test_the_index_equals_a_search(spark):
    rng = random.Random(5)
    words = ["a", "the", "Row", "row", "naïve", "x-y", ",", ".", "it's"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30)))) for i in range(80)] + [(900, None), (901, "the the the")]
    phrases = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(60)})
    made = spark.createDataFrame([(k, p, k % 3 == 0) for k, p in enumerate(phrases)], "phrase_id long, match string, case_sensitive boolean")
    found = T.phrase_matches(spark.createDataFrame(texts, "doc_id long, text string"), made).collect()
    got = sorted((r.doc_id, r.phrase_id, r.pos) for r in found)
    want = []
    for d, t in texts:
        tokens = re.findall(r"[\w'-]+|[^\s\w]", t or "")
        for k, p in enumerate(phrases):
            w = p.split()
            fold = (lambda x: x) if k % 3 == 0 else (lambda x: [y.lower() for y in x])
            want += [(d, k, i) for i in range(len(tokens)) if fold(tokens[i : i + len(w)]) == fold(w)]
    assert got == sorted(want)


def test_ten_thousand_phrases_are_one_join(spark):
    phrases = spark.range(10_000).selectExpr("id as phrase_id", "concat('word', id, ' next') as match", "false as case_sensitive")
    docs = spark.createDataFrame([(1, "word77 next word9999 next word10000 next")], "doc_id long, text string")
    hits = T.phrase_matches(docs, phrases)
    assert sorted(r.phrase_id for r in hits.collect()) == [77, 9999]
    assert len(re.findall(r"\+- (?:BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin)", hits._jdf.queryExecution().sparkPlan().toString())) == 1


def test_phrases_with_a_token_in_common_join_no_pairs_that_do_not_match(spark):
    """2,000 phrases share their longest token with 200,000 places of the texts: 400 million pairs by that token alone."""
    phrases = spark.range(2000).select(F.concat(F.lit("p"), F.col("id")).alias("phrase_id"), F.concat(F.lit("x"), F.col("id"), F.lit(" Everywhere")).alias("match"), F.lit(False).alias("case_sensitive"))
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("everywhere a "), 5000), F.lit("X7 everywhere")).alias("text"))
    began = time.monotonic()
    found = T.phrase_matches(texts, phrases).collect()
    assert time.monotonic() - began < 40
    assert {(r["phrase_id"], r["pos"], r["found"]) for r in found} == {("p7", 10_000, "X7 everywhere")} and len(found) == 40
