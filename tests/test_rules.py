"""Every registered rule on its own cases, and the plans around the rules."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from proseframe.functions import segment as S
from proseframe.operators import rules
from proseframe.plans import check as plan
from proseframe.plans.prefilter import matches, needed_literals


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_each_rule_fires_on_its_cases_alone(spark):
    cases = [(r.id, c) for r in rules.select_rules() for c in r.cases]
    docs = texts(spark, [(i, c.text) for i, (_, c) in enumerate(cases)])
    listed = spark.createDataFrame([("utilise", ["use"])], "word string, approved array<string>")
    found = {(r.doc_id, r.rule_id) for r in plan.check(docs, limits={"dictionary": listed}).collect()}
    for i, (rule_id, case) in enumerate(cases):
        assert ((i, rule_id) in found) == case.fires, (rule_id, case.name)
    assert {rule for _, rule in found} == set(rules.REGISTRY)  # each rule occurs in some case


def test_repairs_clear_what_they_repair_and_rest(spark):
    cases = [(r.id, c) for r in rules.select_rules() for c in r.cases if r.repair and c.want]
    docs = texts(spark, [(i, c.text) for i, (_, c) in enumerate(cases)])
    once = plan.repair(docs)
    got = {r.doc_id: (r.text, r.changed) for r in once.collect()}
    assert all(got[i] == (c.want, True) for i, (_, c) in enumerate(cases))
    left = {(r.doc_id, r.rule_id) for r in plan.check(once.select("doc_id", "text")).collect()}
    assert not {(i, rule) for i, (rule, _) in enumerate(cases)} & left
    assert plan.repair(once.select("doc_id", "text")).where("changed").count() == 0


def test_masked_accented_null_and_empty_texts(spark):
    docs = texts(spark, [(0, "It writes `should` there."), (1, 'He says "it should".'), (2, "éshould is a word."), (3, None), (4, ""), (5, "It should.")])
    found = {(r.doc_id, r.rule_id) for r in plan.check(docs, ["ste/modal"]).collect()}
    assert (5, "ste/modal") in found and not {0, 1, 3, 4} & {d for d, _ in found}


def test_selection_and_registration():
    assert {r.category for r in rules.select_rules(["wrap"])} == {"wrap"}
    with pytest.raises(ValueError, match="nothing/here"):
        rules.select_rules(["wrap", "nothing/here"])
    for bad in ("nocategory", "ste/modal", "new/rule"):
        with pytest.raises(ValueError):
            rules.rule(bad, "block")(lambda s: None)


def test_gate_summary_and_top(spark):
    docs = texts(spark, [(1, "a\nb\nc\nd"), (2, "ab " * 60)])
    found = plan.check(docs, ["wrap"])
    assert plan.failed(found).first().failed
    assert not plan.failed(found.where("doc_id = 2")).first().failed and not plan.failed(found.limit(0)).first().failed
    assert plan.summary(found).where("category is null").first().n_findings == 4
    top = plan.top_findings(found, 2).orderBy("doc_id", "rn").collect()
    assert [(r.doc_id, r.rn, r.hidden) for r in top] == [(1, 1, 0), (1, 2, 1), (2, 1, 0)]


def test_helpers_over_findings(spark):
    docs = texts(spark, [(1, "It should, it should.\n\nIt should."), (2, "x" * 30), (3, "x" * 20)])
    found = plan.check(docs, ["ste/modal"])
    assert [(r.doc_id, r.line) for r in plan.distinct_hits(found).collect()] == [(1, 1)] and found.count() == 3
    assert {r.rule_id for r in plan.rules_without_findings(found, ["ste/modal", "wrap/hard-wrap"]).collect()} == {"wrap/hard-wrap"}
    assert [tuple(r) for r in plan.worst_first(docs, 30, 2).collect()] == [(1, 33), (2, 30)]


def test_regression_gate(spark):
    base = texts(spark, [(1, "It runs."), (2, "It should; it runs."), (3, "It runs.")])
    head = texts(spark, [(1, "It should run."), (2, "It runs."), (3, "It runs; it stops.")])
    got = [tuple(r) for r in plan.regression_gate(base, head, ["ste/modal", "english/semicolon"]).collect()]
    assert got == [(3, "english/semicolon", 0, 1)]  # what the repair of document 1 clears is none


def test_repairs_of_some_kinds(spark):
    docs = texts(spark, [(1, "a"), (2, "a")]).withColumn("kind", F.when(F.col("doc_id") == 1, "source").otherwise("document"))
    own = rules.Rule("own/b", repair=lambda t: F.replace(t, F.lit("a"), F.lit("b")), kinds=("source",))
    assert {r.doc_id: r.text for r in plan.repair(docs, [own], kind=F.col("kind")).collect()} == {1: "b", 2: "a"}


def test_one_scan_for_all_row_rules(spark):
    docs = texts(spark, [(1, "a")])
    names = [r.id for r in rules.select_rules() if r.find]
    assert len(names) > 35 and plan.check(docs, names)._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 1


def test_owned_findings(spark):
    docs = texts(spark, [(1, "a\nb\nc"), (2, "a\nb")])
    owned = spark.createDataFrame([(1, 3)], "doc_id long, line_no int")
    assert [(r.doc_id, r.line) for r in plan.check(docs, ["wrap/hard-wrap"], owned=owned).collect()] == [(1, 3)]


def test_sinks(spark, tmp_path):
    docs = texts(spark, [(1, "It should run."), (2, "It runs.")])
    plan.write_findings(plan.check(docs, ["ste/modal"]), f"{tmp_path}/f")
    assert spark.read.parquet(f"{tmp_path}/f").first().category == "ste"
    plan.write_repaired(plan.repair(docs, ["ste/modal"]), f"{tmp_path}/r")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/r").collect()] == [(1, "It must run.")]


PATTERNS = [r"(?i)\bshould\b", r"(?i)(?:for now|as of \d+)", r"cat|dog|horse", r"a+b", r"(?:abc)?x", r"[a-z]{3}", r"(foo|bar)\s+baz", r"x?"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_needed_literals_are_needed(pattern):
    literals = needed_literals(pattern)
    for t in ["It should run", "for now", "as of 12", "a cat", "HORSE horse", "aab", "abcx", "foo  baz", "bar baz", "x", "zzz", ""]:
        if literals and re.search(pattern, t):
            assert any(x in t.lower() for x in literals)


def test_prefilter_changes_no_answer(spark):
    docs = texts(spark, [(i, t) for i, t in enumerate(["SHOULD", "should it", "shoulder", "cat", None, "as of 7"])])
    for p in PATTERNS:
        rows = docs.select(matches(F.col("text"), p).alias("a"), F.col("text").rlike(p).alias("b")).collect()
        assert all(r.a == r.b for r in rows)


def test_a_segmentation_is_computed_once(spark):
    """No filter that Spark infers for an explode holds the arrays of blocks and hits a second time."""
    docs = spark.createDataFrame([(1, "One line.\n\nAnother line."), (2, ""), (3, None)], "doc_id long, text string")
    for rows in (plan.check(docs, ["ste/paragraph-length", "ste/sentence-length", "wrap"]), rules.Segments(docs).tokens):
        optimized = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter (size(" not in optimized and "Filter ((size(" not in optimized
    assert sorted((r.doc_id, r.block_no) for r in rules.Segments(docs).sentences.collect()) == [(1, 1), (1, 3)]


def test_a_run_reads_texts_no_more_than_its_rules_need(spark):
    """Patterns for lines are tried at their start only, words are not kept with the sentences, and masking does not translate whole texts."""
    optimized = plan.check(spark.createDataFrame([(1, "x")], "doc_id long, text string"), ["ste/paragraph-length", "ste/sentence-length", "wrap"])._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in optimized and f"^(?:{S.VERBATIM}|{S.DIRECTIVE})" in optimized
    assert not any("regexp_extract_all" in x.split(" AS sentences")[0].split("masked")[-1] for x in optimized.splitlines() if " AS sentences" in x)


def test_quotations_are_those_of_whole_texts(spark):
    texts = ["", " a  b ", "x" * 60, "x" * 61, "ab " * 100, " " * 500 + "one two", "a" + " \t\n" * 100 + "b" * 70, "\U0001f600 " * 90, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", rules.quoted(F.col("t")).alias("q")).collect()
    flat = {r.t: re.sub(r"\s+", " ", r.t).strip(" ") for r in rows if r.t is not None}
    assert all(r.q == (None if r.t is None else flat[r.t][:60] + "..." * (len(flat[r.t]) > 60)) for r in rows)
