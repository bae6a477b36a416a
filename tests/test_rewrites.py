"""Rewrites: what they guard, what they refuse, and repairs that end."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from proseframe.operators import rules
from proseframe.plans import check as plan

#: text, and what all repairs make of it
TEXTS = {
    "It writes `should` and `don't` there.": "It writes `should` and `don't` there.",
    'It says "could" and “it’s”, never more.': 'It says "could" and “it’s”, not more.',
    "It doesn’t run. IT'S SHOUTED. It SHOULD run.": "It does not run. IT IS SHOUTED. It MUST run.",
    "I'm here. CAN'T STOP. They'll wait.": "I am here. CANNOT STOP. They will wait.",
    "Note that it fails. Very well.": "It fails. Well.",
    "It holds. Needless to say, simply, it works.": "It holds. It works.",
    "It will be done later. Then go.": "It will be done later. Then go.",
    "It is instead of the old cache.": "It is instead of the old cache.",
    "It reads keys instead of the old rows. It waits.": "It reads keys. It waits.",
    "Fixed in PR 7 today.": "Fixed in PR 7 today.",
    "See above for more.": "See above for more.",
    "Do not ask why it waits. It ends.": "Do not ask why it waits. It ends.",
    "It asks whether or not it ends.": "It asks whether it ends.",
    "It is very. It is very slow.": "It is very. It is slow.",
    "Really `x` waits, and it really `y`s.": "`x` waits, and it `y`s.",
    "A simply-typed term, un-simply put.": "A simply-typed term, un-simply put.",
    "É simply is. éshouldn't it.": "É is. éshouldn't it.",
    "": "",
}


@pytest.fixture(scope="module")
def repaired(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string")
    return plan.repair(docs)


def test_all_repairs_at_once(repaired):
    got = {r.before: r.text for r in repaired.collect()}
    for before, want in TEXTS.items():
        assert got[before] == want
    assert got[None] is None


def test_repairs_rest(repaired):
    again = plan.repair(repaired.select("doc_id", "text"))
    assert again.where("changed").count() == 0


def test_no_negation_is_lost(spark):
    words = ["not", "never", "no", "nothing"]
    docs = spark.createDataFrame([(i, f"It is {w} really simply {w} so, {w} at all, never that.") for i, w in enumerate(words)], "doc_id long, text string")
    for r in plan.repair(docs).collect():
        assert sum(r.text.split().count(x) + r.text.split().count(x + ",") for x in [*words]) == 4


def test_rounds_end_in_a_plan_of_one_round(spark):
    """A rewrite that feeds itself is stopped by the number of rounds; the plan is as large for many as for one."""
    feeds = rules.Rule("own/feeds", lambda s: s.docs.limit(0), repair=lambda t: F.concat(t, F.lit("x")))
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in plan.repair(docs, [feeds], rounds=3).collect()} == {1: "axxx", 2: None}
    size = lambda n: len(plan.repair(docs, rounds=n)._jdf.queryExecution().optimizedPlan().toString())
    assert size(40) < 1.01 * size(1)


def test_a_look_behind_costs_only_where_its_pattern_stands(spark):
    """The words in front of a counted noun are looked for where a number stands, not at every place of a long text."""
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("plain lines of prose without a figure go on and on here.\n"), 20_000), F.lit("It has exactly twelve rules.")).alias("text"))
    began = time.monotonic()
    row = plan.repair(docs, ["counts/inventory-count"]).select(F.length("before").alias("n"), F.length("text").alias("now")).first()
    assert time.monotonic() - began < 15
    assert row["n"] > row["now"]


#: matches with nothing but blanks between them, more of them than there are rounds
CHAINS = {
    "They could make use of could make use of could make use of don't go.": "They can use can use can use do not go.",
    "could could could could could could": "can can can can can can",
    "Simply, really, could should it run. It holds.": "Can must it run. It holds.",
}


def test_a_chain_of_matches_needs_no_more_rounds_than_one_match(spark):
    docs = spark.createDataFrame([*enumerate(CHAINS)], "doc_id long, text string")
    got = {r.before: r.text for r in plan.repair(docs, rounds=1).collect()}
    assert got == CHAINS


def test_what_a_rewrite_needs_stands_where_it_matches(spark):
    """No rewrite is left out of a text in which its pattern matches."""
    cases = [(r, c.text) for r in rules.select_rules(None) if r.rewrites for c in r.cases if c.text]
    for r, text in cases:
        row = spark.range(1).select(*(F.lit(text).rlike(x.plain).alias(f"m{n}") for n, x in enumerate(r.rewrites)), *(x.may_stand(F.lower(F.lit(text))).alias(f"s{n}") for n, x in enumerate(r.rewrites))).first()
        assert all(row[f"s{n}"] or not row[f"m{n}"] for n in range(len(r.rewrites)))
