"""Numbers in three kinds of text, what exempts them, and what they are reworded to."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from proseframe.functions import numbers as N

CASES = [
    # one sentence can be a finding in one kind of text and none in another
    ("cut it into three parts if that helps", "prose", []), ("cut it into three parts if that helps", "gate", ["three parts"]), ("cut it into three parts if that helps", "comment", ["three"]),
    ("It ships three hooks.", "prose", ["three hooks"]), ("The read has 20 seconds.", "prose", ["20 seconds"]), ("the leg takes about 9 minutes", "prose", ["9 minutes"]),
    ("the cap is 6 hours", "gate", ["6 hours"]), ("the cap is 6 hours", "prose", []), ("the job runs in 30 seconds", "prose", ["30 seconds"]), ("There are 12 open issues.", "prose", ["12 open issues"]),
    ("This repo's 15 plugins ride along.", "prose", ["15 plugins"]), ("See the two rules below.", "prose", ["two rules"]), ("See the two rules.", "prose", []),
    # number words differ, and digits are capped in prose alone
    ("it has twenty hooks", "gate", []), ("it has twenty hooks", "prose", ["twenty hooks"]), ("it has 20000 hooks", "gate", ["20000 hooks"]), ("it has 20000 hooks", "prose", []),
    # one number, whatever stands in it
    ("It has 1,000 rows.", "prose", ["1,000 rows"]), ("it reads 1,000,000 rows", "gate", ["1,000,000 rows"]), ("it reads 1.000 rows", "gate", []), ("v2 files and x86 rows and 3.14 rows", "gate", []),
    # what counts nothing
    ("a range of 3-4 items", "gate", []), ("4 - 2 items", "gate", []), ("it costs $5 bills", "gate", []), ("it answers 404 responses", "gate", []), ("it sends 201 or 409 codes", "gate", []),
    ("see issue 12 comments", "gate", []), ("#7 lines", "gate", []), ("§4 parts", "gate", []), ("one of two things", "gate", []), ("a 404 buries it", "gate", []), ("two of the lines", "gate", []),
    ("43 cols is less", "gate", []), ("it holds 64 bits", "prose", []), ("it holds 65 bits", "prose", ["65 bits"]), ("it sets 2 is", "gate", []),
    # comments
    ("the walk has 15 phases", "comment", ["15"]), ("the proxy answers HTTP 403 here", "comment", []), ("the proxy answers 403 here", "comment", ["403"]), ("the loader exits 121 there", "comment", []),
    ("so exit code 2 parses", "comment", []), ("the exit path has 3 callers", "comment", ["3"]), ("A=1 guards it", "comment", []), ('treats "0" as unset', "comment", []), ("in §7.3 and x[2]", "comment", []),
    ("costs $1.43 there", "comment", []), ("sha256 over amd64 in 10ms", "comment", []), ("a 4-byte field", "comment", []), ("it has 4 - phases", "comment", ["4"]), ("  1. first of all", "comment", []),
    ("it holds a hundred keys", "comment", ["hundred"]), ("if exactly one is found", "comment", []), ("used > 0 there", "comment", []), ("three then four", "comment", ["three", "four"]),
    ("", "gate", []), (None, "comment", []),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(CASES)], "i long, text string, kind string")
    each = F.coalesce(*(F.when(F.col("kind") == k, N.number_phrases(F.col("text"), k)) for k in N.SUBSTRATES))
    return {r.i: r.hits for r in rows.select("i", each.alias("hits")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_numbers(found, i):
    text, kind, want = CASES[i]
    assert [h.text for h in found[i] or []] == want, (text, kind)
    assert all(text[h.start : h.start + len(h.text)] == h.text for h in found[i] or [])


def test_values(spark):
    words = {"7": 7, "1,000,000": 10**6, "Twelve": 12, "ninety": 90, "nineteen": 19, "dozen": 12, "x": None}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", N.number_value(F.col("w")).alias("v")).collect()
    assert {r.w: r.v for r in rows} == words
