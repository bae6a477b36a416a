"""Enumerations by frame, by list and by rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from proseframe.operators import inventory as I


def each(spark, column, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r.x for r in rows.select("i", column(F.col("text")).alias("x")).orderBy("i").collect()]


def test_frame_keys(spark):
    got = each(spark, lambda t: I.frame_key(t), ["The `a b` reads (a.go), see x/y.", "Nothing named here.", "It sets --flag and some_name, fooBar!", None, ""])
    assert got == ["the □ reads □ see □", None, "it sets □ and □ □", None, None]


def test_members_in_a_row(spark):
    texts = ["`a`, `b` and `c`.", "`a`, the `b`, and the `c` go", "`a` and `b`", "`a`, rows, `b` and `c`", "It reads `a`, `b`, `c` or `d`; x", "a.go, b.go, and c.go", "plain words, and more, and most"]
    assert each(spark, I.members_in_a_row, texts) == [3, 3, 0, 0, 4, 3, 0]


def test_names_only_and_rows(spark):
    assert each(spark, I.names_only, ["`a`, `b` and `c`", "`a` (old)", "`a` reads", "`a` (one) (two)", "(`a`)", "", "—"]) == [3, 1, 0, 0, 1, 0, 0]
    assert each(spark, I.listed_names, ["- `a`", "| `a` | `b` |", "|---|:-:|", "| `a` | reads |", "`a`", "3. `x_y`, `z`"]) == [1, 2, None, 0, 0, 2]


def test_equal_runs(spark):
    rows = spark.createDataFrame([(0, ["a", "a", "b", None, None, None, "c", "c", "c"]), (1, []), (2, None), (3, ["x"] * 3)], "i long, k array<string>")
    got = {r.i: [tuple(x) for x in r.r or []] for r in rows.select("i", I.equal_runs(F.col("k"), 2).alias("r")).collect()}
    assert got == {0: [(0, 2, "a"), (6, 3, "c")], 1: [], 2: [], 3: [(0, 3, "x")]}


def test_long_words_are_read_once(spark):
    assert each(spark, lambda t: t.rlike(I.HOLDS_MEMBER), ["x" * 200_000, "-" * 50_000 + "a"]) is not None
