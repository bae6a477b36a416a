"""The pipeline's stages against what each is defined to keep."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from proseframe.llm import packing


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    line = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(12))
    bodies = ["\n".join(line() for _ in range(6)) for _ in range(120)]
    bench = [(0, line() + " " + line())]
    rows, labels = [], []
    for i in range(120):
        t = bodies[i]
        if i % 6 == 0:
            t = t.replace("\n", "\nvileterm scum ", 1)
        if i % 10 == 1:
            t += "\nFooter of the site"
        if i == 33:
            t += "\n" + bench[0][1]
        rows.append((i, t, "en", "s", len(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(200, bodies[7], "en", "s", 1), (201, bodies[8] + " tail", "en", "s", 1), (202, None, "en", "s", 0), (None, "odd one", None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clean = P.drop_toxic(spark, docs, path)
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.collect()}
    assert left == {r[0] for r in rows if r[0] is None or r[0] >= 200 or r[0] % 6}
    lines = P.drop_lines(spark, docs, path)
    assert lines.columns == docs.columns and lines.count() == len(rows)
    assert lines.where(F.contains("text", F.lit("Footer"))).count() == 0 and lines.where("n_chars != length(text)").count() == 0
    unique = P.drop_near_duplicates(spark, docs, path)
    assert {r.doc_id for r in unique.collect()} == {r[0] for r in rows} - {200, 201}
    decontaminated = P.drop_contaminated(spark, docs, path)
    assert {r.doc_id for r in decontaminated.collect()} == {r[0] for r in rows} - {33}


def test_near_dedup_keeps_one_row_of_each_group(spark):
    body, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, body, "x", 1), (3, body, "x", 1), (3, body + " end", "x", 2), (2, body, "y", 1), (None, body, "z", 1), (None, other, "n", 1), (None, other, "n", 1), (9, "", "e", 0), (9, "", "e", 0), (None, None, "e", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, component_id long")
    got = P.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([rows[3], rows[5], *rows[7:]], key=str)


def test_stages_take_empty_tables_and_clashing_columns(spark, folder):
    path, _ = folder
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, row string, lines string, bad string, kept string")
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, path)
        assert got.columns == docs.columns and got.count() == 0
    assert P.pack_tokens(spark, docs, path).count() == 0
    clash = docs.union(spark.createDataFrame([(1, "one two\nthree", "en", "s", 3, "r", "l", "b", "k")] * 2, docs.schema))
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, clash, path)
        assert got.columns == docs.columns and got.count() == (1 if name == "near-dedup" else 2)


def test_run(spark, folder):
    path, rows = folder
    got = P.run(spark, path).collect()
    kept = {r[0] for r in rows if r[0] is None or (r[0] >= 200 or r[0] % 6)} - {200, 201, 33}
    assert {r.doc_id for r in got} == kept
    one = next(r for r in got if r.doc_id == 2)
    import public_tokenizers

    assert one.doc_tokens == len(packing.token_bytes([rows[2][1]], public_tokenizers.path(P.TOKENIZER))[0]) // 4 + 1


def test_columns_with_any_name_stay(spark):
    rows = [(i, f"shared line\nown {i}", f"x{i}", i) for i in range(12)] + [(90, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, `c``d` long")
    kept = P.drop_lines(spark, docs, None)
    assert kept.columns == docs.columns and kept.count() == 13
    assert [tuple(r) for r in kept.where("doc_id = 3").collect()] == [(3, "own 3", "x3", 3)]
