"""A training-corpus pipeline: each stage takes what its predecessor kept of the documents.

Every stage takes documents with any further columns, whatever their names, and returns them all.
doc_id is an integer, or text that is one; packing ends with an error at any other.
Null and empty texts are scored, split and compared like texts without words and stay, unless a
duplicate stands for them; empty tables give empty results. Repeated rows, and null doc_ids, are
rows like any others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseframe.llm.common import all_columns, discard, row_key, table, written
from proseframe.llm.decontaminate import find_contamination
from proseframe.llm.line_dedup import drop_common_lines
from proseframe.llm.minhash import near_duplicates
from proseframe.llm.packing import pack
from proseframe.llm.toxicity import learn_toxicity, toxicity_score

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below 0.5 stay as they are."""
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity_score(F.col("text"), model) < 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without the lines that ten or more documents share; n_chars follows the text."""
    kept = drop_common_lines(docs, min_documents=10, min_chars=1, carry=tuple(all_columns(docs)))
    columns = {c: F.col("carried").getField(c) for c in docs.columns} | {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*(columns[c].alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of 0.8 on five-word shingles, one with the smallest doc_id stays.

    Rows are compared, not doc_ids: rows that repeat an id, or have none, are each a document. A null
    id is larger than all others. Rows without words stay.
    """
    row = "row"
    while row in docs.columns:
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col(row).alias("doc_id"), "text"), shingle_words=5, percent=80)
    ids = numbered.select(F.col(row).alias("doc_id"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", F.col("doc_id").alias("row"))
    first = found.join(ids, "doc_id").groupBy("component_id").agg(F.min(order).alias("first"))
    kept = written(first.select(F.col("first.row").alias(row)), "kept-rows")
    return numbered.join(kept, row, "left_semi").select(*all_columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item stay as they are."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), window_words=10).where(F.col("n_hit") > 0)
    bad = written(found.select(row_key(F.col("doc_id"), F.col("text")).alias("bad")).distinct(), "contaminated")
    return docs.join(bad, row_key(docs["doc_id"], docs["text"]) == bad["bad"], "left_anti").select(*all_columns(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER), capacity=4096, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_tokens),
]

#: SQL can express neither the learned model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; what each keeps is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES[:-1]):
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if at:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
