"""Line dedup: lines whose key occurs in many documents go from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, spread_join, two_hashes, written

#: The characters of [\x20\x09-\x0D], fixed by the contract.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line with blanks stripped at both ends and A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def drop_common_lines(documents: DataFrame, min_documents: int = 10, min_chars: int = 1, carry: tuple[Column, ...] = ()) -> DataFrame:
    """Drop lines whose key (see line_key) is found in at least min_documents documents.

    Texts are split at \\n; a null or empty text is one empty line. Keys shorter than min_chars code
    points are never dropped. A document is one distinct (doc_id, text); a line repeated inside it
    counts once, and rows repeated as a whole count once but are all returned. Keys are compared by
    128 bits of hash. Columns other than doc_id and text are ignored, but for those in `carry`,
    which come back in one struct `carried`. An empty table gives an empty result.

    Lines are exploded as hashes only and counted with map-side partial sums. Documents are counted
    for lines that are frequent at all, first by (line, document), then by line, so that no task
    gets all documents of a line; joins deal a hot line to many tasks. The texts move once, to meet
    the positions they lose.

    Returns doc_id, text (as given), carried if asked for, n_lines, n_dropped, kept_text.
    """
    carried = [F.struct(*carry).alias("carried")] if carry else []
    docs = documents.select("doc_id", "text", *carried, row_key(F.col("doc_id"), F.col("text")).alias("row"))
    lines_of = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    lines = (
        docs.select("row", F.posexplode(lines_of).alias("position", "line"))
        .select("row", "position", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("row", "position", two_hashes(F.col("key")).alias("line"))
    )
    # lines of any number inside a document count here, so this holds all common ones and a few more
    often = written(
        lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_documents), "frequent-lines"
    )
    hits = written(spread_join(lines, often, "line", "n", F.col("row")), "frequent-line-hits")
    documents_of = hits.select("line", "row").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("documents"))
    common = written(documents_of.where(F.col("documents") >= min_documents).join(often, "line"), "common-lines")
    dropped = spread_join(hits, common, "line", "n", F.col("row")).groupBy("row").agg(F.collect_set("position").alias("dropped"))
    joined = docs.join(dropped, "row", "left").withColumn("lines", lines_of)
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("dropped", F.array().cast("array<int>")))
    return joined.withColumn("kept", kept).select(
        "doc_id",
        "text",
        *(["carried"] if carry else []),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n").alias("kept_text"),
    )
