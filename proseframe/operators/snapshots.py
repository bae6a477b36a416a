"""What changed between two snapshots of documents, and what follows from it."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import segment as S


def _copies(docs: DataFrame) -> DataFrame:
    """doc_id, line, line_no, occ: the copies of a line are numbered from above, inside the row, so nothing is shuffled for it."""
    placed = F.array_sort(F.transform(S.lines_of(F.col("text")), lambda s, i: F.struct(s.alias("line"), (i + 1).alias("line_no"))))

    def numbered(ls: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | (F.get(ls, i)["line"] != F.get(ls, i - 1)["line"]))

        def of_run(firsts: Column, first: Column, j: Column) -> Column:
            run = F.slice(ls, first + 1, F.coalesce(F.get(firsts, j + 1), F.size(ls)) - first)
            return F.transform(run, lambda x, k: F.struct(x["line"].alias("line"), x["line_no"].alias("line_no"), (k + 1).alias("occ")))

        return S.let(starts, lambda firsts: F.flatten(F.transform(firsts, lambda first, j: of_run(firsts, first, j))))

    return docs.select("doc_id", F.explode(S.let(placed, numbered)).alias("l")).select("doc_id", "l.*")


def changed_lines(base: DataFrame, head: DataFrame) -> DataFrame:
    """doc_id, line_no, line of head: copies of lines beyond those that the base document holds; documents new in head are whole.

    Multiset form: a line that only moved is not changed.
    """
    return _copies(head).join(_copies(base).select("doc_id", "line", "occ"), ["doc_id", "line", "occ"], "left_anti").select("doc_id", "line_no", "line")


def changed_lines_in_order(base: DataFrame, head: DataFrame) -> DataFrame:
    """doc_id, line_no, line of head by a line diff in order, where a moved line counts as changed. One document is one group."""

    def diff(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        old = a["text"].iloc[0].split("\n") if len(a) else []
        new = b["text"].iloc[0].split("\n") if len(b) else []
        rows = []
        for tag, _, _, j1, j2 in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
            if tag in ("insert", "replace"):
                rows += [(b["doc_id"].iloc[0], j + 1, new[j]) for j in range(j1, j2)]
        return pd.DataFrame(rows, columns=["doc_id", "line_no", "line"])

    pair = base.select("doc_id", "text").groupBy("doc_id").cogroup(head.select("doc_id", "text").groupBy("doc_id"))
    return pair.applyInPandas(diff, "doc_id long, line_no int, line string")


def new_documents(base: DataFrame, head: DataFrame) -> DataFrame:
    return head.join(base.select("doc_id"), "doc_id", "left_anti")


def without_known_versions(head: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents whose (path, text) no version held."""
    known = versions.select("path", F.sha2("text", 256).alias("_digest")).distinct()
    return head.withColumn("_digest", F.sha2("text", 256)).join(known, ["path", "_digest"], "left_anti").drop("_digest")


def nearest_snapshot(head: DataFrame, snapshots: DataFrame, tagged: bool = False) -> DataFrame:
    """snapshot, n_diff: the one of snapshots(snapshot, seq, path, digest) that differs from head(path, digest) in the fewest paths.

    The newer of equals wins. With tagged, the newest of snapshots(..., tag) that has a tag.
    """
    if tagged:
        newest = snapshots.where("tag is not null").agg(F.max_by("snapshot", "seq").alias("snapshot"))
        return newest.withColumn("n_diff", F.lit(None).cast("long"))
    n_head = head.agg(F.count(F.lit(1)).alias("n_head"))
    # paths of head that a snapshot lacks count too: in all, |snapshot| + |head| less common and equal ones
    held = snapshots.join(head.select("path", F.col("digest").alias("h_digest")), "path", "left").groupBy("snapshot", "seq").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("h_digest").alias("common"),
        F.count_if(F.col("digest") == F.col("h_digest")).alias("same"),
    )
    diff = held.join(F.broadcast(n_head)).select("snapshot", "seq", (F.col("n") + F.col("n_head") - F.col("common") - F.col("same")).alias("n_diff"))  # one row
    return diff.agg(F.min(F.struct("n_diff", (-F.col("seq")).alias("newer"), "snapshot")).alias("best")).select("best.snapshot", "best.n_diff")


def regressions(base_findings: DataFrame, head_findings: DataFrame) -> DataFrame:
    """doc_id, rule_id, n_base, n_head of rules that find more in a document than before."""
    count = lambda df, name: df.groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias(name))
    both = count(head_findings, "n_head").join(count(base_findings, "n_base"), ["doc_id", "rule_id"], "left")
    return both.select("doc_id", "rule_id", F.coalesce("n_base", F.lit(0)).alias("n_base"), "n_head").where("n_head > n_base")


def growth(base: DataFrame, head: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_grown: characters now, and more than in the base."""
    before = base.select("doc_id", F.length("text").alias("_before"))
    rows = head.select("doc_id", F.length("text").alias("n_chars")).join(before, "doc_id", "left")
    return rows.select("doc_id", "n_chars", (F.col("n_chars") - F.coalesce("_before", F.lit(0))).alias("n_grown"))


def claim_wordless(head: DataFrame, owned: DataFrame) -> DataFrame:
    """owned(doc_id, line_no) with each line without letters or digits whose nearest worded lines on both sides are owned."""
    rows = S.lines(head).join(owned.select("doc_id", "line_no", F.lit(True).alias("is_owned")), ["doc_id", "line_no"], "left")
    rows = rows.withColumn("is_owned", F.coalesce("is_owned", F.lit(False))).withColumn("worded", F.col("line").rlike(r"[\p{L}\p{N}]"))
    place = W.partitionBy("doc_id").orderBy("line_no")
    state = F.when(F.col("worded"), F.col("is_owned"))
    up = F.last(state, ignorenulls=True).over(place.rowsBetween(W.unboundedPreceding, 0))
    down = F.first(state, ignorenulls=True).over(place.rowsBetween(0, W.unboundedFollowing))
    rows = rows.withColumn("both", F.coalesce(up, F.lit(False)) & F.coalesce(down, F.lit(False)))
    return rows.where(F.col("is_owned") | (~F.col("worded") & F.col("both"))).select("doc_id", "line_no")


def widen_to_blocks(head: DataFrame, owned: DataFrame) -> DataFrame:
    """doc_id, line_no: all lines of the blocks of which a line is owned."""
    spans = S.blocks(head).select("doc_id", "block_no", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    touched = spans.join(owned, ["doc_id", "line_no"], "left_semi").select("doc_id", "block_no").distinct()
    return spans.join(touched, ["doc_id", "block_no"], "left_semi").select("doc_id", "line_no")


def intersect_scopes(a: DataFrame, a_whole: DataFrame, b: DataFrame, b_whole: DataFrame) -> DataFrame:
    """doc_id, line_no owned in both scopes; where one owns a whole document, the other's lines stay."""
    return a.intersect(b).union(a.join(b_whole, "doc_id", "left_semi")).union(b.join(a_whole, "doc_id", "left_semi")).distinct()
