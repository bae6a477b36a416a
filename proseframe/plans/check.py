"""Check texts against rules, and repair them."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.segment import let
from ..functions.wordlists import NEAR_FRACTION, REPAIR_ROUNDS
from ..operators import corpus_rules, counts, inventory, phrases, rewrites, rule_tables  # noqa: F401  some only register their rules
from ..operators.rules import FINDING, Rule, Segments, row_findings, run_rule, select_rules
from ..operators.snapshots import regressions


def check(docs: DataFrame, rules: list[str] | None = None, limits: dict | None = None, owned: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """Findings of docs(doc_id, text). Rules that are not selected are not planned; owned(doc_id, line_no) restricts the findings.

    Rules that read one text share one scan, whatever their number; each rule that joins texts adds
    its own. `table` has rules of the caller, see rule_tables.load_rules; without names they run beside all others,
    and with names only those of them that are named.
    """
    if owned is not None:  # whole documents without an owned line are never segmented
        docs = docs.join(owned.select("doc_id").distinct(), "doc_id", "left_semi")
    segments = Segments(docs, limits or {})
    if table is not None and rules is not None:
        own = {x for r in table.select("rule_id").distinct().collect() for x in (r["rule_id"], r["rule_id"].split("/")[0])}
        table = table.where(F.col("rule_id").isin(rules) | F.substring_index("rule_id", "/", 1).isin(rules))
        rules = [r for r in rules if r not in own]
    chosen = select_rules(rules)
    in_rows = [r for r in chosen if r.find]
    parts = [row_findings(docs, in_rows, segments.limits)] if in_rows else []
    found = functools.reduce(DataFrame.unionByName, parts + [run_rule(r, segments) for r in chosen if not r.find] + ([] if table is None else [rule_tables.table_findings(segments, table)]))
    return found if owned is None else owned_findings(found, owned)


def owned_findings(findings: DataFrame, owned: DataFrame) -> DataFrame:
    """Findings whose lines meet an owned line; a finding on a line below one stands for the whole document."""
    spans = findings.withColumn("_at", F.when(F.col("line") < 1, F.array(F.lit(None).cast("int"))).otherwise(F.sequence("line", F.greatest("line", "end_line"))))
    keys = spans.select(*findings.columns, F.explode("_at").alias("_line"))
    on_line = keys.where("_line is not null").join(owned.select("doc_id", F.col("line_no").alias("_line")), ["doc_id", "_line"], "left_semi")
    of_file = keys.where("_line is null").join(owned.select("doc_id").distinct(), "doc_id", "left_semi")
    return on_line.union(of_file.select(on_line.columns)).select(findings.columns).distinct()


def failed(findings: DataFrame) -> DataFrame:
    """One row: whether any finding is an error; warnings never fail a run."""
    return findings.agg(F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)).alias("failed"))


def summary(findings: DataFrame) -> DataFrame:
    """Number of findings by rule and severity, by category, and in all."""
    return findings.rollup("category", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n_findings"))


def regression_gate(base: DataFrame, head: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """doc_id, rule_id, n_base, n_head where head, after its repairs, has more findings of a rule than base has as it stands.

    The same rules judge both, so what a repair clears is no regression, and what a repair brings in is one.
    """
    repaired = repair(head, rules).select("doc_id", "text")
    return regressions(check(base, rules), check(repaired, rules))


def rules_without_findings(findings: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """rule_id of the selected rules that a run found nothing for; over the cases of the rules there is none."""
    chosen = findings.sparkSession.createDataFrame([(r.id,) for r in select_rules(rules)], "rule_id string")
    return chosen.exceptAll(findings.select("rule_id").distinct())


def distinct_hits(findings: DataFrame) -> DataFrame:
    """One finding for each rule and detail of a document, the one on the first line."""
    first = W.partitionBy("doc_id", "rule_id", "detail").orderBy("line", "end_line")
    return findings.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def worst_first(docs: DataFrame, cap: int, most: int, near: float = NEAR_FRACTION) -> DataFrame:
    """doc_id, n_chars of the `most` largest of docs that are over a budget of characters or near it."""
    sized = docs.select("doc_id", F.length("text").alias("n_chars"))
    return sized.where(F.col("n_chars") >= math.ceil(cap * near)).orderBy(F.desc("n_chars"), "doc_id").limit(most)


def report(findings: DataFrame) -> DataFrame:
    """A total order for people to read."""
    return findings.orderBy("doc_id", "line", "rule_id", "detail", "end_line")


# Rule families, the most structural first and the most numerous last.
FAMILY_RANKS = {"yaml": 0, "ste": 1, "english": 2, "wrap": 4}


def top_findings(findings: DataFrame, most: int, ranks: dict[str, int] | None = None) -> DataFrame:
    """At most `most` findings of each document by (rank, line, rule); the last one says how many are hidden.

    The rank is that of the category; categories that `ranks` does not name stand before the last
    one of it. Warnings stand behind everything else, so that none hides an error.
    """
    ranks = ranks or FAMILY_RANKS
    rank = F.coalesce(F.when(F.col("severity") == "warning", F.lit(99)), *(F.when(F.col("category") == c, F.lit(n)) for c, n in ranks.items()), F.lit(max(ranks.values()) - 0.5))
    order = W.partitionBy("doc_id").orderBy(rank, "line", "rule_id", "detail")
    rows = findings.withColumn("rn", F.row_number().over(order)).withColumn("total", F.count(F.lit(1)).over(W.partitionBy("doc_id")))
    rows = rows.where(F.col("rn") <= most)
    return rows.withColumn("hidden", F.when((F.col("rn") == most) & (F.col("total") > most), F.col("total") - most).otherwise(0)).drop("total")


def repair(docs: DataFrame, rules: list[str | Rule] | None = None, rounds: int = REPAIR_ROUNDS, kind: Column | None = None) -> DataFrame:
    """docs with the repaired text, `before` and `changed`. Rules go by id or category; one that is not registered is given itself.

    `kind` is a column over docs, as tables.file_kind makes it; a rule that names kinds repairs only those.

    In a round the repairs go in the order of their places; the rewrites that follow one another are
    one pass over the text. The rounds are a fold inside the row: a text that a round leaves alone is
    settled, and the plan holds one round, however many may run. There is no job, and no shuffle, for a round.
    """
    own = [r for r in rules or [] if isinstance(r, Rule)]
    names = None if rules is None else [r for r in rules if not isinstance(r, Rule)]
    chosen = sorted((r for r in own + select_rules(names) if r.repair), key=lambda r: (r.place, r.id))
    steps: list[Callable[[Column], Column]] = []
    where = lambda kinds, step: step if not kinds or kind is None else lambda t: F.when(kind.isin(*kinds), step(t)).otherwise(t)
    for (of_rewrites, kinds), group in itertools.groupby(chosen, lambda r: (bool(r.rewrites), r.kinds)):
        if of_rewrites:
            steps.append(where(kinds, rewrites.pass_of([x for r in group for x in r.rewrites])))
        else:
            steps.extend(where(kinds, r.repair) for r in group)
    if not steps:
        return docs.withColumns({"before": F.col("text"), "changed": F.lit(False)})

    def once(text: Column) -> Column:
        return functools.reduce(lambda t, step: let(t, step), steps, text)

    rows = docs.withColumn("before", F.col("text"))
    rows = rows.withColumn("text", F.when(F.col("before").isNotNull(), rewrites.settled(F.col("before"), once, rounds)))
    return rows.withColumn("changed", ~F.col("text").eqNullSafe(F.col("before")))


WIRE = FINDING


def write_findings(findings: DataFrame, path: str, form: str = "parquet") -> None:
    """Findings in the wire schema, one folder for each category."""
    findings.select(WIRE).write.mode("overwrite").partitionBy("category").format(form).save(path)


def write_repaired(repaired: DataFrame, path: str) -> None:
    """Only the rows that a repair changed."""
    repaired.where("changed").drop("before", "changed").write.mode("overwrite").parquet(path)
