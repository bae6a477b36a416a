"""Rules over a flattened configuration table config(doc, job, step, key, value, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ["none", "read", "write"]


def duplicate_step_keys(config: DataFrame) -> DataFrame:
    """doc, job, step, key, n of keys that one step holds more than once."""
    rows = config.where("step is not null").groupBy("doc", "job", "step", "key").agg(F.count(F.lit(1)).alias("n"))
    return rows.where("n > 1")


def neutered_gates(config: DataFrame, gates: list[str]) -> DataFrame:
    """doc, job, step of steps that run a gate and continue on its error."""
    runs = F.bool_or((F.col("key") == "run") & F.coalesce(F.col("value").rlike("|".join(gates)), F.lit(False)))
    goes_on = F.bool_or((F.col("key") == "continue-on-error") & (F.col("value") == "true"))
    return config.where("step is not null").groupBy("doc", "job", "step").agg(runs.alias("a"), goes_on.alias("b")).where("a and b").select("doc", "job", "step")


def _has(key: str) -> Column:
    return F.bool_or((F.col("key") == key) | F.col("key").startswith(key + "."))


def unfiltered_push(config: DataFrame) -> DataFrame:
    """doc of workflows that a push triggers without a branch or tag filter."""
    return config.groupBy("doc").agg(_has("on.push").alias("push"), (_has("on.push.branches") | _has("on.push.tags")).alias("filtered")).where("push and not filtered").select("doc")


def missing_concurrency(config: DataFrame) -> DataFrame:
    return config.groupBy("doc").agg(_has("concurrency").alias("has")).where("not has").select("doc")


def reserved_jobs(config: DataFrame, names: list[str]) -> DataFrame:
    return config.where(F.col("job").isin(names)).select("doc", "job").distinct()


def foreign_action_refs(config: DataFrame, approved: list[str]) -> DataFrame:
    """doc, job, step, value of `uses` whose ref is not an approved one."""
    rows = config.where((F.col("key") == "uses") & F.contains("value", F.lit("@")))
    return rows.where(~F.substring_index("value", "@", -1).isin(approved)).select("doc", "job", "step", "value")


def effective_grants(config: DataFrame, scope: str) -> DataFrame:
    """doc, job, level of a permission: the job's block, else the workflow's, else none."""
    key = f"permissions.{scope}"
    jobs = config.where("job is not null").groupBy("doc", "job").agg(F.max(F.when(F.col("key") == key, F.col("value"))).alias("own"), _has("permissions").alias("blocked"))
    flow = config.where(F.col("job").isNull()).groupBy("doc").agg(F.max(F.when(F.col("key") == key, F.col("value"))).alias("flow"))
    level = F.when(F.col("blocked"), F.coalesce("own", F.lit("none"))).otherwise(F.coalesce("flow", F.lit("none")))
    return jobs.join(flow, "doc", "left").select("doc", "job", level.alias("level"))


def covers(granted: Column, wanted: str) -> Column:
    order = F.array(*map(F.lit, LEVELS))
    return F.array_position(order, granted) >= LEVELS.index(wanted) + 1


def comment_weight(runs: DataFrame, code: DataFrame, floor: int) -> DataFrame:
    """runs(doc_id, run_no, text) that weigh floor characters or more, and more than the code(doc_id, run_no, text) below them."""
    size = lambda c: F.length(F.regexp_replace(c, r"\s", ""))
    below = code.select("doc_id", "run_no", size(F.col("text")).alias("n_code"))
    rows = runs.select("doc_id", "run_no", size(F.col("text")).alias("n_comment")).join(below, ["doc_id", "run_no"], "left")
    return rows.where((F.col("n_comment") >= floor) & (F.col("n_comment") > F.coalesce("n_code", F.lit(0))))
