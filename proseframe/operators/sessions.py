"""Sessions of turns: repeated calls, turns from records, and evidence that is still fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.wordlists import STREAK_GAP_SECONDS, STREAK_TURNS

SESSION, SIG, START, END = "session", "sig", "started_at", "ended_at"


def streaks(turns: DataFrame, gap_seconds: int = STREAK_GAP_SECONDS, order: tuple[str, ...] = (START, END, SIG)) -> DataFrame:
    """session, sig, n, first_at, last_at: maximal runs of turns(session, sig, started_at, ended_at) with one signature and small gaps.

    A gap is the next start less the last end, zero at least. Turns without a signature belong to none.
    `order` has to settle the place of every turn; by default turns of one start go by their end, then their signature.
    """
    place = W.partitionBy(SESSION).orderBy(*order)
    gap = F.greatest(F.unix_micros(START) - F.unix_micros(F.lag(END).over(place)), F.lit(0))
    new = F.when((F.lag(SIG).over(place) == F.col(SIG)) & (gap <= gap_seconds * 1_000_000), 0).otherwise(1)
    rows = turns.withColumn("_new", new).withColumn("_island", F.sum("_new").over(place))
    runs = rows.groupBy(SESSION, "_island").agg(F.first(SIG).alias(SIG), F.count(F.lit(1)).alias("n"), F.min(START).alias("first_at"), F.max(END).alias("last_at"))
    return runs.where(F.col(SIG) != "").select(SESSION, SIG, "n", "first_at", "last_at")


def trailing_streaks(turns: DataFrame, gap_seconds: int = STREAK_GAP_SECONDS, least: int = STREAK_TURNS, order: tuple[str, ...] = (START, END, SIG)) -> DataFrame:
    """The run that the last turn of each session belongs to, where it has `least` turns."""
    last = turns.groupBy(SESSION).agg(F.max(F.struct(*order, F.col(SIG).alias("s"))).alias("last")).select(SESSION, F.col("last.s").alias(SIG))
    place = W.partitionBy(SESSION).orderBy(F.desc("first_at"), F.desc("last_at"))
    runs = streaks(turns, gap_seconds, order).withColumn("_rn", F.row_number().over(place)).where("_rn = 1").drop("_rn")
    return runs.join(last, [SESSION, SIG], "left_semi").where(F.col("n") >= least)


def turn_numbers(records: DataFrame, session: str, order: list[str], is_prompt: Column) -> DataFrame:
    """records with turn_no: a prompt opens a turn; what stands before the first one is turn 0."""
    place = W.partitionBy(session).orderBy(*order)
    return records.withColumn("turn_no", F.sum(F.when(is_prompt, 1).otherwise(0)).over(place))


def turn_signatures(calls: DataFrame, key: list[str], call: str) -> DataFrame:
    """key, sig, n_calls: the sorted canonical calls of a turn, one on a line."""
    return calls.groupBy(*key).agg(F.concat_ws("\n", F.array_sort(F.collect_list(call))).alias(SIG), F.count(F.lit(1)).alias("n_calls"))


def recent_records(records: DataFrame, session: str, order: list[str], ts: str, seconds: int = STREAK_GAP_SECONDS) -> DataFrame:
    """Records of a session's last `seconds`; one without a time takes that of the one before it, else of the one after it."""
    place = W.partitionBy(session).orderBy(*order)
    before = F.last(ts, ignorenulls=True).over(place.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(ts, ignorenulls=True).over(place.rowsBetween(0, W.unboundedFollowing))
    rows = records.withColumn("filled_at", F.coalesce(before, after)).withColumn("_last", F.max("filled_at").over(W.partitionBy(session)))
    return rows.where(F.unix_micros("filled_at") >= F.unix_micros("_last") - seconds * 1_000_000).drop("_last")


def since_last_signal(records: DataFrame, session: str, order: list[str], is_signal: Column) -> DataFrame:
    """Records after a session's last signal; all of them where there was none."""
    place = W.partitionBy(session).orderBy(*order)
    rows = records.withColumn("_n", F.row_number().over(place))
    rows = rows.withColumn("_signal", F.max(F.when(is_signal, F.col("_n"))).over(W.partitionBy(session)))
    return rows.where(F.col("_signal").isNull() | (F.col("_n") > F.col("_signal"))).drop("_n", "_signal")


def answered_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls(id, ...) with results(tool_use_id, is_error): those answered without an error."""
    good = results.where(~F.coalesce("is_error", F.lit(False))).select(F.col("tool_use_id").alias("id")).distinct()
    return calls.join(good, "id", "left_semi")


def terminal_subjects(records: DataFrame) -> DataFrame:
    """subject: settled by a record(record_id, subject) that names exactly one."""
    one = records.groupBy("record_id").agg(F.min("subject").alias("subject"), F.count_distinct("subject").alias("n")).where("n = 1")
    return one.select("subject").distinct()


def full_tally(text: Column) -> Column:
    """Every `N/M builds passed` in a text has N = M and M over 0, and there is one."""
    n, m = (F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)/(\d+) builds? passed"), k), lambda x: x.cast("long")) for k in (1, 2))
    return (F.size(n) > 0) & F.forall(F.arrays_zip(n.alias("n"), m.alias("m")), lambda p: (p["n"] == p["m"]) & (p["m"] > 0))


def repeated_reads(reads: DataFrame, settled: DataFrame, seen: DataFrame) -> DataFrame:
    """reads(read_id, subjects array) that ask for a subject already settled, or read since the last signal."""
    rows = reads.select("read_id", F.explode("subjects").alias("subject"))
    return rows.join(settled.select("subject").union(seen.select("subject")).distinct(), "subject", "left_semi").select("read_id", "subject")


def used_tool(records: DataFrame, session: str, order: list[str], is_prompt: Column, used: Column) -> DataFrame:
    """session, used: whether a record since the last prompt used the tool."""
    rows = turn_numbers(records, session, order, is_prompt).withColumn("_used", used)
    last = rows.withColumn("_last", F.max("turn_no").over(W.partitionBy(session))).where("turn_no = _last")
    return last.groupBy(session).agg(F.bool_or("_used").alias("used"))


def is_status_read(call: Column) -> Column:
    """A call that only asks for the state of a pull request, a check or a commit."""
    return call.rlike(r"^\s*(gh (pr (view|checks|status)|run (view|list|watch))|git (status|log|ls-remote))(\s|$)")


def subjects_in(call: Column) -> Column:
    """The subjects a call names, sorted: pr:owner/repo#n, and sha: with seven digits."""
    prs = F.transform(F.regexp_extract_all(call, F.lit(r"([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#[0-9]+)"), 1), lambda x: F.concat(F.lit("pr:"), x))
    shas = F.regexp_extract_all(call, F.lit(r"(?<![0-9A-Za-z])([0-9a-f]{7,40})(?![0-9A-Za-z])"), 1)
    shas = F.transform(F.filter(shas, lambda x: x.rlike("[0-9]") & x.rlike("[a-f]")), lambda x: F.concat(F.lit("sha:"), F.substring(x, 1, 7)))
    return F.array_sort(F.array_distinct(F.concat(prs, shas)))
