"""Streams of messages and turns: stateless rules, and keyed state that survives restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.wordlists import STREAK_GAP_SECONDS, STREAK_TURNS
from ..operators.rules import select_rules
from ..plans import check as plan

#: Keyed state of what sends nothing for this long is dropped.
IDLE_SECONDS = 86_400
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """The keyed processors below need a state store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def judge_stream(messages: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Findings of each arriving messages(doc_id, text); the rules are those of a batch that read one text, and keep no state."""
    return plan.check(messages, rules or [r.id for r in select_rules() if r.find])


class StreakProcessor(StatefulProcessor):
    """Keeps the last signature, its end and the length of its run for each session, until it is idle for too long."""

    def __init__(self, gap_seconds: float, least: int, idle_ms: int) -> None:
        self.gap, self.least, self.idle_ms = gap_seconds, least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        run = StructType([StructField("sig", StringType()), StructField("ended", DoubleType()), StructField("n", LongType())])
        self.state = handle.getValueState("run", run, ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sig, ended, n = self.state.get() if self.state.exists() else ("", 0.0, 0)
        turns = pd.concat(list(rows)).sort_values(["started_s", "turn_id"])  # rows of a batch come in no order
        out = []
        for t in turns.itertuples():
            near = max(0.0, t.started_s - ended) <= self.gap
            n = n + 1 if n and t.sig == sig and near else 1
            sig, ended = t.sig, t.ended_s
            if sig and n >= self.least:
                out.append((key[0], sig, n, t.turn_id))
        self.state.update((sig, float(ended), int(n)))
        yield pd.DataFrame(out, columns=["session", "sig", "n", "turn_id"])

    def close(self) -> None:
        pass


def streak_alerts(turns: DataFrame, gap_seconds: float = STREAK_GAP_SECONDS, least: int = STREAK_TURNS, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """session, sig, n, turn_id: each turn that stands in a run of turns(session, sig, started_s, ended_s, turn_id) as the `least`-th or later.

    A session that sends nothing for idle_seconds is forgotten.
    """
    out = StructType([StructField("session", LongType()), StructField("sig", StringType()), StructField("n", LongType()), StructField("turn_id", LongType())])
    return turns.groupBy("session").transformWithStateInPandas(StreakProcessor(gap_seconds, least, int(1000 * idle_seconds)), out, "Append", "ProcessingTime")


class LedgerProcessor(StatefulProcessor):
    """Keeps when each subject of a session was last settled or read, until it is idle for too long."""

    def __init__(self, life_seconds: float, idle_ms: int) -> None:
        self.life, self.idle_ms = life_seconds, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        subject, at = StructType([StructField("subject", StringType())]), StructType([StructField("at", DoubleType())])
        self.seen = handle.getMapState("seen", subject, at, ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        records, out = pd.concat(list(rows)).sort_values(["at_s", "record_id"]), []
        for r in records.itertuples():
            known = self.seen.getValue((r.subject,))[0] if self.seen.exists() and self.seen.containsKey((r.subject,)) else None
            fresh = known is not None and r.at_s - known <= self.life
            if r.kind == "read" and fresh:
                out.append((key[0], r.record_id, r.subject))
            if r.kind == "settled" or not fresh:  # a refused read does not lengthen the life of the evidence
                self.seen.updateValue((r.subject,), (float(r.at_s),))
        yield pd.DataFrame(out, columns=["session", "record_id", "subject"])

    def close(self) -> None:
        pass


def repeated_reads(records: DataFrame, life_seconds: float = STREAK_GAP_SECONDS, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """session, record_id, subject: reads of records(session, record_id, kind, subject, at_s) whose subject was settled or read lately."""
    out = StructType([StructField("session", LongType()), StructField("record_id", LongType()), StructField("subject", StringType())])
    return records.groupBy("session").transformWithStateInPandas(LedgerProcessor(life_seconds, int(1000 * idle_seconds)), out, "Append", "ProcessingTime")


class FenceProcessor(StatefulProcessor):
    """Keeps whether a message's last flush ended inside a code fence."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", StructType([StructField("open", BooleanType())]), ttlDurationMs=3_600_000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        inside = bool(self.open.get()[0]) if self.open.exists() else False
        out, ended = [], False
        for f in pd.concat(list(rows)).sort_values("seq").itertuples():
            for n, line in enumerate(f.text.split("\n")):
                fence = line.lstrip().startswith(("```", "~~~"))
                out.append((key[0], f.seq, n + 1, line, inside or fence))
                inside ^= fence
            if f.final:
                inside, ended = False, True
        if ended:
            self.open.clear()
        else:
            self.open.update((inside,))
        yield pd.DataFrame(out, columns=["message_id", "seq", "line_no", "line", "fenced"])

    def close(self) -> None:
        pass


def fenced_lines(flushes: DataFrame) -> DataFrame:
    """message_id, seq, line_no, line, fenced of flushes(message_id, seq, final, text); a fence stays open over flushes, for an hour at most."""
    out = StructType([
        StructField("message_id", StringType()), StructField("seq", LongType()), StructField("line_no", LongType()), StructField("line", StringType()), StructField("fenced", BooleanType()),
    ])
    return flushes.groupBy("message_id").transformWithStateInPandas(FenceProcessor(), out, "Append", "ProcessingTime")


class AnswerProcessor(StatefulProcessor):
    """Keeps the last answer to each key and when it was given; a finished one stays."""

    def __init__(self, life_seconds: float, finished: tuple[str, ...], idle_ms: int) -> None:
        self.life, self.finished, self.idle_ms = life_seconds, finished, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        answer = StructType([StructField("answer", StringType()), StructField("at", DoubleType())])
        self.kept = handle.getValueState("answer", answer, ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        answer, at = self.kept.get() if self.kept.exists() else (None, 0.0)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at_s", "request_id"]).itertuples():
            cached = answer is not None and (answer in self.finished or r.at_s - at <= self.life)
            if not cached and isinstance(r.now, str):  # an unknown is no answer, and is never kept
                answer, at = r.now, float(r.at_s)
            out.append((r.request_id, key[0], answer if cached or isinstance(r.now, str) else None, cached))
        if answer is not None:
            self.kept.update((answer, at))
        yield pd.DataFrame(out, columns=["request_id", "key", "answer", "cached"])

    def close(self) -> None:
        pass


def answered_lookups(
    requests: DataFrame, known: DataFrame, life_seconds: float = 60, finished: tuple[str, ...] = ("merged", "closed"), idle_seconds: float = 30 * IDLE_SECONDS
) -> DataFrame:
    """request_id, key, answer, cached: every one of requests(request_id, key, at_s) with an answer of known(key, answer), null if there is none.

    An answer serves further requests of its key for life_seconds, a finished one for good; known is
    read anew with each batch. Keys that nobody asks for in idle_seconds are forgotten.
    """
    now = requests.join(known.select("key", F.col("answer").alias("now")), "key", "left").select("request_id", "key", "at_s", "now")
    out = StructType([StructField("request_id", LongType()), StructField("key", StringType()), StructField("answer", StringType()), StructField("cached", BooleanType())])
    processor = AnswerProcessor(life_seconds, finished, int(1000 * idle_seconds))
    return now.groupBy("key").transformWithStateInPandas(processor, out, "Append", "ProcessingTime")


def gap_sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """session, first_at, last_at, n: bursts of events(session, ts) without a gap."""
    grouped = events.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("session", F.col("w.start").alias("first_at"), F.col("w.end").alias("last_at"), "n")
