"""Streams against their batch twins, fed in several batches."""

from __future__ import annotations

import pandas as pd

from proseframe.streaming import live


def run(spark, frames, schema, build, tmp_path, name):
    """Feed frames as one file each and collect what the stream emits."""
    source = tmp_path / name
    source.mkdir()
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    live.with_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # each partition of state costs many small files a batch
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert query.exception() is None
    return spark.table(name).collect()


def test_streaks(spark, tmp_path):
    schema = "session long, sig string, started_s double, ended_s double, turn_id long"
    rows = [(1, "x", float(100 * i), float(100 * i + 1), i) for i in range(5)] + [(2, "x", 0.0, 0.0, 10), (2, "x", 400.0, 400.0, 11), (2, "", 401.0, 401.0, 12)]
    got = run(spark, [rows[:3], rows[3:6], rows[6:]], schema, live.streak_alerts, tmp_path, "streaks")
    assert sorted((r.session, r.n, r.turn_id) for r in got) == [(1, 4, 3), (1, 5, 4)]


def test_ledger(spark, tmp_path):
    schema = "session long, record_id long, kind string, subject string, at_s double"
    rows = [[(1, 1, "settled", "p", 0.0), (1, 2, "read", "q", 1.0)], [(1, 3, "read", "p", 10.0), (1, 4, "read", "q", 20.0)], [(1, 5, "read", "p", 900.0)]]
    got = run(spark, rows, schema, live.repeated_reads, tmp_path, "ledger")
    assert sorted(r.record_id for r in got) == [3, 4]


def test_fences_across_flushes(spark, tmp_path):
    schema = "message_id string, seq long, final boolean, text string"
    rows = [[("m", 1, False, "a\n```\nb")], [("m", 2, True, "c\n```\nd")], [("m", 3, False, "e")]]
    got = run(spark, rows, schema, live.fenced_lines, tmp_path, "fences")
    assert [(r.line, r.fenced) for r in sorted(got, key=lambda r: (r.seq, r.line_no))] == [("a", False), ("```", True), ("b", True), ("c", True), ("```", True), ("d", False), ("e", False)]


def test_rules_lookups_and_sessions(spark, tmp_path):
    got = run(spark, [[(1, "It should run.")], [(2, "It runs.")]], "doc_id long, text string", lambda s: live.judge_stream(s, ["ste/modal"]), tmp_path, "judged")
    assert [r.doc_id for r in got] == [1]
    at = lambda s: (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()
    rows = [[(1, at(0)), (1, at(60))], [(1, at(1000))], [(9, at(90_000))]]
    got = run(spark, rows, "session long, ts timestamp", live.gap_sessions, tmp_path, "bursts")
    assert sorted((r.session, r.n) for r in got if r.session == 1) == [(1, 1), (1, 2)]


def test_lookups_are_all_answered(spark, tmp_path):
    known = spark.createDataFrame([("k", "ready"), ("m", "merged")], "key string, answer string")
    rows = [[(1, "k", 0.0), (2, "k", 1.0)], [(3, "k", 50.0), (4, "n", 51.0), (5, "m", 52.0)], [(6, "k", 90.0), (7, "m", 9000.0), (8, "n", 9001.0)]]
    got = run(spark, rows, "request_id long, key string, at_s double", lambda s: live.answered_lookups(s, known), tmp_path, "lookups")
    assert sorted((r.request_id, r.answer, r.cached) for r in got) == [
        (1, "ready", False), (2, "ready", True), (3, "ready", True), (4, None, False), (5, "merged", False), (6, "ready", False), (7, "merged", True), (8, None, False),
    ]
