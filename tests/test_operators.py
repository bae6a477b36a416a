"""Operators whose texts the driver tables do not hold, on seeded rows."""

from __future__ import annotations

import difflib
import json
import random

from pyspark.sql import functions as F

from proseframe.functions import kinds as K
from proseframe.functions import numbers as N
from proseframe.functions import segment as S
from proseframe.functions import wordlists as L
from proseframe.operators import config_rules, dead_names, messages, near_lines, numbering, references, repair, rewrites, rules, sessions, snapshots
from proseframe.sources import tables


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def one(spark, column, value):
    return texts(spark, value).select(column(F.col("text")).alias("x")).first().x


def test_sentences(spark):
    got = one(spark, S.sentences_of, 'See e.g. the lexer. It runs! "Then it stops." (A note.) version 1.2 stays. 3 files. etc. and so on')
    assert got == ["See e.g. the lexer.", "It runs!", '"Then it stops."', "(A note.) version 1.2 stays.", "3 files. etc. and so on"]
    assert one(spark, S.sentences_of, "") == [] and one(spark, S.sentences_of, None) is None
    assert one(spark, S.message_sentences_of, "a.b c. D!\ne") == ["a.b c.", "D!", "e"]
    assert one(spark, S.word_count, "It (a b c) isn't") == 3


def test_spliced_commas(spark):
    cases = {
        "The cache holds rows, it drops them.": [", it drops"],
        "It runs, and  they do not stop. A b c, x": [", and they do"],
        "If the cache is cold, it waits": [],
        "And if it is cold, it waits": [],
        "The row (so, it is) stays, but the two old not keeps it": [", but the two old not keeps"],
        "a, it is, it was": [", it was"],
        "It works well,it is": [],
        "It is so, the big red fast car moves": [],
        "": [],
    }
    for text, want in cases.items():
        assert one(spark, rules.spliced_commas, text) == want, text
    assert one(spark, rules.spliced_commas, None) is None


def test_fences(spark):
    t = "a\n```\nb\n~~~\nc\n```\nd"
    assert one(spark, lambda c: S.fenced_mask(S.lines_of(c)), t) == [False, True, True, True, False, True, True]
    assert one(spark, lambda c: S.fenced_mask(S.lines_of(c), same_marker=True), t) == [False, True, True, True, True, True, False]
    assert one(spark, S.asserted_text, "a\n> b\n```\nc\n```\n    d\ne") == "a\n\n\n\n\n\ne"


def test_blocks(spark):
    t = "---\ntitle: x\n---\n# Head\nOne line\nanother\n\n- item\n  more\n- two\n| a | b |\nSigned-off-by: me\n{{ tag }}\n42"
    got = [(b.kind, b.start_line, b.end_line, b.marker, b.text) for b in one(spark, S.blocks_of, t) if b.kind == "prose"]
    assert got == [("prose", 5, 6, "", "One line another"), ("prose", 8, 9, "-", "- item more"), ("prose", 10, 10, "-", "- two")]
    assert one(spark, S.blocks_of, "") [0].kind == "verbatim"


def test_mask(spark):
    assert one(spark, S.mask_prose, 'a `b;c` [x](http://y;z) &amp; "q" [#x1-#x2]') == "a  CODE  [x](URL)  ENTITY   QUOTE   "


def test_sections_and_comments(spark):
    rows = S.sections(texts(spark, "intro\n# A\nx\n```\n# no\n```\n## B\ny")).orderBy("section_no").collect()
    assert [(r.section_no, r.heading, r.n_lines) for r in rows] == [(0, None, 1), (1, "A", 5), (2, "B", 2)]
    rows = S.comment_runs(texts(spark, "// a\n// b\ncode\n# c\n")).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.prefix, r.text) for r in rows] == [(1, 2, "//", "a b"), (4, 4, "#", "c")]
    rows = S.table_cells(texts(spark, "| a | b |\n|---|---|\n| c | d |")).orderBy("line_no", "cell_no").collect()
    assert [r.cell for r in rows] == ["a", "b", "c", "d"]


def test_canonical_json(spark):
    assert one(spark, S.canonical_json, '{"b":"1","a":"x"}') == '{"a":"x","b":"1"}'
    assert one(spark, S.canonical_json, '{"a":"x","b":"y z","a":"w"}') == '{"a":"w","b":"y z"}'
    assert one(spark, S.canonical_json, '{"b":{"y":1,"x":[{"d":1.50,"c":null}]},"a":"é"}') == '{"a":"é","b":{"x":[{"c":null,"d":1.5}],"y":1}}'
    assert one(spark, S.canonical_json, '[{"b":1, "a":2}]') == '[{"a":2,"b":1}]' and one(spark, S.canonical_json, '{"a":1,"b":{"z":1},"a":2}') == '{"a":2,"b":{"z":1}}'
    assert one(spark, S.canonical_json, "{}") == "{}" and one(spark, S.canonical_json, "no object") is None and one(spark, S.canonical_json, None) is None


def dice(a, b):
    x = [s.strip() for s in a.split("\n") if s.strip()]
    y = [s.strip() for s in b.split("\n") if s.strip()]
    common = sum(min(x.count(k), y.count(k)) for k in set(x))
    return 2 * common / (len(x) + len(y)) if x and y else 0


def test_short_documents_of_common_lines_give_no_pair_for_each_two(spark, monkeypatch):
    """300 documents share two of three lines, so 44,850 pairs are alike; each document names only few of them."""
    found, short = [], near_lines._short_pairs
    monkeypatch.setattr(near_lines, "_short_pairs", lambda *args: found.append(short(*args)) or found[-1])
    docs = spark.createDataFrame([(i, f"one\ntwo\nown {i}") for i in range(300)] + [(900, "two"), (901, "one\ntwo\nown 7\nown 8")], "doc_id long, text string")
    got = {r.doc_b: r.doc_a for r in near_lines.near_duplicates(docs, 0.6).collect()}
    assert got == {i: 0 for i in range(1, 300)} | {901: 7}
    assert found[0].count() <= 24 * 302


def test_only_lines_of_paired_documents_are_sorted_for_portions(spark):
    docs = spark.createDataFrame([(0, "a\nb"), (1, "a\nb\nc"), (2, "a")], "doc_id long, text string")
    rows = near_lines.copied_portions(docs, spark.createDataFrame([(0, 1)], "doc_a long, doc_b long"))
    assert [tuple(r) for r in rows.select("doc_a", "doc_b", "start", "end").collect()] == [(0, 1, 1, 2)]
    assert "LeftSemi" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for g in range(5):
        base = [f"line {g} {i % 17}" for i in range(40)]
        for k in range(4):
            t = list(base)
            for _ in range(k):
                t[rng.randrange(40)] = f"new {rng.random()}"
            rows.append("\n".join(t))
    rows += ["", " \n ", "a\na\na", "a\na", rows[0]]
    rows += [rows[2], rows[19], rows[2], "a\na"]
    for share in (0.95, 0.8, 2 * 38 / 80):
        want = {}
        for b in range(len(rows)):
            a = next((a for a in range(b) if dice(rows[a], rows[b]) >= share), None)
            if a is not None:
                want[b] = a
        got = {r.doc_b: r.doc_a for r in near_lines.near_duplicates(texts(spark, *rows), share).collect()}
        assert got == want, share
    docs = texts(spark, "a\nb", "b\na", "a\nb", "a\nb").withColumn("name", F.when(F.col("doc_id") < 3, F.when(F.col("doc_id") == 1, "y").otherwise("x")))
    assert [tuple(r) for r in near_lines.near_duplicates(docs, block=["name"]).collect()] == [(0, 2, 1.0)]


def test_copied_portions_and_their_removal(spark):
    docs = texts(spark, "a\nb\nc\nd", "x\na\nb\ny\nd\na")
    pairs = spark.createDataFrame([(0, 1)], "doc_a long, doc_b long")
    rows = near_lines.copied_portions(docs, pairs)
    assert sorted((r.start, r.end) for r in rows.collect()) == [(2, 3), (5, 5)]
    left = near_lines.without_ranges(docs.where("doc_id = 1"), rows.select(F.col("doc_b").alias("doc_id"), "start", "end"))
    assert left.first().text == "x\ny\na"


def test_dead_names(spark):
    docs = texts(spark, "calls loadEverything once", "and loadEverything too", "only foreignJobName here", "has twiceNamed_x and twiceNamed_x", "short aB")
    names = dead_names.dead_names(docs)
    assert [(r.doc_id, r.name) for r in names.collect()] == [(2, "foreignJobName")]
    paths = spark.createDataFrame([("src/foreignJobName.go",)], "path string")
    assert dead_names.without_file_names(names, paths).count() == 0


def test_changed_lines_in_order(spark):
    rng = random.Random(3)
    base = [[f"l{rng.randrange(9)}" for _ in range(12)] for _ in range(20)]
    head = []
    for t in base:
        t = list(t)
        for _ in range(3):
            t[rng.randrange(len(t))] = f"n{rng.randrange(9)}"
        head.append(t)
    got = snapshots.changed_lines_in_order(texts(spark, *map("\n".join, base)), texts(spark, *map("\n".join, head)))
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    for i, (a, b) in enumerate(zip(base, head, strict=True)):
        same = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert counts.get(i, 0) == len(b) - same
    moved = snapshots.changed_lines(texts(spark, "a\nb"), texts(spark, "b\na\na"))
    assert [r.line_no for r in moved.collect()] == [3]


def test_changed_copies_of_lines(spark):
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    base, head = docs((0, "a\nb\na\n"), (1, None), (2, "x")), docs((0, "\na\na\nc\na\n"), (1, "p\np"), (2, None), (3, ""))
    got = sorted((r.doc_id, r.line_no, r.line) for r in snapshots.changed_lines(base, head).collect())
    assert got == [(0, 4, "c"), (0, 5, "a"), (0, 6, ""), (1, 1, "p"), (1, 2, "p"), (3, 1, "")]


def test_open_runs(spark):
    runs = lambda t: [tuple(r) for r in one(spark, lambda c: rules.open_runs(F.transform(S.words_of(c), F.lower), 2), t)]
    assert runs("Build cache key of the file and new row key store") == [(0, 3), (7, 4)] and runs("") == [] and runs("of the") == []


def test_numbers_inside_large_groups(spark):
    rng = random.Random(4)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{i % 5}", None if i % 90 == 0 else "s") for i in rng.sample(range(10**6), 900)]
    rows += [(None, "lone", "s")]
    docs = spark.createDataFrame(rows, "id long, k string, s string")
    got = {r.id: r.rn for r in numbering.numbered(docs, ["k", "s"], "id", parts=7).collect()}
    assert got == {i: 1 if i is None else sum(a == b and c == d and (j or 0) <= i for j, a, c in rows for b, d in [(k, s)]) for i, k, s in rows}
    assert numbering.numbered(docs.limit(0), ["k"], "id").count() == 0


def test_tagged_snapshot(spark):
    rows = spark.createDataFrame([("s1", 1, "p", "d", "v1"), ("s2", 2, "p", "d", None)], "snapshot string, seq long, path string, digest string, tag string")
    head = spark.createDataFrame([("p", "d"), ("q", "e")], "path string, digest string")
    assert snapshots.nearest_snapshot(head, rows, tagged=True).first().snapshot == "s1"
    assert tuple(snapshots.nearest_snapshot(head, rows).first()) == ("s2", 1)


def turns(spark, rows):
    data = spark.createDataFrame([(s, g, float(a), float(b)) for s, g, a, b in rows], "session long, sig string, a double, b double")
    return data.select("session", "sig", F.timestamp_micros((F.col("a") * 1e6).cast("long")).alias("started_at"), F.timestamp_micros((F.col("b") * 1e6).cast("long")).alias("ended_at"))


def test_streak_edges(spark):
    rows = [(1, "x", 0, 1), (1, "x", 301, 302), (1, "x", 600, 603), (1, "x", 602, 604)]  # a gap at the limit, then a negative one
    rows += [(2, "x", 0, 0), (2, "x", 301, 301)]  # a second over the limit
    rows += [(3, "x", 0, 0), (3, "y", 1, 1), (3, "x", 2, 2)] + [(4, "x", 0, 0), (4, "", 1, 1)]
    got = sorted((r.session, r.sig, r.n) for r in sessions.streaks(turns(spark, rows)).collect())
    assert got == [(1, "x", 4), (2, "x", 1), (2, "x", 1), (3, "x", 1), (3, "x", 1), (3, "y", 1), (4, "x", 1)]
    assert [r.session for r in sessions.trailing_streaks(turns(spark, rows)).collect()] == [1]


def test_transcript_evidence(spark):
    records = spark.createDataFrame([(1, 1, None), (1, 2, 100), (1, 3, None), (1, 4, 500)], "s long, n long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert [r.n for r in sessions.recent_records(records, "s", ["n"], "ts", 300).collect()] == [4]
    after = sessions.since_last_signal(records, "s", ["n"], F.col("n") == 2)
    assert sorted(r.n for r in after.collect()) == [3, 4]
    calls = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    results = spark.createDataFrame([("a", False), ("b", True)], "tool_use_id string, is_error boolean")
    assert [r.id for r in sessions.answered_calls(calls, results).collect()] == ["a"]
    settled = sessions.terminal_subjects(spark.createDataFrame([(1, "p"), (2, "q"), (2, "r")], "record_id long, subject string"))
    assert [r.subject for r in settled.collect()] == ["p"]
    reads = spark.createDataFrame([(1, ["p", "z"]), (2, ["y"])], "read_id long, subjects array<string>")
    assert [tuple(r) for r in sessions.repeated_reads(reads, settled, settled.limit(0)).collect()] == [(1, "p")]
    assert [one(spark, sessions.full_tally, t) for t in ("3/3 builds passed", "3/3 builds passed, 2/4 builds passed", "0/0 builds passed", "none")] == [True, False, False, False]
    assert one(spark, sessions.subjects_in, "gh pr view a/b#7 at 0a1b2c3d4e and 1234567") == ["pr:a/b#7", "sha:0a1b2c3"]
    assert one(spark, sessions.is_status_read, "gh pr checks 7") and not one(spark, sessions.is_status_read, "git push")


def test_messages(spark):
    data = texts(spark, "This is PRE-existing, out of\nscope.", "```\nout of scope\n```", "> not my fault", "Shall I go?", None, "Which one do you want? Tell me.", "It runs.").withColumnRenamed("doc_id", "msg_id")
    assert sorted((r.msg_id, r.phrase) for r in messages.phrase_hits(data, L.BLAME_PHRASES).collect()) == [(0, "out of scope"), (0, "pre-existing")]
    assert [r.msg_id for r in messages.deferrals(data).collect()] == [3]
    assert sorted(r.msg_id for r in messages.questions(data).collect()) == [3, 5]
    pair = spark.createDataFrame([("It is not so.", "It is so."), ("It never is.", "It isn't.")], "a string, b string")
    assert [r.x for r in pair.select(rewrites.keeps_negation(F.col("a"), F.col("b")).alias("x")).collect()] == [False, True]


def test_edits(spark):
    docs = texts(spark, "hello world", None)
    edits = spark.createDataFrame([(0, 0, 5, "bye"), (0, 3, 7, "no"), (0, 6, 11, "moon"), (0, 11, 11, "!"), (0, 5, 99, "far"), (1, 0, 1, "x")], "doc_id long, start int, end int, text string")
    admitted, refused = repair.gate_edits(docs, edits)
    assert refused.count() == 3
    assert {r.doc_id: r.text for r in repair.splice(docs, admitted).collect()} == {0: "bye moon!", 1: None}
    scope = spark.createDataFrame([(0, 0, 5)], "doc_id long, start int, end int")
    assert repair.gate_edits(docs, edits, scope)[0].count() == 1


def test_cuts_and_parts(spark):
    assert one(spark, lambda c: repair.cut_sentences(c, lambda s: F.contains(s, F.lit("bad"))), "Good. bad one. Fine.\nbad.\n\nLast") == "Good. Fine.\n\nLast"
    assert one(spark, lambda c: repair.divided(c, 12, 99), "One two. Three. Four five six seven.") == ["One two.", "Three.", "Four five six seven."]
    assert one(spark, repair.joined_lines, "One\ntwo\n\n# H\nthree\nfour") == "One two\n\n# H\nthree four"
    sections = spark.createDataFrame([(0, 1, 50), (0, 2, 30), (0, 3, 10)], "doc_id long, section_no int, n_chars long")
    assert [r.section_no for r in repair.sections_to_move(sections, F.lit(90), 45).collect()] == [1]


def test_references(spark):
    docs = texts(spark, "see https://x.org/1a2b3c4 and a/b#12, 1a2b3c4d, 12345678, #7 on fix/bug-1", "uses: a/act@v1\nuses: c/d/sub@main")
    got = [(r.kind, r.token) for r in references.references(docs).where("doc_id = 0").orderBy("start").collect()]
    assert got == [("url", "https://x.org/1a2b3c4"), ("issue", "a/b#12"), ("sha", "1a2b3c4d"), ("issue", "#7"), ("branch", "fix/bug-1")]
    starts = {r.token: r.start for r in references.references(docs).where("doc_id = 0").collect()}
    assert starts["a/b#12"] == docs.first().text.index("a/b#12")
    refs = spark.createDataFrame([("a/act", "v1", "tag", "trunk"), ("c/d", "dev", "branch", "dev")], "repo string, ref string, kind string, default_branch string")
    assert sorted(tuple(r)[1:] for r in references.used_refs(docs, refs).collect()) == [("a/act", "v1", "tag", "trunk"), ("c/d", "main", "missing", "dev")]
    known = spark.createDataFrame([("issue", "#7", "u")], "kind string, token string, url string")
    assert references.resolved_references(references.references(docs), known).where("url = 'u'").count() == 1
    cites = references.section_citations(texts(spark, "# 1 Start here\nsee § 1 and section 9.2")).orderBy("number").collect()
    assert [(r.number, r.anchor) for r in cites] == [("1", "1-start-here"), ("9.2", None)]
    paths = [(1, "docs/a.md", "# 2 Two\n# 2 Two again\nsee b.md § 4"), (2, "./docs/sub/b.md", "# 4 Four\nsee ../a.md, section 2, c.md section 1, e.md § 1 and sub/none.md § 2"), (3, "x/c.md", "# 1 One"), (4, "y/c.md", "# 1 Uno"), (5, "e.md", "# 1 E"), (6, "z/e.md", None)]
    cites = references.section_citations(spark.createDataFrame(paths, "doc_id long, path string, text string"))
    assert {(r.doc_id, r.name, r.target, r.anchor) for r in cites.collect()} == {(1, "b.md", 2, "4-four"), (2, "a.md", 1, "2-two"), (2, "c.md", None, None), (2, "e.md", 5, "1-e"), (2, "sub/none.md", None, None)}
    assert cites.count() == 5
    assert one(spark, references.slug, "The Great, Big Plan") == "the-great-big"
    assert one(spark, lambda c: references.without_query_parameter(c, "v"), "http://x/a?v=1&b=2#t") == "http://x/a?b=2#t"
    assert one(spark, lambda c: references.without_query_parameter(c, "v"), "http://x/a?v=1") == "http://x/a"
    assert one(spark, references.has_credentials, "https://u:p@x.org/r") and not one(spark, references.has_credentials, "https://x.org/a@b")


def test_pull_states(spark):
    rows = [
        ("MERGED", None, None, ["FAILURE"], "merged"), ("CLOSED", "CONFLICTING", None, None, "closed"), ("OPEN", "CONFLICTING", None, ["FAILURE"], "failing"),
        ("OPEN", "MERGEABLE", None, ["SUCCESS", "STARTUP_FAILURE"], "failing"), ("OPEN", "MERGEABLE", None, ["ACTION_REQUIRED"], "failing"),
        ("OPEN", "CONFLICTING", None, ["PENDING"], "conflict"), ("OPEN", "MERGEABLE", "DIRTY", [], "conflict"), ("OPEN", "MERGEABLE", None, ["EXPECTED"], "pending"),
        ("OPEN", None, "BEHIND", ["SKIPPED", "NEUTRAL"], "ready"), ("OPEN", None, None, None, "ready"), (None, None, None, [None], "ready"),
    ]
    data = spark.createDataFrame(rows, "s string, m string, g string, c array<string>, want string")
    got = data.select("want", references.pull_state(F.col("s"), F.col("m"), F.col("g"), F.col("c")).alias("x")).collect()
    assert [r.x for r in got] == [r.want for r in got]


def test_config_rules(spark):
    rows = [
        ("a", None, None, "on.push", "", 1), ("a", None, None, "permissions.id-token", "write", 2), ("a", "j", 1, "run", "just lint", 3), ("a", "j", 1, "continue-on-error", "true", 4),
        ("a", "j", 1, "run", "again", 5), ("a", "j", 2, "uses", "x/y@main", 6), ("b", None, None, "on.push.branches", "main", 1), ("b", None, None, "concurrency", "g", 2),
        ("b", "k", None, "permissions.contents", "read", 3), ("b", "k", 1, "uses", "x/y@v1", 4), ("b", "all-builds", 1, "run", "x", 5),
    ]
    c = spark.createDataFrame(rows, "doc string, job string, step int, key string, value string, line int")
    assert [r.key for r in config_rules.duplicate_step_keys(c).collect()] == ["run"]
    assert [(r.doc, r.step) for r in config_rules.neutered_gates(c, ["lint"]).collect()] == [("a", 1)]
    assert [r.doc for r in config_rules.unfiltered_push(c).collect()] == ["a"]
    assert [r.doc for r in config_rules.missing_concurrency(c).collect()] == ["a"]
    assert [r.job for r in config_rules.reserved_jobs(c, ["all-builds"]).collect()] == ["all-builds"]
    assert [r.value for r in config_rules.foreign_action_refs(c, ["v1"]).collect()] == ["x/y@main"]
    grants = {(r.doc, r.job): r.level for r in config_rules.effective_grants(c, "id-token").collect()}
    assert grants == {("a", "j"): "write", ("b", "k"): "none", ("b", "all-builds"): "none"}
    assert one(spark, lambda t: config_rules.covers(t, "read"), "write") and not one(spark, lambda t: config_rules.covers(t, "write"), "read")
    runs = spark.createDataFrame([(1, 1, "x " * 130), (1, 2, "short")], "doc_id long, run_no int, text string")
    assert [r.run_no for r in config_rules.comment_weight(runs, runs.limit(0), 120).collect()] == [1]


def test_scalars(spark):
    assert one(spark, K.twelve_hour_text, "at 14:05, 00:30 and 9:00 but 1:02:03, 10:30 min or 3:15 pm") == "at 2:05 PM, 12:30 AM and 9:00 AM but 1:02:03, 10:30 min or 3:15 pm"
    kinds = ["<?xml version='1'?>", "<html>", '{"a": 1}', "SELECT a FROM b", "def f(x):", "const a = 1", "#!/bin/sh\necho a", "a: 1\nb: 2", "# T\ntext", "plain words"]
    assert [one(spark, K.content_kind, t) for t in kinds] == ["xml", "html", "json", "sql", "python", "javascript", "shell", "yaml", "markdown", "text"]
    got = texts(spark, "").select(*(N.vague_amount(F.lit(n)).alias(f"n{n}") for n in (1, 2, 5, 20, 21))).first()
    assert tuple(got) == ("a couple of", "a couple of", "a few", "several", "many")


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"\x7fELF....")
    (tmp_path / "a" / "y.txt").write_text("hello\nyou")
    assert [r.kind for r in tables.executables(spark, str(tmp_path / "a")).collect()] == ["ELF"]
    assert [r.text for r in tables.text_tree(spark, str(tmp_path / "a"), "*.txt").collect()] == ["hello\nyou"]
    (tmp_path / "t.jsonl").write_text('{"type":"user","sessionId":"s","message":{"role":"user","content":"[1]"}}\nbroken\n{"type":"user","sessionId":"s","isSidechain":true}\n{"type":"x","sessionId":"o"}\n')
    assert [r.message.content for r in tables.transcript(spark, str(tmp_path / "t.jsonl"), "s").collect()] == ["[1]"]
    docs = spark.createDataFrame([("src/a.go", "x"), ("vendor/b.go", "x"), ("c.go", "// Code generated by y. DO NOT EDIT.\n")], "path string, text string")
    assert [r.path for r in tables.own_texts(docs).collect()] == ["src/a.go"]
    kinds = spark.createDataFrame([("a.md",), ("b.py",), (".github/workflows/c.yml",), ("d.yaml",)], "path string")
    assert [r.k for r in kinds.select(tables.file_kind(F.col("path")).alias("k")).collect()] == ["document", "source", "workflow", "source"]
    rows = spark.createDataFrame([("a", "utilise", "use", "prose", False, "Utilise it", "use it"), ("b", "x", "y", None, True, "z", "y")], "rule_id string, match string, replace string, surface string, case_sensitive boolean, test_in string, test_out string")
    assert tables.rule_rows(rows, "comment").count() == 1
    assert [r.rule_id for r in tables.failing_rule_rows(rows).collect()] == ["b"]


def test_transcript_blocks_to_streaks(spark, tmp_path):
    def record(minute, role, content, session="s", side=False):
        return json.dumps({"type": role, "timestamp": f"2024-05-01T10:{minute:02}:00Z", "sessionId": session, "isSidechain": side, "message": {"role": role, "content": content}})

    rows = []
    for k in range(4):
        rows += [record(2 * k, "user", "go on"), record(2 * k, "assistant", [{"type": "text", "text": "I look."}, {"type": "tool_use", "name": "Read", "id": f"c{k}", "input": {"b": [1, {"z": 1, "a": 2}], "a": "x"} if k % 2 else {"a": "x", "b": [1, {"a": 2, "z": 1}]}}])]
        rows += [record(2 * k + 1, "user", [{"type": "tool_result", "tool_use_id": f"c{k}", "is_error": k == 2, "content": "ok"}])]
    rows += ["no json {", record(20, "user", None), record(21, "assistant", [{"type": "tool_use", "name": "Other", "id": "z", "input": {}}], side=True), record(22, "assistant", [7, {"type": 3}])]
    (tmp_path / "t.jsonl").write_text("\n".join(rows))
    blocks = tables.transcript_blocks(tables.transcript(spark, f"{tmp_path}/t.jsonl"))
    got = [(r.kind, r.name, r.call_id, r.answers, r.is_error) for r in blocks.orderBy("record_no", "at").collect()]
    assert got[:4] == [("text", None, None, None, False), ("text", None, None, None, False), ("tool_use", "Read", "c0", None, False), ("tool_result", None, None, "c0", False)]
    assert len(got) == 17 and sum(r[4] for r in got) == 1
    turns = tables.transcript_turns(blocks)
    assert {r.sig for r in turns.collect()} == {'Read {"a":"x","b":[1,{"a":2,"z":1}]}'} and turns.count() == 4
    runs = sessions.trailing_streaks(turns, 300)
    assert [r.n for r in runs.collect()] == [4]
