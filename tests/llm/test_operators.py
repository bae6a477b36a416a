"""Each operator against brute force on small fixtures, with nulls, empty texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseframe.llm import (
    chat_format, common, decontaminate, embedding_dedup, line_dedup, lm_score, minhash, packing, suffix_dedup, textarrays, toxicity, url_filter,
)
from proseframe.llm.components import connected_components

R = random.Random(7)
WORDS = ["the", "of", "naïve", "thing", "an", "er", "Über", "zwei", "bee", "long-word"]


def text(n: int) -> str:
    return " ".join(R.choice(WORDS) + str(R.randrange(60)) for _ in range(n))


def docs(spark, rows):
    """doc_id and text with columns whose names the operators use themselves."""
    schema = "doc_id long, text string, row string, lines long, kept string, key string, node string, span long"
    return spark.createDataFrame([(*r, "x", 1, "y", "z", "n", 2) for r in rows], schema).repartition(3)


ODD_ROWS = [(900, None), (901, ""), (902, "\n\n"), (903, "one"), (903, "one"), (None, "one two three four five six"), (None, None), (904, "z" * 30_000)]


def test_url_filter(spark):
    urls = ["http://A.example.org/es/1?q", "https://x.net/fr/9#t", "http://e.com/de/", "no scheme", None, "http://org/", "ftp://b.example.com", "http://example.org/en/17", "x://com/fr/://org/es/"]
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {
        (0, "a.example.org", "/es/1", "example.org/es/", "block"), (1, "x.net", "/fr/9", None, "allow"), (2, "e.com", "/de/", "com/de/", "block"), (3, "", "", None, "allow"),
        (4, "", "", None, "allow"), (5, "org", "/", "org/", "allow"), (6, "b.example.com", "", None, "allow"), (7, "example.org", "/en/17", "example.org/en/1", "block"), (8, "com", "/fr/://org/es/", "com/fr/", "allow"),
    }
    assert url_filter.filter_urls(pages, rules).count() == len(urls) + 1
    assert url_filter.filter_urls(pages.limit(0), rules.limit(0)).count() == 0


def test_line_dedup(spark):
    rows = [(i, f"  Shared line\n{text(3)}\nshared LINE\t\n\nonly {i}") for i in range(12)] + [(50, "twice\ntwice"), (51, "twice")] + ODD_ROWS
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_common_lines(docs(spark, rows), 10).collect()}
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    held = defaultdict(set)
    for r in set(rows):
        for line in (r[1] or "").split("\n"):
            held[line.strip(strip).translate(lower)].add(r)
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (x.strip(strip) and len(held[x.strip(strip).translate(lower)]) >= 10)]
        assert got[r] == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.drop_common_lines(docs(spark, rows), 10).count() == len(rows)
    assert line_dedup.drop_common_lines(docs(spark, ODD_ROWS[:1]).limit(0), 10).count() == 0


def test_decontamination(spark):
    items = [(i, text(n)) for i, n in enumerate([40, 12, 9, 3, 2, 1, 25])] + [(7, None), (8, "... !"), (None, text(11)), (9, "one")]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in (t or "")))
    rows = [(i, text(30) + (" " + items[i % 7][1].upper() if i % 3 == 0 else "") + " " + text(8)) for i in range(30)]
    rows += [(60, " ".join(items[0][1].split()[5:16])), (61, " ".join(items[0][1].split()[5:14])), (62, (items[3][1] + " ") * 5)] + ODD_ROWS
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + 10])].add(item)
    got = {(r.doc_id, r.text): (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.find_contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= {str(n) for n in names if n is not None}
        assert got[r] == (len(w), len(hit), sorted(found)), r
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs(spark, rows), none).where("n_hit > 0").count() == 0


def test_chat_format(spark):
    turns = lambda c, *ts: [(c, i, r, t, "clash") for i, (r, t) in enumerate(ts)]
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "more")
    rows = turns(1, a) + turns(2, a, b) + turns(3, a, b, c) + turns(4, a, b, c) + turns(5, b) + turns(6, ("user", None)) + turns(7, ("user", ""), b) + turns(8, (None, "hi")) + turns(9, ("user", "hih"), b)
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat_format.format_chats(data).collect()}
    assert set(got) == {3, 5, 6, 7, 8, 9}
    assert got[3] == (3, "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nmore\n")
    assert chat_format.format_chats(data.limit(0)).count() == 0


def components(links, ids):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for x, y in links:
            m = min(low[x], low[y])
            changed |= low[x] != m or low[y] != m
            low[x] = low[y] = m
    return low


def test_spread_join_deals_a_hot_key_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)] + [(None, 1), ("alone", 2)], "key string, i long")
    counts = rows.where("key is not null and key != 'alone'").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    for how in ("left_semi", "inner"):
        got = common.spread_join(rows, counts, "key", "n", F.col("i"), how)
        assert sorted(r.i for r in got.collect()) == list(range(300)) and "_salt" not in got.columns
    assert common.spread_join(rows, counts.limit(0), "key", "n", F.col("i")).count() == 0


def test_connected_components_of_a_large_star(spark):
    star = spark.range(1, 20_001).select((F.col("id") + 7).alias("a"), F.lit(7).cast("long").alias("b"))
    got = connected_components(star)
    assert got.count() == 20_001 and got.where("root != 7").count() == 0


def test_connected_components(spark):
    links = [(R.randrange(120), R.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    want = components(links, {x for p in links for x in p})
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(k, k) == v for k, v in want.items())
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows():
    rows = []
    for g in range(6):
        base = text(150).split()
        for k in range(8):
            t = list(base)
            for _ in range(k):
                t[R.randrange(len(t))] = f"edit{R.randrange(999)}"
            rows.append((len(rows), " ".join(t)))
    return rows + [(100, rows[0][1].upper()), (101, rows[3][1] + "  "), (102, "a b"), (103, "A\tb"), *ODD_ROWS]


@pytest.mark.parametrize("size", [4, 5])
def test_minhash(spark, size):
    rows = near_rows()

    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in (t or ""))) if x]
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())

    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    links = [(x, y) for x, s in sets for y, t in sets if x != y and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    low = components(links, {d for d, _ in sets})
    got = minhash.near_duplicates(docs(spark, rows), size, 80).collect()
    assert len(got) == len(rows) and len(set(low.values())) < len(low) - 15
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (low[r.doc_id], low[r.doc_id] == r.doc_id)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, len(shingles(t))) for d, t in rows)
    assert minhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_odd_sketches_estimate_similarity_and_bound_difference():
    rng = np.random.default_rng(3)
    for n_common, n_own in ((900, 50), (200, 30), (5000, 900), (1, 1)):
        common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (n_common, n_own, n_own))
        _, odd, whole = minhash._signatures([np.unique(np.concatenate((common, a))), np.unique(np.concatenate((common, b)))])
        bits = lambda x: int(np.unpackbits((x[0] ^ x[1]).view(np.uint8)).sum())
        assert bits(whole) <= 2 * n_own
        n = 64 * minhash.SKETCH_WORDS
        assert 0 < bits(odd) < n
        if n_common > 1:
            assert abs(minhash.estimated_similarity(bits(odd)) - n_common / (n_common + 2 * n_own)) < 0.1


@pytest.mark.parametrize("percent", [80, 60])
def test_sample_sketches_rule_out_no_pair_at_the_threshold(percent):
    rng, most, n = np.random.default_rng(6), 0, 64 * minhash.SKETCH_WORDS
    for size in (5, 20, 100, 1000):
        for _ in range(60):
            shared = -(-2 * size * percent // (100 + percent))
            pool = rng.integers(0, 2**63, 2 * size - shared, dtype=np.uint64)
            _, odd, _ = minhash._signatures([np.unique(pool[:size]), np.unique(pool[size - shared :])])
            most = max(most, int(np.unpackbits((odd[0] ^ odd[1]).view(np.uint8)).sum()))
    limit = minhash.sample_limit(percent)
    assert most < limit < n / 2 and limit - most > 20


@pytest.mark.parametrize("tile_rows", [16, 4096])
def test_embedding_dedup(spark, monkeypatch, tile_rows):
    rng = np.random.default_rng(1)
    rows = []
    for label in range(3):
        centres = rng.normal(size=(6, 16))
        for k in range(60):
            rows.append((len(rows), [float(np.float32(x)) for x in centres[k % 6] + rng.normal(scale=0.12, size=16)], label))
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(30)]
    huge, tiny = [1e200, 2e200, -1e199] + [0.0] * 13, [1e-200, 2e-200, -1e-201] + [0.0] * 13
    rows += [(600 + i, v, 2) for i, v in enumerate([huge, [2 * x for x in huge], tiny, [0.5 * x for x in tiny]])]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] + [1.0] * 15, 1), (504, rows[0][1], None), (505, [1.0], 0), (506, [], 0), (None, rows[0][1], 0)]
    data = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    unit = lambda v: np.array(v) / np.abs(v).max()
    ok = [(i, unit(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(i, j) for i, v, a in ok for j, w, b in ok if i != j and a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98]
    low, n = components(links, [r[0] for r in rows]), Counter(i for i, _ in links)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 7)
    got = embedding_dedup.embedding_duplicates(data, 0.98, tile_rows=tile_rows).collect()
    assert len(got) == len(rows) and len(links) > 100
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == ((n[r.vec_id], low[r.vec_id], low[r.vec_id] == r.vec_id) if r.vec_id is not None else (0, None, True))
    assert embedding_dedup.embedding_duplicates(data.limit(0)).count() == 0


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 32)) * rng.choice([1e-3, 1, 50], (200, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embedding_dedup.quantise(x)
    near = (q * s[:, None]) @ (q * s[:, None]).T
    bound = e[:, None] * (1 + e)[None] + (1 + e)[:, None] * e[None] + e[:, None] * e[None]
    assert (np.abs(near - x @ x.T) <= bound).all()


def brute_strings(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(mark)) if mark[i] and (not i or not mark[i - 1]))
        out.append((d, len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, y in zip(b, mark, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length", [40, 200])
def test_suffix_dedup(spark, length):
    passages = [text(45) for _ in range(3)]
    rows = [(i, text(R.randrange(5, 90)) + (" " + R.choice(passages) + " " + text(5) if i % 3 == 0 else "")) for i in range(40)]
    rows += near_rows()[:14] + [(200, "ab" * 400), (201, "x" * 900), (202, "é" * 150)] + ODD_ROWS[:-1]
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeated_strings(docs(spark, rows), length).collect()), key=str)
    assert got == brute_strings(rows, length)
    assert suffix_dedup.remove_repeated_strings(docs(spark, rows).limit(0), length).count() == 0


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_memory_equals_whole_texts():
    texts = [text(200), "Ünï <|endoftext|>x don't I'LL It's 12 34,5\ta  b", "", " ", "İstanbul ΣΑΣ. ǅ ªº Åh क़.", "ab́c é 日本語 русский!", "a\x1cb\u00a0c"]
    memory = packing.TokenMemory(tokenizer_path())
    want = [np.array(memory.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert packing.token_bytes(texts, tokenizer_path()) == want
    assert packing.token_bytes(texts, tokenizer_path()) == want


def test_first_fit_decreasing():
    sizes = np.random.default_rng(1).integers(1, 101, 700)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    rooms, want = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, room in enumerate(rooms) if room >= sizes[i]), len(rooms))
        rooms += [100] * (k == len(rooms))
        want[i] = (k, 100 - rooms[k])
        rooms[k] -= sizes[i]
    assert all(want[i] == (bins[i], offsets[i]) for i in range(700))


def test_packing_round_trip(spark):
    rows = [(i, text(R.randrange(1, 400))) for i in range(60)] + ODD_ROWS
    got = packing.pack(docs(spark, rows), tokenizer_path(), 256, 2, group_pieces=40).collect()
    ids = {r: packing.token_bytes([r[1] or ""], tokenizer_path())[0] + (2).to_bytes(4, "little") for r in rows}
    want = Counter((d, s, min(256, len(x) // 4 - s), zlib.crc32(x[4 * s : 4 * s + 1024]), len(x) // 4) for (d, t) in rows for x in [ids[d, t]] for s in range(0, len(x) // 4, 256))
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 256 + 4
    assert packing.pack(docs(spark, rows).limit(0), tokenizer_path()).count() == 0


def edits_within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_automaton_against_edit_distance():
    words, stems = ["idiot", "stupid", "scum", "trash"], ["vequ", "lostra"]
    automaton = toxicity.build_automaton(words, stems)
    letters = "idotscumtrahvequlpx"
    rng = random.Random(5)
    tried = [*words, *stems, "vequabc", "lostr", "lstrazz", "vexu"]
    for w in words + stems:
        for _ in range(60):
            t, i = list(w), rng.randrange(len(w))
            kind = rng.randrange(3)
            t[i : i + (kind != 0)] = rng.choice(letters) if kind != 2 else ""
            tried.append("".join(t) + rng.choice(["", "", "q"]))
    for t in tried:
        state = 1
        for c in t:
            if automaton.settled[state] and state:
                break
            state = automaton.step[state, automaton.class_of[ord(c)]]
        stem = max([toxicity.STEM if t.startswith(s) else (toxicity.FUZZY_STEM if len(s) >= 6 and any(edits_within_one(t[:k], s) for k in range(len(t) + 1)) else 0) for s in stems])
        word = max([toxicity.WORD if t == w else (toxicity.FUZZY_WORD if len(w) >= 5 and edits_within_one(t, w) else 0) for w in words])
        assert automaton.found[state] == max(stem, word), t


def test_quoted_hits_are_told_apart():
    automaton = toxicity.build_automaton(["idiot"], [])
    plain, quoted = toxicity.text_features(["you idiot there", 'he said "idiot" there'], automaton)
    assert plain[1] > 0 and not plain[5] and quoted[5] > 0 and not quoted[1]


def test_letters_beyond_the_basic_plane():
    word = "".join(chr(0x10428 + k) for k in (0, 4, 9, 4, 7))  # small letters of a cased alphabet up there
    automaton = toxicity.build_automaton([word], [])
    got = toxicity.text_features([f"so {word} it is", word.upper(), word[:2] + "x" + word[3:], word[:3], "\U0001f600 " + word], automaton)
    assert [bool(x[1]) for x in got] == [True, True, False, False, True] and [bool(x[0]) for x in got] == [False, False, True, False, False]


def test_long_texts_are_scored_in_slices(spark):
    model = toxicity.ToxicityModel(toxicity.build_automaton(["idiot"], []), np.array([0.0] * 9 + [5.0, -2.0]))
    rows = [(0, "word " * 300_000), (1, "word " * 300_000 + "idiot"), (2, None), (3, "idiot"), (4, "")]
    got = {r.doc_id: r.s for r in spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).select("doc_id", toxicity.toxicity_score(F.col("text"), model).alias("s")).collect()}
    assert got[1] == got[3] > 0.9 and got[0] == got[2] == got[4] < 0.2


def test_closing_mark_after_the_last_word_of_the_window():
    automaton = toxicity.build_automaton(["idiot"], [])
    texts = ['he said "idiot"', 'he said "idiot".', '"idiot a b c d e f" then', '"idiot a b c d e f g" then', 'he said "idiot', '"so" it is']
    got = toxicity.text_features(texts, automaton)
    assert [bool(x[5]) for x in got] == [True, True, True, False, False, False]
    assert [bool(x[1]) for x in got] == [bool(x[9]) for x in got] == [False, False, False, True, True, False]


def test_digits_and_marks_inside_words_are_edits():
    automaton = toxicity.build_automaton(["idiot", "stupid", "trash"], ["lostra"])
    fuzzy = ["an id1ot", "tr@sh", "you.st*pid", "idi.ot", "lost*abc"]
    exact = ["idiot's", "stupid,idea", "x-trash", "trash/bin"]
    none = ["i*i*t", "id 1 ot", "id  ot", 'idi"ot', "st1", "it's", "idi", "ot."]
    got = toxicity.text_features([*fuzzy, *exact, *none, "idi.", "ot"], automaton)
    assert all(x[0] + x[2] > 0 and not x[1] for x in got[: len(fuzzy)])
    assert all(x[1] > 0 and not x[0] for x in got[len(fuzzy) : len(fuzzy + exact)])
    assert not got[len(fuzzy + exact) :].any()


def test_toxicity_learns_held_out_labels(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        t = text(40).split()
        if toxic := int(i % 5 == 0):
            for _ in range(3):
                t.insert(rng.randrange(40), rng.choice(["moronic", "vilest", "moronik", "vilesst"]))
        rows.append((i, " ".join(t)))
        labels.append((i, toxic, "clash"))
    labels += [(None, 1, ""), (1, None, ""), (9_999, 1, "")]
    got = toxicity.score_toxicity(docs(spark, rows + ODD_ROWS), spark.createDataFrame(labels, "doc_id long, toxic int, text string")).collect()
    assert len(got) == len(rows) + len(ODD_ROWS) and all(0 <= r.score <= 1 for r in got)
    truth = {d: x for d, x, _ in labels if x is not None}
    held = [r for r in got if r.held_out and r.doc_id in dict(rows)]
    assert len(held) > 60 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(docs(spark, rows[:5]), none).collect()} == {0.5}


def test_lm_scores_equal_brute_force(spark):
    rows = [(i, text(R.randrange(1, 60))) for i in range(40)] + ODD_ROWS
    data = docs(spark, rows)
    hashes = {}
    for w in {w for _, t in rows for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", (t or "").encode())}:
        d = np.frombuffer(w, np.uint8)
        hashes[w] = int(textarrays.span_hashes(d, np.array([0]), np.array([len(w)]))[0])
    vocabulary = np.array(sorted(hashes.values())[:50], np.uint64)
    net = lm_score.WindowNetwork.started(8)
    got = {(r.doc_id, r.n_tokens): r.log_likelihood for r in lm_score.score_documents(data, vocabulary, np.arange(50), net).collect()}
    for d, t in rows:
        ids = []
        for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", (t or "").encode()):
            k = int(np.searchsorted(vocabulary, np.uint64(hashes[w])))
            known = k < 50 and int(vocabulary[k]) == hashes[w]
            ids.append(k if known else lm_score.TOKENS - lm_score.HASHED + (hashes[w] >> 40) % lm_score.HASHED)
        total = 0.0
        for i, x in enumerate(ids):
            around = [ids[j] if 0 <= j < len(ids) else lm_score.PAD for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.append(np.tanh(net.bias + sum(net.embed[a] * net.place[k] for k, a in enumerate(around))), 1)
            for logits, at in ((h @ net.to_class, x // lm_score.CLASSES), (h @ net.to_token[x // lm_score.CLASSES], x % lm_score.CLASSES)):
                total += logits[at] - np.log(np.exp(logits).sum())
        assert got[d, len(ids)] == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_lm_training_beats_word_frequencies(spark):
    rows = [(i, " ".join(f"{a} {b}" for a, b in (R.choice([("red", "fox"), ("blue", "whale"), ("big", "house")]) for _ in range(40)))) for i in range(150)]
    scored = lm_score.pseudo_likelihood(docs(spark, rows), one_in=2, shard_documents=40, rounds=4)
    mean = scored.agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    assert mean > -np.log(6)  # below it, word frequencies alone would do as well
    assert lm_score.pseudo_likelihood(docs(spark, ODD_ROWS)).count() == len(ODD_ROWS)
    assert lm_score.pseudo_likelihood(docs(spark, ODD_ROWS).limit(0)).count() == 0


@pytest.mark.parametrize("listed", [1 << 18, 900])
def test_lm_gives_every_word_its_own_probability(spark, listed):
    """Words of one token differ by their counts, and the probabilities of all words in one place add up to 1."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(200))) for i in range(200)]
    counts = Counter(w for _, t in rows for w in t.split())
    assert len(counts) > 2000
    # a text of one word has no context, so its likelihood is that word's log-probability in one and the same place
    single = [(1000 + k, w) for k, w in enumerate(sorted(counts))]
    counts.update(w for _, w in single)
    got = {r.doc_id: r.log_likelihood for r in lm_score.pseudo_likelihood(docs(spark, rows + single), one_in=1, listed=listed).collect()}
    assert sum(np.exp(got[k]) for k, _ in single) == pytest.approx(1, abs=1e-3)
    d = {w: np.frombuffer(w.encode(), np.uint8) for w in counts}
    v = lm_score.list_words(lm_score.word_counts(docs(spark, rows + single)), listed)
    assert len(v.words) == max(k for n in set(counts.values()) if (k := sum(c >= n for c in counts.values())) <= listed)
    groups = defaultdict(list)
    for k, w in single:
        tokens, *_ = lm_score.word_tokens(d[w], np.array([0, len(d[w])]), v.words, v.token_of)
        groups[int(tokens[0])].append((counts[w], got[k]))
    assert max(len({n for n, _ in g}) for g in groups.values()) > 1
    for g in groups.values():
        for n, x in g:
            assert x - g[0][1] == pytest.approx(np.log(n / g[0][0]), abs=1e-4)


@pytest.mark.parametrize("shard_documents", [500, 60])
def test_lm_learns_from_every_document_by_default(spark, shard_documents):
    """Beats word frequencies with its defaults, at a size where one document in 40 is next to none."""
    rng = random.Random(10)
    pairs = [("red", "fox"), ("blue", "whale"), ("big", "house")]
    rows = [(i, " ".join(f"{a} {b}" for a, b in (rng.choice(pairs) for _ in range(100)))) for i in range(180)]
    scored = lm_score.pseudo_likelihood(docs(spark, rows), shard_documents=shard_documents)
    mean = scored.agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    counts = Counter(w for _, t in rows for w in t.split())
    unigram = sum(n * np.log(n / counts.total()) for n in counts.values()) / counts.total()
    assert mean > unigram + 0.1


def test_lm_gradient_by_finite_differences():
    rng = np.random.default_rng(12)
    net = lm_score.WindowNetwork.started(6)
    net.to_token[:], net.to_class[:] = rng.normal(0, 0.3, net.to_token.shape), rng.normal(0, 0.3, net.to_class.shape)
    target = rng.integers(0, lm_score.TOKENS, 40)
    context = rng.integers(0, lm_score.TOKENS + 1, (40, 2 * lm_score.REACH))
    context[:, 1] = context[:, 0]  # a token that stands twice in a window

    def loss(flat: np.ndarray) -> float:
        x = lm_score.WindowNetwork(*net.filled(flat).__dict__.values())
        for name, values in zip(x.__dict__, _parts(net, flat), strict=True):
            setattr(x, name, values)
        h = np.hstack([np.tanh(sum(x.embed[context[:, k]] * x.place[k] for k in range(4)) + x.bias), np.ones((40, 1))])
        total = 0.0
        for i, t in enumerate(target):
            for logits, at in ((h[i] @ x.to_class, t // lm_score.CLASSES), (h[i] @ x.to_token[t // lm_score.CLASSES], t % lm_score.CLASSES)):
                total -= logits[at] - np.log(np.exp(logits).sum())
        return total / 40

    before = net.flat().astype(np.float64)
    net.train_step(context, target, 0.5)
    gradient = (before - net.flat()) / 0.5
    sizes = np.cumsum([0] + [x.size for x in net.__dict__.values()])
    places = np.concatenate([a + rng.choice(b - a, min(12, b - a), replace=False) for a, b in zip(sizes[:-1], sizes[1:], strict=True)])
    places = np.concatenate([places, np.argsort(-np.abs(gradient))[:30]])
    for at in places:
        up, down = before.copy(), before.copy()
        up[at] += 1e-4
        down[at] -= 1e-4
        assert gradient[at] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-5, rel=1e-3)


def _parts(net, flat):
    at = 0
    for x in net.__dict__.values():
        yield flat[at : at + x.size].reshape(x.shape)
        at += x.size
