"""Phrase mining, hard negatives and fingerprints against brute force, with nulls, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseframe.llm import fingerprint, hard_negatives, phrases

R = random.Random(11)
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- phrases ---------------------------------------------------------------------------------------


def brute_phrases(rows, min_count, most_words, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals[lang] += len(w)
            for m in range(1, most_words + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = set()
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= min_count}
        inner = defaultdict(int)
        for p, a in frequent.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inner[p[i : i + n]] = max(inner[p[i : i + n]], a)
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and 100 * inner[p] < 100 * a:
                score, _, left, right = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return out


def phrase_rows():
    words = ["the", "of", "Über", "née", "a", "A", "b", "c-d", " x", "日本"]
    piece = lambda n: " ".join(R.choices(words, weights=[9, 8, 3, 3, 6, 2, 5, 2, 1, 1], k=n))
    rows = [(f"{piece(R.randrange(1, 30))}{R.choice('.,;:!?')}\t {piece(R.randrange(0, 9))}\n{piece(5)}\r{piece(2)}", R.choice(["en", "de", None])) for _ in range(120)]
    return [*rows, (None, "en"), ("", None), (" \t\n.", "fr"), ("a a a a a a", "xx"), rows[0], rows[0], ("of the née " * 4000, "en"), ("one", "one")]


@pytest.mark.parametrize(("shard", "top"), [(1 << 18, 2000), (60, 9)])
def test_phrases(spark, shard, top):
    rows = phrase_rows()
    docs = spark.createDataFrame([(*r, i, "x", "y") for i, r in enumerate(rows)], "text string, lang string, word long, phrase string, n string").repartition(5)
    got = [tuple(r) for r in phrases.mine_phrases(docs, min_count=4, top=top, shard_phrases=shard).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, 4, 5, top)


def test_no_phrases(spark):
    docs = spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")
    assert phrases.mine_phrases(docs, min_count=2).count() == 0 and phrases.mine_phrases(docs.limit(0)).count() == 0


def test_trie_holds_its_sequences_alone():
    sequences = np.unique(np.column_stack((np.random.default_rng(3).integers(41, 43, 900), np.random.default_rng(4).integers(0, 40, (900, 3)))), axis=0)
    trie = phrases.Trie(sequences, 40, 2)
    known = {tuple(x) for x in sequences}
    for x in [*sequences[:200], *np.random.default_rng(5).integers(0, 41, (400, 4))]:
        state = np.array([1])
        for symbol in x:
            state = trie.step(state, np.array([symbol]))
        assert (state[0] > 0) == (tuple(x) in known)
    assert len(set(trie.final)) == len(sequences)


def test_a_trie_of_many_words_is_built_in_seconds():
    """The work of placing children grows with their number, not with the square of the vocabulary."""
    rng = np.random.default_rng(7)
    n_words, words = 300_000, (rng.pareto(0.9, (200_000, 2)) * 40).astype(np.int64) % 300_000
    sequences = np.unique(np.column_stack((rng.integers(n_words + 1, n_words + 5, len(words)), words)), axis=0)
    began = time.monotonic()
    trie = phrases.Trie(sequences, n_words, 4)
    assert time.monotonic() - began < 20
    state = np.ones(len(sequences), np.int64)
    for symbols in sequences.T:
        state = trie.step(state, symbols)
    assert (state == trie.final).all() and len(np.unique(state)) == len(sequences) and state.min() > 1


def test_counts_of_a_task_are_sent_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 3)
    monkeypatch.setattr(phrases, "BYTES", 50)
    rows = phrase_rows()[:40]
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array([r[0] for r in rows]), "lang": pa.array([r[1] or "und" for r in rows])})
    total = Counter()
    for part in phrases.count_words(iter([batch, batch])):
        for r in part.to_pylist():
            total[r["lang"], r["word"]] += r["n"]
    want = Counter()
    for text, lang in rows * 2:
        want.update((lang or "und", w) for w in re.split("[ \t.,;:!?\n\x0b\x0c\r]+", text.translate(LOWER)) if w)
    assert total == want


# --- hard negatives --------------------------------------------------------------------------------


def brute_negatives(rows, asked, k=5, scale=256):
    used = sorted({(i, label, tuple(math.floor(scale * float(x)) for x in v)) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    out = set()
    for anchor, label, v in used:
        if anchor not in asked:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), i, other) for i, other, w in used if i != anchor and len(w) == len(v)]
        positives = sorted(((-s, i) for s, i, other in scored if other == label))[:k]
        for ps, positive in {(-s, i) for s, i in positives}:
            fit = sorted((-s, i) for s, i, other in scored if other != label and 80 * ps <= 100 * s <= 100 * ps)[:k]
            out |= {(anchor, positive, n, i, ps, -s) for n, (s, i) in enumerate(fit, 1)}
    return out


def vectors(scale=1.0, n=260):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 4))
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in scale * (centres[rng.integers(0, 6)] + rng.normal(size=4) * 0.2)]) for i in range(n)]
    copies = [(1000 + i, rows[i % 3][1], rows[i % 3][2]) for i in range(80)]  # groups of equal vectors
    odd = [(2000, None, rows[0][2]), (None, 1, rows[1][2]), (2001, 1, None), (2002, 1, [1.0, None, 0.0, 0.0]), (2003, 1, [1.0, float("nan"), 0.0, 0.0]), (2004, 2, [float("inf")] * 4)]
    return [*rows, *copies, *odd, (2005, 1, [0.0] * 4), (2006, 0, [0.0] * 4), (2007, 1, [1.0, 2.0]), (2008, 0, [1.0, 2.0]), (2009, 0, [1.0, 1.9]), (2010, 1, []), rows[5], rows[5], (rows[7][0], 2, rows[8][2])]


@pytest.mark.parametrize(("tiles", "clusters", "step"), [((4096, 16384), 16, 1024), ((7, 40), 3, 16)])
def test_hard_negatives(spark, monkeypatch, tiles, clusters, step):
    monkeypatch.setattr(hard_negatives, "STEP_ROWS", step)
    rows = vectors()
    data = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, label int, embedding array<float>, node int, class string, score double").repartition(3)
    stored = [(r.vec_id, r.label, r.embedding) for r in data.collect()]
    asked = {r[0] for r in rows if r[0] is not None and r[0] % 5 == 0}
    got = [tuple(r) for r in hard_negatives.hard_negatives(data, F.col("vec_id") % 5 == 0, tile_anchors=tiles[0], tile_rows=tiles[1], clusters=clusters).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(stored, asked)
    assert hard_negatives.hard_negatives(data.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.hard_negatives(data, F.lit(False)).count() == 0


def test_hard_negatives_beyond_double_precision(spark):
    rows = vectors(scale=3e6, n=60)
    data = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {tuple(r) for r in hard_negatives.hard_negatives(data, F.col("vec_id") % 5 == 0, tile_rows=30).collect()}
    assert got == brute_negatives(rows, {r[0] for r in rows if r[0] is not None and r[0] % 5 == 0})
    huge = spark.createDataFrame([(i, i % 2, [1e30, 1.0]) for i in range(6)], "vec_id long, label int, embedding array<double>")
    assert all(r.positive_score == (1 << 63) - 1 for r in hard_negatives.hard_negatives(huge, F.lit(True)).collect())


# --- fingerprints ----------------------------------------------------------------------------------


def brute_lanes(text):
    lanes = [0] * 136
    for line in text.split("\n"):
        whole = hashlib.sha256(line.encode()).hexdigest()
        for k in range(8):
            lanes[k] += int(whole[8 * k : 8 * k + 8], 16)
        for piece in re.findall("[^ ]+(?: +[^ ]+){0,3}", line):
            bits = int(hashlib.md5(piece.encode()).hexdigest()[:4], 16)
            lanes[8 + bits % 128] += 1 if bits % 256 < 128 else -1
    return [x % (1 << 32 if k < 8 else 1 << 16) for k, x in enumerate(lanes)]


def brute_print(text):
    return "".join(f"{x:08x}" if k < 8 else f"{x:04x}" for k, x in enumerate(brute_lanes(text)))


def brute_likeness(a, b):
    if brute_print(a) == brute_print(b):
        return 1.0
    x, y = ([v - 65536 if v >= 32768 else v for v in brute_lanes(t)[8:]] for t in (a, b))
    norm = sum(v * v for v in x) * sum(v * v for v in y)
    return max(0.0, min(1.0, sum(p * q for p, q in zip(x, y, strict=True)) / math.sqrt(norm))) if norm else 0.0


def texts():
    line = lambda: " ".join(R.choice(["the", "naïve", "日本語", "🙂", "of", "thing"]) + str(R.randrange(30)) for _ in range(R.randrange(0, 14)))
    return ["\n".join(line() for _ in range(R.randrange(1, 9))) for _ in range(60)] + ["", "a", "abc", "abcd", "\n\n", "x" * 30_000, "w " * 9000, "  two  blanks ", "tab\there"]


@pytest.mark.parametrize("buckets", [None, 1, 50])
def test_compare_edited(spark, buckets):
    rows = [(3 * i - 50, t) for i, t in enumerate(texts())] + [(10_000, None), (10_001, "last " * 50)]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, bucket string, place int, ghost string").repartition(4)
    got = {r.doc_id: r for r in fingerprint.compare_edited(docs, buckets).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        own, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(own) // 4
        edited = own[: len(own) - q] + after[:q]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (brute_print(own), brute_print(edited))
        assert r.near_edited == pytest.approx(brute_likeness(own, edited)) and r.near_next == pytest.approx(brute_likeness(own, after))


def test_ids_that_repeat_or_lack(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (None, None), *[(7, f"text {i}") for i in range(40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_chars) for r in fingerprint.compare_edited(docs, 8).collect()]
    assert Counter(got) == Counter((i, len(t or "")) for i, t in rows)
    assert fingerprint.compare_edited(docs.limit(0)).count() == 0
    alone = fingerprint.compare_edited(docs.where("text = 'd'")).first()
    assert alone.near_next == 1.0 and alone.near_edited == 1.0


def test_paragraphs_in_any_order_and_by_steps(spark):
    texts_ = ["one two three\nfour\nfive six", "five six\none two three\nfour", "five six", "one two three\nfour", "one two three\nfour\nfive seven"]
    docs = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert prints[0] == prints[1] != prints[4]
    row = spark.createDataFrame([tuple(prints[k] for k in range(5))], [f"p{k}" for k in range(5)])
    got = row.select(
        fingerprint.inserted(F.col("p3"), F.col("p2")).alias("a"), fingerprint.deleted(F.col("p0"), F.col("p2")).alias("b"),
        fingerprint.likeness(F.col("p0"), F.col("p1")).alias("same"), fingerprint.likeness(F.col("p0"), F.col("p4")).alias("near"),
    ).first()
    assert (got.a, got.b, got.same) == (prints[0], prints[3], 1.0) and got.near == pytest.approx(brute_likeness(texts_[0], texts_[4]))
