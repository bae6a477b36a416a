"""The match language against a direct matcher."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from proseframe.operators import word_match as M

LEXICON = {
    "article": M.WordClass(("a", "the")), "noun": M.WordClass(("cache", "row", "run")), "verb": M.WordClass(("run", "holds", "is")),
    "past": M.WordClass(endings=("ed",)), "count": M.WordClass(digits=True), "open": M.WordClass(open=True), "other": M.WordClass(open=True, barred=("past",)),
}
MATCHES = {
    "plain": "{article} {open}", "named": "the {open*:what} {noun:thing}", "either": "{article|verb:x} {noun+verb:y}", "many": "{open*} is {past:how}",
    "word": "the cache", "other": "{noun} {other} {count*:n} {verb}",
}


def fits(term, word):
    def member(c):
        x, listed = LEXICON[c], {w for k in LEXICON.values() for w in k.words}
        return (
            word in x.words or any(word.endswith(e) and len(word) > len(e) for e in x.endings) or (x.digits and word.isdigit())
            or (x.open and word not in listed and not any(word.endswith(e) and len(word) > len(e) for b in x.barred for e in LEXICON[b].endings))
        )

    return term.word == word if term.word else any(map(member, term.classes)) and all(map(member, term.also))


def direct(words, match):
    terms, out, i = M.parse_match(match, LEXICON), [], 0
    while i < len(words):
        at, caught = i, {}
        for t in terms:
            start = at
            while at < len(words) and fits(t, words[at].lower()) and (t.many or at == start):
                at += 1
            if at == start and not t.many:
                break
            if t.name:
                caught[t.name] = " ".join(words[start:at])
        else:
            out.append((i, at, caught))
            i = at
            continue
        i += 1
    return out


def test_matches_equal_a_direct_matcher(spark):
    rng = random.Random(4)
    words = ["a", "the", "The", "cache", "row", "run", "holds", "is", "fixed", "ed", "thing", "Old", "big"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 14)))) for i in range(250)] + [(999, None), (998, ""), (997, "the the the cache cache")]
    found = M.class_matches(spark.createDataFrame(rows, "doc_id long, sentence string"), LEXICON, MATCHES).collect()
    got = {(r.doc_id, r.match_id, r.start, r.end, tuple(sorted(r.captures.items()))) for r in found}
    want = {(d, k, a, b, tuple(sorted(c.items()))) for d, s in rows for k, m in MATCHES.items() for a, b, c in direct((s or "").split(), m)}
    assert got == want and len(found) == len(want) and {r.match_id for r in found} == set(MATCHES)
    digits = spark.createDataFrame([(["row", "thing", "12", "7", "is"],)], "w array<string>").select(M.matched(F.col("w"), MATCHES["other"], LEXICON).alias("m")).first().m
    assert [(m.start, m.end, m.captures) for m in digits] == [(0, 5, {"n": "12 7"})]


@pytest.mark.parametrize("bad", ["", "{", "{}", "{article", "{nothing}", "{article*}", "{a|}", "{article+}"])
def test_malformed_matches_are_refused(bad):
    with pytest.raises(ValueError):
        M.parse_match(bad, LEXICON)


def test_shapes_are_rewritten(spark):
    texts = ["The very old cache is fixed. It runs.", "the, old cache", "A thing, the row", "No match here", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    made = lambda match, to: [r.x for r in rows.select("i", M.rephrased(F.col("text"), match, to, LEXICON).alias("x")).orderBy("i").collect()]
    assert made("the {open*:what} {noun:thing}", "this {thing} {what}")[:3] == ["This cache very old is fixed. It runs.", "the, old cache", "A thing, this row"]
    assert made("very {open:x}", "{x}")[0] == "The old cache is fixed. It runs."
    assert made("{article}", "")[2:] == [" thing, row", "No match here", None, ""]
    with pytest.raises(ValueError):
        M.rephrased(F.lit(""), "the {noun}", "{x}", LEXICON)
