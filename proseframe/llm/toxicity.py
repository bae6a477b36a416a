"""Toxicity: a Levenshtein automaton over a learned lexicon trie, with the context of each hit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import written

NOTHING, FUZZY_WORD, WORD, FUZZY_STEM, STEM = range(5)
#: Opening and closing marks count alike.
QUOTES = "\"“”„«»‹›"
#: Words on each side of a hit that make its context.
WINDOW = 6
CODES = 1 << 16
_tables: list[np.ndarray] = []


def _code_tables() -> list[np.ndarray]:
    """For each code point below CODES: its lower case, and whether it is a letter, a quotation mark, something that may stand for a letter."""
    if not _tables:
        chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(CODES)]
        lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.uint16)
        _tables[:] = [lower, np.array([c.isalpha() for c in chars]), np.array([c in QUOTES for c in chars]), np.array([not (c.isalpha() or c.isspace() or c in QUOTES) for c in chars])]
    return _tables


@dataclass(frozen=True)
class Automaton:
    """step[state, class of the code point]; dead states are 0, `found` says what a word that ends in a state is."""

    step: np.ndarray
    class_of: np.ndarray
    found: np.ndarray
    settled: np.ndarray  # nothing that follows changes what is found
    far: dict[str, int] = field(default_factory=dict)  # classes of letters beyond CODES


def build_automaton(words: list[str], stems: list[str], edits: Callable[[str], int] = lambda t: int(len(t) >= 5)) -> Automaton:
    """Intersect the Levenshtein automata of all terms with their trie, made deterministic.

    A word is found where a whole text word is within edits(word) insertions, deletions and
    substitutions of it; a stem where a text word starts so (edits are taken for stems of 6 letters
    or more). Exact matches outrank fuzzy ones.
    """
    children: list[dict[str, int]] = [{}]
    ends: list[list[tuple[bool, int]]] = [[]]  # (stem, edits allowed) of the terms that end in a node
    for terms, stem in ((words, False), (stems, True)):
        for term in terms:
            node = 0
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append([])
                node = children[node][c]
            ends[node].append((stem, edits(term) if not stem or len(term) >= 6 else 0))
    most = max((n for e in ends for _, n in e), default=0)
    alphabet = sorted({c for ch in children for c in ch})

    def closed(pairs: set[tuple[int, int]]) -> frozenset:
        todo = list(pairs)
        while todo:
            node, used = todo.pop()
            if used < most:  # a letter of the term is missing in the text
                for child in children[node].values():
                    if (child, used + 1) not in pairs:
                        pairs.add((child, used + 1))
                        todo.append((child, used + 1))
        return frozenset(pairs)

    def verdict(state: frozenset, stem: bool) -> int:
        hits = [used for node, used in state for s, n in ends[node] if s == stem and used <= n]
        return NOTHING if not hits else (STEM if stem else WORD) - bool(min(hits))

    sink = len(children)  # stands for a stem that was found with edits, whatever follows
    children.append({})
    ends.append([(True, most)])
    start = closed({(0, 0)})
    numbers, order, step = {frozenset(): 0, start: 1}, [frozenset(), start], [[0] * (len(alphabet) + 1)]
    found, settled = [NOTHING], [True]
    at = 1
    while at < len(order):
        state = order[at]
        at += 1
        settled.append(verdict(state, True) == STEM)
        found.append(max(verdict(state, False), verdict(state, True)))
        row = []
        for c in [] if settled[-1] else [None, *alphabet]:
            to = {(children[node][c], used) for node, used in state if c in children[node]}
            to |= {(x, used + 1) for node, used in state if used < most for x in (node, *children[node].values())}
            if verdict(state, True) == FUZZY_STEM:
                to.add((sink, 1))
            to = closed(to)
            if to not in numbers:
                numbers[to] = len(order)
                order.append(to)
            row.append(numbers[to])
        step.append(row or [0] * (len(alphabet) + 1))
    class_of = np.zeros(CODES, np.int32)
    far = {}
    for k, c in enumerate(alphabet):
        if ord(c) < CODES:
            class_of[ord(c)] = k + 1
        else:
            far[c] = k + 1
    return Automaton(np.array(step, np.int32), class_of, np.array(found, np.int8), np.array(settled), far)


def _read_codes(automaton: Automaton, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: its class in the automaton, and whether it is a letter, a quotation mark, something that may stand for a letter."""
    lower, *kinds = _code_tables()
    near = np.minimum(codes, CODES - 1)
    classes, (letter, quote, stands_in) = automaton.class_of[lower[near]], (k[near] for k in kinds)
    at = np.flatnonzero(codes >= CODES)
    if len(at):  # few, so each distinct one is looked up
        chars, which = np.unique(codes[at], return_inverse=True)
        chars = [chr(c) for c in chars.tolist()]
        letter[at] = np.array([c.isalpha() for c in chars])[which]
        stands_in[at] = ~letter[at]
        classes[at] = np.array([automaton.far.get(c.lower(), 0) for c in chars], np.int32)[which]
    return classes, letter, quote, stands_in


def _runs(inside: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def _found(automaton: Automaton, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What each run of `sizes` code points is, from the classes of all code points."""
    states = np.ones(len(starts), np.int32)
    live, k = np.arange(len(starts)), 0
    while len(live):
        live = live[sizes[live] > k]
        states[live] = automaton.step[states[live], classes[starts[live] + k]]
        live = live[(states[live] != 0) & ~automaton.settled[states[live]]]
        k += 1
    return automaton.found[states]


def text_features(texts: list[str], automaton: Automaton) -> np.ndarray:
    """A row of features for each text, from the kinds of its hits and the context windows around them.

    A word may hold one digit or mark in place of a letter or between two letters, which is an edit.
    A hit is quoted if an odd number of quotation marks stands before it in its text and one within
    WINDOW words after it, up to the start of the next word or the end of the text; it is dense if another hit stands within WINDOW words.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    out = np.zeros((len(texts), 10))
    if not len(codes):
        return out
    edge = np.zeros(len(codes) + 1, bool)
    edge[offsets] = True
    classes, letter, quote, stands_in = _read_codes(automaton, codes)
    starts, ends = _runs(letter, edge)
    kinds = _found(automaton, classes, starts, ends - starts)
    text_of_word = np.searchsorted(offsets, starts, "right") - 1
    # two words around one digit or mark may be one word with a letter changed; words that are hits themselves stay apart
    pair = np.flatnonzero((starts[1:] == ends[:-1] + 1) & (text_of_word[1:] == text_of_word[:-1]) & (kinds[1:] == NOTHING) & (kinds[:-1] == NOTHING))
    pair = pair[stands_in[ends[pair]]]
    kinds[pair] = _found(automaton, classes, starts[pair], ends[pair + 1] - starts[pair])
    hits = np.flatnonzero(kinds)
    if not len(hits):
        return out
    marks = np.concatenate(([0], np.cumsum(quote)))
    row = text_of_word[hits]
    odd = (marks[starts[hits]] - marks[offsets[row]]) % 2 == 1
    last = np.minimum(np.searchsorted(starts, offsets[row + 1]) - 1, hits + WINDOW)
    until = np.minimum(np.append(starts, len(codes))[last + 1], offsets[row + 1])
    quoted = odd & (marks[until] > marks[ends[hits]])
    gap = np.diff(hits, prepend=-(WINDOW + 1), append=len(starts) + WINDOW + 1)
    same = np.concatenate(([False], row[1:] == row[:-1], [False]))
    dense = ((gap[:-1] <= WINDOW) & same[:-1]) | ((gap[1:] <= WINDOW) & same[1:])
    kind = kinds[hits].astype(np.int64) - 1
    counts = np.zeros((len(texts), 9))
    np.add.at(counts, (row, np.where(quoted, 4 + kind, kind)), 1)
    np.add.at(counts, (row, np.full(len(row), 8)), dense & ~quoted)
    out[:, :9] = np.log1p(counts)
    out[:, 9] = (counts[:, 1] + counts[:, 3]) > 0  # an exact hit outside quotations
    return out


@dataclass(frozen=True)
class ToxicityModel:
    automaton: Automaton
    weights: np.ndarray  # the last one is the intercept
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(text_features(texts, self.automaton) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def is_held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def learn_toxicity(
    documents: DataFrame, labels: DataFrame, sample_rows: int = 16_000, most_terms: int = 400, min_log_odds: float = 3.0, least_share: float = 0.02
) -> ToxicityModel:
    """Learn lexicon and weights from labels.toxic of rows that are not held out.

    At most sample_rows labelled documents are used, those with the smallest hash of doc_id. The
    lexicon has the words, and the beginnings of 4 to 6 letters that several words share, which at
    least least_share (and 3) of the toxic ones hold and whose log odds of a toxic document reach
    min_log_odds; the most_terms best. Weights of the kinds of hits are fitted to the same rows.
    Null labels and ids, and labels without a document, are left out; of different labels of
    one id the toxic one counts. Where toxic or clean rows are
    missing, every score is the share of toxic rows (0.5 without any).
    """
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    sample = written(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(written(known, "labelled"), "doc_id"), "sample")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+", -1), lambda w: F.length(w) >= 3))
    stems = lambda n: F.transform(F.filter("words", lambda w: F.length(w) > n), lambda w: F.substring(w, 1, n))
    tagged = lambda terms, tag: F.transform(terms, lambda t: F.concat(F.lit(tag), t))
    terms = F.concat(tagged(F.col("words"), "w"), tagged(F.array_distinct(F.concat(*(stems(n) for n in (4, 5, 6)))), "s"))
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n_toxic, n_clean = size["toxic"], size["n"] - size["toxic"]
    if not n_toxic or not n_clean:
        share = n_toxic / size["n"] if size["n"] else 0.5
        return ToxicityModel(build_automaton([], []), np.array([0.0] * 10 + [np.log((share + 1e-9) / (1 - share + 1e-9))]))
    counted = (
        sample.select("toxic", words.alias("words")).select("toxic", F.explode(terms).alias("term"))
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    )
    odds = F.log((F.col("toxic") + 0.5) / n_toxic) - F.log((F.col("clean") + 0.5) / n_clean)
    best = (
        counted.where(F.col("toxic") >= max(3, least_share * n_toxic)).withColumn("odds", odds).where(F.col("odds") >= min_log_odds)
        .orderBy(F.desc("odds"), "term").limit(most_terms).collect()  # most_terms rows
    )
    support = {r["term"]: r["toxic"] for r in best}
    # a beginning counts if it catches more than any word or shorter beginning that it stands for
    chosen: list[str] = []
    for stem in sorted((t[1:] for t in support if t[0] == "s"), key=lambda t: (len(t), t)):
        whole = max((n for t, n in support.items() if t[0] == "w" and t[1:].startswith(stem)), default=0)
        if support["s" + stem] >= 1.5 * whole and not any(stem.startswith(c) for c in chosen):
            chosen.append(stem)
    whole_words = sorted(t[1:] for t in support if t[0] == "w" and not any(t[1:].startswith(c) for c in chosen))
    automaton = build_automaton(whole_words, chosen)

    @F.arrow_udf(ArrayType(DoubleType()))
    def features(texts: pa.Array) -> pa.Array:
        return pa.array(text_features(texts.to_pylist(), automaton).tolist(), pa.list_(pa.float64()))

    rows = sample.select("toxic", features("text").alias("x")).collect()  # sample_rows rows of ten numbers
    return ToxicityModel(automaton, _fit(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows])), whole_words, chosen)


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """The model's score of each whole text, 0 to 1; null is scored like an empty text."""

    @F.arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False))
            cuts = np.searchsorted(sizes, np.arange(1 << 20, sizes[-1] if len(sizes) else 0, 1 << 20), "right")
            edges = sorted({0, *cuts.tolist(), len(batch)})
            parts = [model.scores([t or "" for t in batch.slice(a, b - a).to_pylist()]) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(text)


def score_toxicity(documents: DataFrame, labels: DataFrame, **parameters: float) -> DataFrame:
    """Score every whole text of documents(doc_id, text) by a model learned from labels(doc_id, toxic).

    Every row is returned once. Null and empty texts get the score of a text without hits; a null
    doc_id is not held out and has no label. Other columns, and labels' other columns, are neither
    read nor returned; see learn_toxicity for what is learned and what empty tables give.

    Returns doc_id, held_out, score, predicted (1 if score >= 0.5).
    """
    model = learn_toxicity(documents, labels, **parameters)
    scored = documents.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), toxicity_score(F.col("text"), model).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
