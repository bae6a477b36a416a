"""LM scoring: masked pseudo-likelihood under a bidirectional window network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .textarrays import slices, span_hashes, words

#: Words are runs of ASCII letters and digits and of bytes beyond ASCII.
SEPARATOR = np.array([not (b >= 0x80 or chr(b).isalnum()) for b in range(256)])
CLASSES = 32  # of the two-step softmax; a vocabulary has CLASSES**2 tokens
TOKENS = CLASSES * CLASSES
HASHED = 32  # tokens that stand for all unlisted words, by hash
BANDS = 224  # tokens that stand for listed words of like frequency; the words before them have one token each
LISTED = 1 << 18  # words that every task knows
PAD = TOKENS  # what stands beyond the ends of a text
REACH = 2  # words on each side


@dataclass
class WindowNetwork:
    """p(token | REACH words on both sides): tanh of summed, per-place scaled embeddings, then class and token in class."""

    embed: np.ndarray  # TOKENS + 1, width
    place: np.ndarray  # 2 * REACH, width
    bias: np.ndarray  # width
    to_class: np.ndarray  # width + 1, CLASSES; the last row is a bias
    to_token: np.ndarray  # CLASSES, width + 1, CLASSES

    @classmethod
    def started(cls, width: int, seed: int = 9) -> WindowNetwork:
        r = np.random.default_rng(seed)
        n = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
        return cls(n(TOKENS + 1, width), 1 + n(2 * REACH, width), n(width), n(width + 1, CLASSES), n(CLASSES, width + 1, CLASSES))

    def at_frequencies(self, totals: np.ndarray) -> WindowNetwork:
        """The same embeddings, with outputs that give each token its share of `totals` in every context, unused ones next to none."""
        n = np.maximum(totals.reshape(CLASSES, CLASSES), 1e-300)
        level = lambda x: np.maximum(np.log(x) - np.log(x).max(axis=-1, keepdims=True), -30).astype(np.float32)
        to_class, to_token = np.zeros_like(self.to_class), np.zeros_like(self.to_token)
        to_class[-1], to_token[:, -1] = level(n.sum(axis=1)), level(n)
        return WindowNetwork(self.embed, self.place, self.bias, to_class, to_token)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.__dict__.values()])

    def filled(self, flat: np.ndarray) -> WindowNetwork:
        parts, at = [], 0
        for x in self.__dict__.values():
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return WindowNetwork(*parts)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """Hidden values, with a last column of ones, of contexts (n, 2 * REACH)."""
        total = np.tile(self.bias, (len(context), 1))
        for k in range(2 * REACH):
            total += (self.embed * self.place[k])[context[:, k]]
        return np.hstack([np.tanh(total), np.ones((len(total), 1), np.float32)])

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        h = self.hidden(context)
        klass = target // CLASSES
        out = _log_softmax_at(h @ self.to_class, klass)
        order = np.argsort(klass, kind="stable")
        cuts = np.searchsorted(klass[order], np.arange(CLASSES + 1))
        for c in range(CLASSES):
            rows = order[cuts[c] : cuts[c + 1]]
            if len(rows):
                out[rows] += _log_softmax_at(h[rows] @ self.to_token[c], target[rows] % CLASSES)
        return out

    def train_step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean negative log-probability of the batch."""
        order = np.argsort(target.astype(np.uint16), kind="stable")
        context, target, step = context[order], target[order], np.float32(rate / len(target))
        klass = target // CLASSES
        cuts = np.searchsorted(klass, np.arange(CLASSES + 1))
        seen = self.embed[context]  # n, 2 * REACH, width
        h = np.ones((len(target), len(self.bias) + 1), np.float32)
        np.tanh(np.einsum("nkw,kw->nw", seen, self.place) + self.bias, out=h[:, :-1])
        spans = [(c, slice(cuts[c], cuts[c + 1])) for c in np.unique(klass)]
        g = np.empty((2, len(target), CLASSES), np.float32)
        np.matmul(h, self.to_class, out=g[0])
        for c, rows in spans:
            np.matmul(h[rows], self.to_token[c], out=g[1, rows])
        g = _softmax(g)
        g[0, np.arange(len(target)), klass] -= 1
        g[1, np.arange(len(target)), target % CLASSES] -= 1
        back = g[0] @ self.to_class.T
        self.to_class -= step * (h.T @ g[0])
        for c, rows in spans:
            back[rows] += g[1, rows] @ self.to_token[c].T
            self.to_token[c] -= step * (h[rows].T @ g[1, rows])
        back = back[:, :-1] * (1 - h[:, :-1] ** 2)
        pull = (back[:, None, :] * self.place).reshape(-1, len(self.bias))
        self.bias -= step * back.sum(axis=0)
        self.place -= step * np.einsum("nw,nkw->kw", back, seen)
        order = np.argsort(context.astype(np.uint16), axis=None, kind="stable")
        tokens = context.ravel()[order]
        first = np.flatnonzero(np.diff(tokens, prepend=-1))
        self.embed[tokens[first]] -= step * np.add.reduceat(pull[order], first, axis=0)


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    top = logits.max(axis=1)
    return logits[np.arange(len(at)), at] - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Vocabulary:
    """Words seen at least `least` times, as sorted hashes, with token and log p(word | token) of each; totals count each token."""

    words: np.ndarray
    token_of: np.ndarray
    log_share: np.ndarray
    totals: np.ndarray
    least: int


def word_tokens(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray, token_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of all rows, where each row's begin, hashes, places in the vocabulary or -1). vocabulary: sorted hashes, token_of their tokens."""
    starts, ends, of_row = words(data, offsets, SEPARATOR)
    hashes = span_hashes(data, starts, ends)
    tokens = (TOKENS - HASHED + (hashes >> np.uint64(40)) % np.uint64(HASHED)).astype(np.int64)
    if not len(vocabulary):
        return tokens, of_row, hashes, np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    known = vocabulary[at] == hashes
    return np.where(known, token_of[at], tokens), of_row, hashes, np.where(known, at, -1)


def contexts(tokens: np.ndarray, of_row: np.ndarray) -> np.ndarray:
    """For each token the REACH tokens before and after it in its row, PAD beyond its ends."""
    n, row_start, row_end = len(tokens), np.repeat(of_row[:-1], np.diff(of_row)), np.repeat(of_row[1:], np.diff(of_row))
    out = np.full((n, 2 * REACH), PAD, np.int64)
    here = np.arange(n)
    for k, move in enumerate([m for m in range(-REACH, REACH + 1) if m]):
        inside = (here + move >= row_start) & (here + move < row_end)
        out[inside, k] = tokens[here[inside] + move]
    return out


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over whole texts, words as 64-bit hashes; each batch is counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [span_hashes(data, *words(data, offsets, SEPARATOR)[:2]) for _, data, offsets in slices(batch, "text")]
            word, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return documents.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def hash_token(word: Column) -> Column:
    """Which of the HASHED tokens an unlisted word has, counted from 0."""
    return (F.shiftrightunsigned(word, 40) % HASHED).cast("int")


def list_words(counts: DataFrame, listed: int) -> Vocabulary:
    """List the words of counts(word, n) that are seen at least `least` times, the smallest number that at most `listed` words reach.

    The most frequent words have a token each, the other listed ones share BANDS tokens of about
    equal mass by falling frequency, and unlisted ones HASHED tokens.
    """
    levels = sorted(((r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)  # as many rows as there are different counts
    reach = np.cumsum([0] + [k for _, k in levels])
    fit = int(np.searchsorted(reach, listed, "right")) - 1
    least = levels[fit - 1][0] if fit else levels[0][0] + 1 if levels else 1
    known = counts.where(F.col("n") >= least).toArrow()  # at most `listed` rows
    hashes, n = known["word"].to_numpy().view(np.uint64), known["n"].to_numpy().astype(np.float64)
    order = np.lexsort((hashes, -n))
    hashes, n = hashes[order], n[order]
    token = np.arange(len(n))
    own = TOKENS - HASHED - BANDS
    before = np.cumsum(n[own:]) - n[own:]
    token[own:] = own + np.minimum(before * BANDS // max(n[own:].sum(), 1), BANDS - 1)
    totals = np.bincount(token, n, TOKENS)
    for r in counts.where(F.col("n") < least).groupBy(hash_token(F.col("word")).alias("bucket")).agg(F.sum("n").alias("n")).collect():  # HASHED rows
        totals[TOKENS - HASHED + r["bucket"]] = r["n"]
    share = np.log(n / totals[token])
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], token[order], share[order], totals, least)


def train(documents: DataFrame, vocabulary: np.ndarray, token_of: np.ndarray, totals: np.ndarray, width: int, one_in: int, shard_documents: int, rounds: int) -> WindowNetwork:
    """Train on every one_in-th document by hash: the shards of a round start from the same weights, which are then averaged.

    The number of shards follows the documents, with one for each round at least. Each round takes
    other shards, so all rounds together are one pass over the documents, at every size. Rows are dealt
    one by one, so copies of a text are in many shards. Averages are taken in two steps, so no task
    holds more weights than about the root of the number of shards.
    """
    sample = documents.select(F.xxhash64("doc_id", "text").alias("key"), F.monotonically_increasing_id().alias("row"), "text").where(F.col("text").isNotNull() & (F.pmod("key", F.lit(one_in)) == 0))
    shards = max(rounds, -(-sample.count() // shard_documents))
    across = max(1, round(shards**0.5))
    network = WindowNetwork.started(width).at_frequencies(totals)
    for turn in range(rounds):
        flat, rate = network.flat(), 2.0 / (1 + turn)

        def one_shard(part: pd.DataFrame) -> pd.DataFrame:  # pickled within this very turn
            mine = WindowNetwork.started(width).filled(flat)
            part = part.sort_values("key")
            batch = pa.RecordBatch.from_pydict({"text": pa.array(part["text"].tolist(), pa.large_string())})
            seen = 0
            for _, data, offsets in slices(batch, "text"):
                tokens, of_row, *_ = word_tokens(data, offsets, vocabulary, token_of)
                around = contexts(tokens, of_row)
                order = np.random.default_rng(len(tokens)).permutation(len(tokens))
                for at in range(0, len(tokens), 512):
                    rows = order[at : at + 512]
                    mine.train_step(around[rows], tokens[rows], rate * len(rows) / 512)  # a short last batch counts less
                seen += len(tokens)
            return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "seen": [float(seen)], "weights": [mine.flat().astype("<f4").tobytes()]})

        def averaged(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("shard")
            share = part["seen"].to_numpy()
            weights = sum(np.frombuffer(w, "<f4") * s for w, s in zip(part["weights"], share, strict=True)) / max(share.sum(), 1)
            return pd.DataFrame({"shard": [int(part["shard"].iloc[0])], "seen": [share.sum()], "weights": [weights.astype("<f4").tobytes()]})

        kind = "shard long, seen double, weights binary"
        dealt = sample.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).where(F.col("shard") % rounds == turn)
        trained = dealt.groupBy("shard").applyInPandas(one_shard, kind)
        for key in (F.pmod("shard", F.lit(across)), F.lit(0)):
            trained = trained.groupBy(key.alias("part")).applyInPandas(averaged, kind)
        found = trained.first()  # one row of weights
        if found and found["seen"]:
            network = network.filled(np.frombuffer(found["weights"], "<f4"))
    return network


def score_documents(documents: DataFrame, vocabulary: np.ndarray, token_of: np.ndarray, network: WindowNetwork, log_share: np.ndarray | None = None) -> DataFrame:
    """row, doc_id, n_tokens, log_likelihood, unlisted of each row.

    The likelihood is the sum of log p(token | both sides) over the whole text, with the log_share of
    each listed word; `unlisted` has the hashes of the words whose share is still to be added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                tokens, of_row, hashes, place = word_tokens(data, offsets, vocabulary, token_of)
                around, total = contexts(tokens, of_row), np.zeros(len(tokens) + 1)
                for at in range(0, len(tokens), 1 << 14):
                    to = slice(at, at + (1 << 14))
                    total[1:][to] = network.log_probabilities(around[to], tokens[to])
                if log_share is not None and len(log_share):
                    total[1:] += np.where(place >= 0, log_share[place], 0)
                total = np.cumsum(total)
                rest = np.concatenate(([0], np.cumsum(place < 0)))[of_row]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("row"), rows.column("doc_id"), pa.array(np.diff(of_row).astype(np.int64)), pa.array(total[of_row[1:]] - total[of_row[:-1]]),
                        pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.array(hashes[place < 0].view(np.int64))),
                    ],
                    ["row", "doc_id", "n_tokens", "log_likelihood", "unlisted"],
                )

    kind = "row long, doc_id long, n_tokens long, log_likelihood double, unlisted array<long>"
    return documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)


def pseudo_likelihood(
    documents: DataFrame, width: int = 16, one_in: int = 1, shard_documents: int = 500, rounds: int = 2, listed: int = LISTED
) -> DataFrame:
    """Score every whole text of documents(doc_id, text) by its masked pseudo-log-likelihood.

    p(word | both sides) = p(token | tokens on both sides) * p(word | token). The network gives the
    first factor; the second is the word's share of its token's occurrences in all documents, so
    every distinct word has a probability of its own. Shares of the at most `listed` most frequent
    words are known to every task, those of all others are joined from the counts; see list_words.
    The network is trained on every document (one in one_in, for other values), see train. Null and
    empty texts and those without words have no tokens and a likelihood of 0. Repeated rows are scored each,
    null ids too; other columns are ignored; empty tables give nothing. doc_id is an
    integer, or text that is one; other text is an error.

    Returns doc_id, n_tokens, log_likelihood, mean_log_likelihood (null without tokens).
    """
    counts = written(word_counts(documents), "lm-words")
    v = list_words(counts, listed)
    network = train(documents, v.words, v.token_of, v.totals, width, one_in, shard_documents, rounds)
    scored = written(score_documents(documents, v.words, v.token_of, network, v.log_share), "lm-scored")
    totals = F.array(*(F.lit(float(n)) for n in v.totals[TOKENS - HASHED :]))
    shares = counts.where(F.col("n") < v.least).select("word", F.log(F.col("n") / F.get(totals, hash_token(F.col("word")))).alias("share"))
    rest = scored.select("row", F.explode("unlisted").alias("word")).join(shares, "word").groupBy("row").agg(F.sum("share").alias("rest"))
    whole = scored.join(rest, "row", "left").select("doc_id", "n_tokens", (F.col("log_likelihood") + F.coalesce("rest", F.lit(0.0))).alias("log_likelihood"))
    return whole.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
