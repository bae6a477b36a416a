"""Phrase collocation mining: levels of frequent phrases, found by double-array tries over all text positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, written
from .textarrays import slices, words

#: The characters that end a piece and those between words, fixed by the contract.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_ENDS = np.isin(np.arange(256), list(PIECE_ENDS))
_SEPARATOR = _ENDS | np.isin(np.arange(256), list(BLANKS))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text and symbols that are worked on at once, and rows of counts that a task holds before it sends them on.
BYTES, SYMBOLS, HELD = 2 << 20, 1 << 18, 1 << 20
#: Parts in which a language's phrases are ranked before their best are ranked together.
RANK_PARTS = 16


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """(words with A-Z lower-cased, the row of each, whether a piece begins with it)."""
    starts, ends, _ = words(data, offsets, _SEPARATOR)
    packed = _LOWER[data[~_SEPARATOR[data]]]
    bounds = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=bounds[1:])
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(packed))
    row = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(_ENDS[data], dtype=np.int32)[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    return found, row, first


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a task's texts; a word comes again only where there are more than HELD others between."""
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        whole = pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("n", "sum")])
        return whole.rename_columns({"n_sum": "n"}).select(["lang", "word", "n"])

    for batch in batches:
        for part, data, offsets in slices(batch, "text", BYTES):
            found, row, _ = tokens(data, offsets)
            langs = part.column("lang").dictionary_encode()
            lang = pa.array(langs.indices.to_numpy(zero_copy_only=False)[row].astype(np.int32))
            counts = pa.table({"at": lang, "word": found}).group_by(["at", "word"]).aggregate([([], "count_all")])
            named = pc.take(langs.dictionary, counts["at"]).cast(pa.string())
            held.append(pa.table({"lang": named, "word": counts["word"], "n": counts["count_all"]}))
            if sum(x.num_rows for x in held) > 2 * HELD:
                held = [summed()]
                if held[0].num_rows > HELD:
                    yield from held.pop().to_batches()
    if held:
        yield from summed().to_batches()
        held.clear()
    _release()


def _release() -> None:
    """Give back what Arrow keeps for later: the worker lives on, beside others, for the stages that follow."""
    pa.default_memory_pool().release_unused()


class Vocabulary:
    """The frequent words of all languages, numbered; the number after them stands for any other word and for the end of a piece."""

    def __init__(self, words: pa.StringArray):
        self.words = words

    def encoded(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, symbols) of each text: the numbers of its words as 32-bit integers, one that no word has before each piece."""
        n = len(self.words)
        for batch in batches:
            for part, data, offsets in slices(batch, "text", BYTES):
                found, row, first = tokens(data, offsets)
                symbols = pc.fill_null(pc.index_in(found, value_set=self.words), n).to_numpy(zero_copy_only=False)
                flat = np.full(len(symbols) + int(first.sum()), n, np.int32)
                flat[np.arange(len(symbols)) + np.cumsum(first)] = symbols
                ends = np.zeros(len(part) + 1, np.int64)
                np.cumsum(np.bincount(row, minlength=len(part)) + np.bincount(row[first], minlength=len(part)), out=ends[1:])
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(4 * ends), pa.py_buffer(flat)])
                yield pa.record_batch({"lang": part.column("lang").cast(pa.string()), "symbols": held.cast(pa.binary())})
        _release()


def _sequences(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(langs, symbols, number of symbols of each row) of parts of a batch of encoded texts, with about SYMBOLS symbols each."""
    held = batch.column("symbols").cast(pa.large_binary())
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1] // 4
    data = np.frombuffer(held.buffers()[2], np.int32) if held.buffers()[2] is not None else np.zeros(0, np.int32)
    at = 0
    while at < len(held):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SYMBOLS, "right")) - 1)
        yield batch.column("lang").slice(at, to - at), data[ends[at] : ends[to]], np.diff(ends[at : to + 1])
        at = to


class Trie:
    """A double array over sequences of symbols: the child of state s by digit x is base[s] + x if check there is s.

    Symbols 0 to n_words - 1 are words, n_words stands for any other word or the end of a piece and
    leads nowhere, those above are languages, the first symbol of each sequence. A symbol is two digits, its
    upper and its lower bits, so the children of a state lie close together however many words there are.
    State 0 is dead, state 1 the root.
    """

    def __init__(self, sequences: np.ndarray, n_words: int, n_langs: int):
        """sequences: distinct rows of symbols, all of one length."""
        self.n_words = n_words
        self.bits = ((n_words + n_langs).bit_length() + 1) // 2
        self.base, self.check = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self._taken, self._high, self._random = 2, 2, np.random.default_rng(0)
        self._grow()
        self.check[:2] = -2, np.iinfo(np.int32).max  # no state's children, and not free
        order = np.lexsort(sequences.T[::-1])
        rows = sequences[order].astype(np.int64)
        state = np.ones(len(rows), np.int64)
        for symbols in rows.T:
            for digit in (symbols >> self.bits, symbols & ((1 << self.bits) - 1)):
                # sorted rows hold the children of a state side by side
                first = np.ones(len(rows), bool)
                first[1:] = (state[1:] != state[:-1]) | (digit[1:] != digit[:-1])
                self._place(state[first], digit[first])
                state = self.base[state] + digit
        self.final = np.empty(len(rows), np.int64)
        self.final[order] = state

    def _grow(self) -> None:
        """Room for bases below _high."""
        more = max(0, self._high + (2 << self.bits) - len(self.check))
        self.base = np.concatenate((self.base, np.zeros(more, np.int32)))
        self.check = np.concatenate((self.check, np.full(more, -1, np.int32)))

    def _place(self, parents: np.ndarray, digits: np.ndarray) -> None:
        """Find a base for each parent, with its children side by side, and take their places; the largest come first.

        A parent with a good share of all digits gets a range of its own. The others try random bases, all of about
        one size at once, in an array so large that each try has a fair chance.
        """
        begin = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        size = np.diff(np.append(begin, len(parents)))
        wide = np.flatnonzero(size << 4 > 1 << self.bits)
        self._taken += len(parents)
        # what has a base below _high may reach one range further
        bases = self._high + ((np.arange(len(wide)) + 1) << self.bits)
        self._high += len(wide) << self.bits
        self._grow()
        self._take(parents, digits, begin, size, wide, bases)
        band = np.frexp(size)[1]
        band[wide] = 0
        for k in sorted(set(band.tolist()) - {0}, reverse=True):
            self._high = max(self._high, self._taken << max(1, k - 2))
            self._grow()
            left, tries = np.flatnonzero(band == k), 0
            while len(left):
                bases, n = self._random.integers(2, self._high, len(left)), size[left]
                starts = np.cumsum(n) - n
                of = np.repeat(np.arange(len(left)), n)
                slots = bases[of] + digits[begin[left][of] + np.arange(len(of)) - starts[of]]
                claimed = np.full(len(self.check), -1, np.int32)
                claimed[slots] = of
                fits = np.logical_and.reduceat((self.check[slots] == -1) & (claimed[slots] == of), starts)
                self._take(parents, digits, begin, size, left[fits], bases[fits])
                left, tries = left[~fits], tries + 1
                if tries % 32 == 0:
                    self._high *= 2
                    self._grow()

    def _take(self, parents: np.ndarray, digits: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray, bases: np.ndarray) -> None:
        n = size[which]
        of = np.repeat(np.arange(len(which)), n)
        at = begin[which][of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
        self.base[parents[begin[which]]] = bases
        self.check[bases[of] + digits[at]] = parents[at]

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is none."""
        for digit in (symbols >> self.bits, symbols & ((1 << self.bits) - 1)):
            to = self.base[states] + digit
            states = np.where(self.check[to] == states, to, 0)
        return states


class Shard:
    """A trie of frequent phrases, and which candidates one word longer they make.

    A candidate is a phrase of `left` followed at the next position by one of `right`: both its
    longest parts are frequent, so it is safe by the Apriori rule, and its accepting state is the
    pair of theirs. So no candidate has to be listed before the texts show that it occurs.
    """

    def __init__(self, left: pa.Table, right: pa.Table, words: pa.StringArray):
        """left, right: (lang, phrase); words: the vocabulary by which the texts are encoded."""
        both = pa.concat_tables([left, right])
        cut = pc.split_pattern(both["phrase"].combine_chunks(), " ")
        symbols = pc.index_in(cut.flatten(), value_set=words).to_numpy().reshape(both.num_rows, -1)
        self.langs = pc.unique(both["lang"])
        langs = pc.index_in(both["lang"].combine_chunks(), value_set=self.langs).to_numpy() + len(words) + 1
        rows = np.column_stack((langs, symbols))
        order = np.lexsort(rows.T[::-1])
        new = np.append(True, (rows[order[1:]] != rows[order[:-1]]).any(axis=1))
        self.trie, self.depth, self.n_right = Trie(rows[order[new]], len(words), len(self.langs)), symbols.shape[1], right.num_rows
        final = np.empty(len(rows), np.int64)
        final[order] = self.trie.final[np.cumsum(new) - 1]
        self.of_left, self.of_right = (np.full(len(self.trie.base), -1, np.int32) for _ in range(2))
        self.of_left[final[: left.num_rows]] = np.arange(left.num_rows)
        self.of_right[final[left.num_rows :]] = np.arange(right.num_rows)
        self.starts = np.append(self.trie.step(np.ones(len(self.langs), np.int64), len(words) + 1 + np.arange(len(self.langs))), 0).astype(np.int32)

    def candidates(self, langs: pa.Array, symbols: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The candidates that stand at any position, as left * n_right + right."""
        flat = np.append(symbols, np.full(self.depth + 1, self.trie.n_words, np.int32))
        lang = pc.fill_null(pc.index_in(langs, value_set=self.langs), len(self.langs)).to_numpy(zero_copy_only=False)
        state = np.repeat(self.starts[lang], n)
        at = np.flatnonzero((symbols != self.trie.n_words) & (state > 0)).astype(np.int32)
        state = state[at]
        for level in range(self.depth):
            state = self.trie.step(state, flat[at + level])
            at, state = at[state > 0], state[state > 0]
        right = np.full(len(flat), -1, np.int32)
        right[at] = self.of_right[state]
        left, right = self.of_left[state], right[at + 1]
        both = (left >= 0) & (right >= 0)
        return left[both].astype(np.int64) * self.n_right + right[both]


def _tally(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


def _counted(texts: DataFrame, left: pa.Table, right: pa.Table, words: pa.StringArray, min_count: int) -> DataFrame:
    """(lang, phrase, a) of the candidates of left and right that stand at least min_count times in the encoded texts."""
    send = texts.sparkSession.sparkContext.broadcast
    sent, n_right = send(Shard(left, right, words)), right.num_rows
    last = pc.replace_substring_regex(right["phrase"].combine_chunks(), "^.* ", "")
    names = send((left["lang"].combine_chunks(), left["phrase"].combine_chunks(), last))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, codes, counts = sent.value, [], []
        for batch in batches:
            for part in _sequences(batch):
                found, n = np.unique(shard.candidates(*part), return_counts=True)
                codes, counts = [*codes, found], [*counts, n]
                if sum(map(len, codes)) > 2 * HELD:
                    codes, counts = ([x] for x in _tally(codes, counts))
                    if len(codes[0]) > HELD:
                        yield pa.record_batch({"code": codes.pop(), "n": counts.pop()})
        if codes:
            codes, counts = _tally(codes, counts)
            yield pa.record_batch({"code": codes, "n": counts})
        _release()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, phrase, last = names.value
        for batch in batches:
            a, b = np.divmod(batch.column("code").to_numpy(), n_right)
            yield pa.record_batch({"lang": lang.take(pa.array(a)), "phrase": pc.binary_join_element_wise(phrase.take(pa.array(a)), last.take(pa.array(b)), " "), "a": batch.column("a")})

    sums = texts.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
    return sums.mapInArrow(named, "lang string, phrase string, a long")


def _longer(texts: DataFrame, frequent: DataFrame, words: pa.StringArray, min_count: int, shard_phrases: int) -> DataFrame:
    """Frequent phrases one word longer than the given ones; a pass over the encoded texts for each shard of about shard_phrases of these."""
    n = frequent.count()
    if not n:
        return frequent
    parts = -(-n // shard_phrases)
    cut = F.split("phrase", " ")
    # what a candidate's two longest parts have in common names the part in which they meet
    shared = {"left": F.array_join(F.slice(cut, 2, F.size(cut)), " "), "right": F.array_join(F.slice(cut, 1, F.size(cut) - 1), " ")}
    sides = {k: frequent.select("lang", "phrase", F.pmod(F.xxhash64("lang", x), F.lit(parts)).alias("part"), F.xxhash64("phrase").alias("h")) for k, x in shared.items()}
    blocks = {k: {r["part"]: -(-r["count"] // shard_phrases) for r in x.groupBy("part").count().collect()} for k, x in sides.items()}

    def chosen(side: str, part: int, block: int) -> pa.Table:
        return sides[side].where((F.col("part") == part) & (F.pmod("h", F.lit(blocks[side][part])) == block)).select("lang", "phrase").toArrow()

    found = []
    for part in sorted(blocks["left"].keys() & blocks["right"].keys()):
        for i in range(blocks["left"][part]):
            left = chosen("left", part, i)
            for j in range(blocks["right"][part]):
                right = chosen("right", part, j)
                if left.num_rows and right.num_rows:
                    found.append(written(_counted(texts, left, right, words, min_count), "phrases"))
    if not found:
        return frequent.where(F.lit(False))
    whole = found[0]
    for x in found[1:]:
        whole = whole.unionAll(x)
    return whole


def mine_phrases(documents: DataFrame, min_count: int = 100, most_words: int = 5, top: int = 2000, shard_phrases: int = 1 << 18) -> DataFrame:
    """The collocations of documents(text, lang), for each lang (null: `und`) its `top` best by score.

    Texts (null: empty) have A-Z lower-cased and are cut into pieces at PIECE_ENDS and those into
    words at BLANKS. f(phrase) counts all occurrences within pieces, n all words of the lang.
    Candidates are phrases of 2 to most_words words with a = f(phrase) >= min_count. A cut into two
    parts with l and r occurrences scores floor(1000 * a * n / (l * r)); the cut with the lowest score
    counts, of equal ones the first. A candidate inside a longer one that is as frequent is dropped.
    Repeated rows count each time; further columns are ignored; an empty table gives nothing.

    Words are counted once, and the frequent ones numbered, so that the texts are cut into words and
    looked up only once more: a table of numbers stands for them from then on. The list of frequent
    words is broadcast whole; a word in it stands min_count times in the texts. Then each level extends
    the frequent phrases of the last by a word. They are broadcast as double-array tries of about
    shard_phrases phrases a side, whatever their number; all positions of a slice of text walk a trie
    at once, one level a step, and the pairs of accepting states at neighbouring places are counted for
    each task and summed. If there are more phrases than a trie takes, there are more tries and a pass
    over the numbers for each. Strings are compared, not hashes.

    Returns lang, rank (from 1), phrase, a, l, r, n, score.
    """
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    partial = texts.mapInArrow(count_words, "lang string, word string, n long")
    counts = written(partial.groupBy("lang", "word").agg(F.sum("n").alias("a")), "word-counts")
    totals = written(counts.groupBy("lang").agg(F.sum("a").alias("n")), "word-totals")
    levels = [written(counts.where(F.col("a") >= min_count).select("lang", F.col("word").alias("phrase"), "a"), "phrases")]
    discard(counts)
    words = levels[0].select("phrase").distinct().toArrow()["phrase"].combine_chunks().cast(pa.string())
    if len(words):
        sent = documents.sparkSession.sparkContext.broadcast(Vocabulary(words))
        numbered = written(texts.mapInArrow(lambda batches: sent.value.encoded(batches), "lang string, symbols binary"), "phrase-symbols")
        for _ in range(2, most_words + 1):
            levels.append(_longer(numbered, levels[-1], words, min_count, shard_phrases))
        discard(numbered)
    known, found = levels[0], levels[0].where(F.lit(False))
    for level in levels[1:]:
        known, found = known.unionAll(level), found.unionAll(level)
    found = found.withColumn("words", F.split("phrase", " ")).withColumn("m", F.size("words"))

    part = lambda at, n: F.array_join(F.slice("words", at, n), " ")
    cuts = found.select("lang", "phrase", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("m")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(totals, "lang")
    wide = {c: f"cast({c} as decimal(19, 0))" for c in "anlr"}
    score = F.expr(f"(1000 * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("m") - n + 1), lambda at: part(at, n))))
    longer = found.where(F.col("m") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    rows = kept.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    first = first.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
