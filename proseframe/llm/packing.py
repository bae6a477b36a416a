"""Packing: first-fit decreasing over a tournament tree of bin capacities, in random groups of pieces."""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .textarrays import slices

#: Chunks of text whose ids a worker remembers: this many used lately, and as many used before them.
REMEMBERED = 500_000
#: Plain words that are encoded as one text.
TOGETHER = 2_000
_tokenizers: dict[str, TokenMemory] = {}


class TokenMemory:
    """A tokenizer, and the ids of the chunks that it has lately encoded."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.recent: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def learn(self, chunks: set[str]) -> None:
        """Have the ids of all these chunks in `recent`."""
        if len(self.recent) > REMEMBERED:
            self.recent, self.older = {"": b""}, self.recent
        missing = []
        for c in chunks.difference(self.recent):
            if (ids := self.older.get(c)) is None:
                missing.append(c)
            else:
                self.recent[c] = ids
        # chunks often differ by case or a closing mark alone; the pieces of such a chunk are tokenized apart anyway
        parts = []
        for c in missing:
            tail = c[-1:] if c[-1:] in ",.;:!?" else ""
            word = c[: len(c) - len(tail)]
            if word.isascii():
                parts.append((word.lower(), tail) if word.isalpha() else (c, ""))
            else:  # a mark that comes with a letter would join the closing mark
                parts.append((word, tail) if unicodedata.normalize("NFC", word).lower().isalpha() else (c, ""))
        fresh = {x for pair in parts for x in pair}.difference(self.recent)
        plain = [x for x in fresh if x.isalpha()] if self.ends_word.any() else []
        other = list(fresh.difference(plain))
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            raw, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) == len(some):
                self.recent.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            else:  # some letter becomes several when lower-cased
                other += some
        for x, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False), strict=True):
            self.recent[x] = np.array(e.ids, "<u4").tobytes()
        for c, (word, tail) in zip(missing, parts, strict=True):
            self.recent[c] = self.recent[word] + self.recent[tail]


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit values, without special tokens.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    chunks between blanks and line feeds. Distinct chunks are encoded once and remembered; plain
    words are encoded many at a time and told apart by the tokens that end a word.
    """
    memory = _tokenizers.get(path) or _tokenizers.setdefault(path, TokenMemory(path))
    chunks = [t.replace("\n", " ").split(" ") for t in texts]
    memory.learn(set().union(*chunks))
    return [b"".join(map(memory.recent.__getitem__, c)) for c in chunks]


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Cut each document's ids, with end_id after them, into pieces of at most capacity ids.

    The order is (doc_id, start, length, ids_crc32, doc_tokens). Tokenisation leaves only counts
    and checksums, so ids never move between tasks.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, "text", 4 << 20):
                ids, rows = token_bytes([t or "" for t in part.column("text").to_pylist()], tokenizer_path), []
                for doc_id, x in zip(part.column("doc_id").to_pylist(), ids, strict=True):
                    x += end
                    n = len(x) // 4
                    rows += [(doc_id, s, min(capacity, n - s), zlib.crc32(x[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    )


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Longer pieces go first, each to the first bin with room.

    A complete binary tree holds the most room of any bin below each node; the first bin that fits
    is found from the root downwards. The bins at hand double when all are in use.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    width = 1
    while width * capacity < 2 * int(lengths.sum()) + capacity:
        width *= 2
    room = [capacity] * (2 * width)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if room[1] < need:  # every bin is too full: a second half of empty bins
            grown = [capacity] * (4 * width)
            level = 1
            while level <= width:
                grown[2 * level : 3 * level] = room[level : 2 * level]
                level *= 2
            room, width = grown, 2 * width
            room[1] = max(room[2], room[3])
        node = 1
        while node < width:
            node *= 2
            if room[node] < need:
                node += 1
        bins[i], offsets[i] = node - width, capacity - room[node]
        room[node] -= need
        node //= 2
        while node:
            room[node] = max(room[2 * node], room[2 * node + 1])
            node //= 2
    return bins, offsets


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, group_pieces: int = 8192) -> DataFrame:
    """Pack all documents into sequences of at most capacity tokens.

    A document's ids are the tokenizer's for its whole text (null: none), then end_id; every
    capacity ids one piece is cut, the rest is a shorter one. Pieces are dealt to random groups of
    about group_pieces, so that no group grows with the input whatever ids repeat, and each group
    is packed by first-fit decreasing. sequence_id is group * 2**32 + bin. Repeated rows and null
    doc_ids are packed like any other; an empty table gives no piece. Other columns are ignored. doc_id is an
    integer, or text that is one; other text is an error.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    pieces = written(token_pieces(documents, tokenizer_path, capacity, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # the ids of rows in written files stay the same when a task is run again
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def one_group(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(), capacity)
        return part.drop(columns="group").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return dealt.groupBy("group").applyInPandas(
        one_group, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
