"""Suffix dedup: bytes covered by long strings that start elsewhere too, by prefix doubling over sampled positions.

A suffix array by prefix doubling ranks positions by strings of growing lengths: pairs of the ranks
of a position and of the one that far behind it are sorted and ranked again, and positions leave
once they are unique or their string is past the threshold. Here the positions are sampled first:
in every string of `length` bytes one anchor is chosen from its content alone (its least hashed
32-byte string), so equal strings choose anchors of equal content at equal offsets. Neighbouring
starts that choose one anchor are a run, and runs, a fiftieth of all positions, are doubled over:

1. runs whose anchor is unique hold no repeated string and leave;
2. the others are ranked by their bytes and those of the next run, then by the pairs of ranks of a
   run and of the one 2, 4, 8 ... runs behind it. A run is settled once bytes that hold all its
   strings occur twice;
3. runs at the ends of repeated passages stay open. Blocks of 8 of their strings are ranked by the
   bytes that the eight have in common (unique: none is repeated) and by all their bytes (found
   twice: all are repeated), and what this leaves open string by string.

Names of bytes are 64-bit or 128-bit hashes; nothing is compared pairwise.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, release, spread_join, written
from .textarrays import mixed, powers, slices

SEED_BYTES = 32
BLOCK = 8
#: One value for each byte, so that case counts, and a second, independent set.
_values = np.random.default_rng(5).integers(1, 2**63, (2, 256), dtype=np.uint64)


class Rolling:
    """Hashes of any substrings of some bytes, by two independent polynomials."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.total = []
        for values in _values:
            t = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(values[data] * up[: len(data)], out=t[1:])
            self.total.append(t)

    def of(self, which: int, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        t = self.total[which]
        return mixed(mixed((t[end] - t[start]) * self.down[start]) + np.asarray(salt).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def choose_anchors(data: np.ndarray, offsets: np.ndarray, rolling: Rolling, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor): runs of starts of `length`-byte strings inside a row that choose one anchor, in order.

    The anchor is the place of the least hash among the seed-byte strings inside; the leftmost of equals.
    Hashes are compared by as many bits whatever else is in the slice, so equal strings choose alike anywhere.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    at = np.arange(n - seed + 1)
    low = np.uint64((1 << 32) - 1)  # a text has fewer bytes than 2**31
    value = (rolling.of(0, at, at + seed) & ~low) | at.astype(np.uint64)
    width = length - seed + 1  # a sliding minimum, from minima up to and from the borders of chunks of this width
    chunks = np.concatenate([value, np.full(-len(value) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    upto = np.minimum.accumulate(chunks, axis=1).ravel()
    onward = np.minimum.accumulate(chunks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    anchor = (np.minimum(onward[:starts], upto[width - 1 : width - 1 + starts]) & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:starts]
    inside = np.arange(starts) + length <= offsets[1:][row]
    new = np.ones(starts + 1, bool)
    new[1:-1] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    new[:-1] |= ~inside
    first = np.flatnonzero(inside & new[:-1])
    last = np.flatnonzero(inside & new[1:])
    return first, last, anchor[first]


def pack_span(first: np.ndarray, count: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """start, number of starts and distance from start to anchor in one long; both of the latter are below 2**12."""
    return (first.astype(np.int64) << 24) | ((count.astype(np.int64) - 1) << 12) | lead.astype(np.int64)


def unpack_span(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return span >> 24, ((span >> 12) & 0xFFF) + 1, span & 0xFFF


def covered(first: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of the bytes that strings starting in [first, first + count) cover."""
    if not len(first):
        return first, first
    order = np.argsort(first, kind="stable")
    start, end = first[order], (first + count - 1 + length)[order]
    reach = np.maximum.accumulate(end)
    cut = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return start[cut], np.concatenate((reach[cut[1:] - 1], reach[-1:]))


def _rows(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _run_rows(length: int, seed: int) -> Callable:
    """Runs of starts by anchor: key names the anchor, chunk the bytes from the run's first start to that of the second run behind it, or to the end of the last string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                rolling = Rolling(data)
                first, last, anchor = choose_anchors(data, offsets, rolling, length, seed)
                row = np.searchsorted(offsets, first, "right") - 1
                final = (last + length)[np.searchsorted(row, row, "right") - 1]  # where the last string of the row ends
                follows = np.append(row[2:] == row[:-2], [False, False])[: len(row)] if len(row) > 2 else np.zeros(len(row), bool)
                end = np.where(follows, np.append(first[2:], [0, 0])[: len(row)], final)
                key = rolling.of(0, anchor, anchor + seed)
                chunk = rolling.of(1, first, end, (anchor - first) * 4096 + last - first)
                span = pack_span(first - offsets[row], last - first + 1, anchor - first)
                of = lambda c: rows.column(c).to_numpy()[row]
                yield _rows(["key", "chunk", "id", "h", "span", "size"], key.view(np.int64), chunk.view(np.int64), of("id"), of("h"), span, end - first)

    return run


def _result(text: bytes, first: np.ndarray, count: np.ndarray, length: int) -> tuple[int, int, int, str]:
    start, end = covered(first, count, length)
    kept, at = hashlib.sha256(), 0
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return len(text), int((end - start).sum()), len(start), kept.hexdigest()


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _settle_texts(length: int) -> Callable:
    """Rows whose strings are all settled give their result; the others keep their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
            is_open = []
            for text, settled, asked in zip(*(batch.column(c) for c in ("text", "settled", "asked")), strict=True):
                is_open.append(bool(asked.is_valid and len(asked.values)))
                if is_open[-1]:
                    got = (None,) * 4
                else:
                    spans = np.asarray(settled.values if settled.is_valid else [], np.int64)
                    got = _result((text.as_py() or "").encode(), *unpack_span(spans)[:2], length)
                for n, v in zip(out, got, strict=True):
                    out[n].append(v)
            keep = pa.array(is_open)
            only = lambda c: pc.if_else(keep, batch.column(c), pa.scalar(None, batch.column(c).type))
            yield _rows(
                ["doc_id", "id", "h", "text", "settled", "asked", *out], batch.column("doc_id"), batch.column("id"), batch.column("h"), *map(only, ("text", "settled", "asked")),
                *(pa.array(out[n], pa.int64()) for n in list(out)[:3]), pa.array(out["kept_sha256"], pa.string()),
            )

    return run


def _asked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Rolling, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts with asked anchors: rows, hashes, row of each anchor, its first start, count, anchor, key."""
    for rows, data, offsets in slices(batch, "text"):
        asked = rows.column("asked")
        row = np.repeat(np.arange(len(rows)), asked.value_lengths().to_numpy())
        flat = asked.flatten()
        first, count, lead = unpack_span(flat.field("span").to_numpy())
        first = first + offsets[row]
        yield rows, Rolling(data), offsets, row, first, count, first + lead, flat.field("key").to_numpy().view(np.uint64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within the owner) of counts[k] things for each owner k."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _blocks(first: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor number, block number, first start, last start): starts grouped by their distance to the anchor, BLOCK to a block."""
    far, near = anchor - first, anchor - (first + count - 1)
    owner, k = _spread(far // BLOCK - near // BLOCK + 1)
    block = far[owner] // BLOCK - k
    start = np.maximum(first[owner], anchor[owner] - (block * BLOCK + BLOCK - 1))
    last = np.minimum((first + count - 1)[owner], anchor[owner] - block * BLOCK)
    return owner, block, start, last


def _block_rows(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, rolling, offsets, row, first, count, anchor, key in _asked(batch):
                owner, block, start, last = _blocks(first, count, anchor)
                common = anchor[owner] - block * BLOCK
                salt = key[owner] ^ block.astype(np.uint64)
                core = rolling.of(0, common, common - (BLOCK - 1) + length, salt)
                full = rolling.of(1, start, last + length, (anchor[owner] - start) * 4096 + last - start)
                r = row[owner]
                yield _rows(["core", "full", "id", "h", "start", "count"], core.view(np.int64), full.view(np.int64), rows.column("id").to_numpy()[r],
                            rows.column("h").to_numpy()[r], start - offsets[r], last - start + 1)

    return run


def _string_rows(length: int) -> Callable:
    """Single strings of the blocks named in column starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, rolling, offsets, row, first, count, anchor, key in _asked(batch):
                wanted = rows.column("starts")
                at = wanted.flatten().to_numpy() + offsets[np.repeat(np.arange(len(rows)), wanted.value_lengths().to_numpy())]
                owner, _, start, last = _blocks(first, count, anchor)
                chosen = np.isin(start, at)
                owner, start, last = owner[chosen], start[chosen], last[chosen]
                of, k = _spread(last - start + 1)
                s, a = start[of] + k, anchor[owner[of]]
                r = row[owner[of]]
                one = rolling.of(0, s, s + length, key[owner[of]] ^ (a - s).astype(np.uint64))
                two = rolling.of(1, s, s + length)
                yield _rows(["one", "two", "id", "h", "start"], one.view(np.int64), two.view(np.int64), rows.column("id").to_numpy()[r],
                            rows.column("h").to_numpy()[r], s - offsets[r])

    return run


def _finish_texts(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text, settled, more in zip(*(batch.column(c) for c in ("text", "settled", "more")), strict=True):
                first, count, _ = unpack_span(np.asarray(settled.values if settled.is_valid else [], np.int64))
                if more.is_valid:
                    flat = more.values
                    first = np.concatenate((first, flat.field("start").to_numpy()))
                    count = np.concatenate((count, flat.field("count").to_numpy()))
                got.append(_result((text.as_py() or "").encode(), first, count, length))
            columns = list(zip(*got, strict=True)) or [()] * 4
            yield _rows(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()))

    return run


def _doubled(runs: DataFrame, length: int) -> list[DataFrame]:
    """Written tables that together are runs(id, h, span, size, key, chunk, n_key, weight) with klass: names bytes that occur twice and hold all strings of the run; null where it stays open.

    Runs of one rank have equal bytes, so they need the same length and are settled together. Each
    round takes only runs that are neither settled nor unique; one that is followed by a settled run
    is settled next.
    """
    first, need = F.shiftright("span", 24), F.shiftright("span", 12).bitwiseAND(F.lit(0xFFF)) + length
    klass = lambda level, rank: F.struct(F.lit(level).alias("level"), rank.alias("rank"))
    known = F.col("rank").isNotNull()
    t = runs.withColumn("pair", F.struct(F.col("key").alias("rank"), F.col("chunk").alias("behind"))).drop("chunk")
    # a row that is repeated as a whole is settled from the start
    t = t.withColumn("klass", F.when(F.col("weight") > 1, klass(-1, F.xxhash64("id", "h", "span")))).withColumn("doubles", F.lit(True))
    tables, settled, going = [], [], None
    for level in itertools.count():
        t = written(t, "pairs")
        if going is not None:
            discard(going)
        counted = t.where("doubles").groupBy("pair").agg(F.sum("weight").alias("times"), F.count(F.lit(1)).alias("n")).where("times > 1")
        # in the order of the pairs; ranks of different rounds differ
        ranks = written(counted.sort("pair").select("pair", "n", (F.monotonically_increasing_id() + F.lit(level << 54)).alias("rank")), "ranks")
        ranked = spread_join(t, ranks, "pair", "n", F.struct("id", "span"), "left")
        ranked = ranked.withColumn("klass", F.coalesce("klass", F.when(known & (F.col("size") >= need), klass(level, F.col("rank")))))
        ranked = ranked.withColumn("going", known & (F.col("size") < need))
        now = written(ranked.select("id", "h", "span", "key", "n_key", "weight", "klass", "size", "rank", "going"), "ranked-runs")
        discard(t, ranks)
        tables.append(now)
        settled.append(now.where(known & ~F.col("going")).drop("going"))
        going = written(now.where("going").drop("going"), "unsettled-runs")
        release(t.sparkSession)
        if going.isEmpty():
            return tables
        behind = functools.reduce(DataFrame.union, [*settled, going]).select("id", "h", first.alias("next"), F.col("rank").alias("behind"), F.col("size").alias("more"))
        paired = going.withColumn("next", first + F.col("size")).join(behind, ["id", "h", "next"], "left")
        # pairs of different names keep runs that end here from meeting in one task
        none = F.struct((-1 - F.pmod(F.xxhash64("id", "span"), F.lit(1 << 40))).alias("rank"), F.lit(0).cast("long").alias("behind"))
        follows = F.col("behind").isNotNull()
        t = paired.select(
            "id", "h", "span", "key", "n_key", "weight", "klass", follows.alias("doubles"),
            (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.when(follows, F.struct("rank", "behind")).otherwise(none).alias("pair"),
        )


def remove_repeated_strings(documents: DataFrame, length: int = 200) -> DataFrame:
    """Remove each byte of documents(doc_id, text) covered by a string of `length` bytes that also starts anywhere else.

    Texts are UTF-8 bytes, null is empty; strings lie inside one row and are judged on the input,
    so all of several copies go. Overlapping places of one text count. Texts shorter than length
    stay whole. Repeated rows, also with one doc_id or none, are copies of each other. doc_id is of
    an integer type. Other columns are ignored; an empty table gives an empty result. `length` lies
    between 40 and 4000.

    Counts are combined before they are shuffled, and joins deal the rows of a very common string to
    many tasks.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.
    """
    if not 40 <= length <= 4000:
        raise ValueError("length must be between 40 and 4000")
    seed = min(SEED_BYTES, length // 2)
    docs = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("id"), F.xxhash64(F.lit("row"), "text").alias("h"),
    )
    runs = written(docs.select("id", "h", "text").mapInArrow(_run_rows(length, seed), "key long, chunk long, id long, h long, span long, size long"), "runs")
    keys = written(runs.groupBy("key").agg(F.count(F.lit(1)).alias("n_key")).where("n_key > 1"), "repeated-anchors")
    found = spread_join(runs, keys, "key", "n_key", F.struct("id", "span"), "inner")
    if docs.groupBy("id", "h").count().where("count > 1").isEmpty():
        found = found.withColumn("weight", F.lit(1).cast("long"))
    else:  # one run for all copies of a row
        found = found.groupBy("id", "h", "span", "size", "key", "chunk", "n_key").agg(F.count(F.lit(1)).alias("weight"))
    tables = _doubled(found, length)
    ranked = functools.reduce(DataFrame.union, tables).where("not going").select("id", "h", "span", "key", "n_key", "klass")
    discard(runs, keys)

    # open runs, and one run of each class that may hold strings of theirs, are looked at string by string
    is_open = F.col("klass").isNull()
    open_keys = written(ranked.where(is_open).groupBy("key").agg(F.max("n_key").alias("n_key")), "open-anchors")
    classes = ranked.where(~is_open).groupBy("key", "klass").agg(F.min(F.struct("id", "h", "span")).alias("place"))
    examples = spread_join(classes, open_keys, "key", "n_key", F.col("klass")).select("place.*", "key", F.lit(False).alias("settled"))
    places = ranked.select("id", "h", "span", F.when(is_open, F.col("key")).alias("key"), (~is_open).alias("settled")).union(examples)
    of_text = places.groupBy("id", "h").agg(
        F.collect_list(F.when(F.col("settled"), F.col("span"))).alias("settled"),
        F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "span"))).alias("asked"),
    )
    place_of = "doc_id long, id long, h long, text string, settled array<long>, asked array<struct<key: long, span: long>>, "
    texts = written(
        docs.join(of_text, ["id", "h"], "left").select("doc_id", "id", "h", "text", "settled", "asked").mapInArrow(_settle_texts(length), place_of + RESULT),
        "settled-texts",
    )
    discard(*tables, open_keys)
    release(documents.sparkSession)
    done = texts.where("n_bytes is not null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    open_texts = texts.where("n_bytes is null").select("doc_id", "id", "h", "text", "settled", "asked")

    # rows that are repeated as a whole are settled; one that is an example of a class stands here as often as it is there
    blocks = open_texts.select("id", "h", "text", "asked").mapInArrow(_block_rows(length), "core long, full long, id long, h long, start long, count long")
    place = F.struct("id", "start")  # of one block or string
    shared = written(blocks.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-cores")
    shared_blocks = written(spread_join(blocks, shared, "core", "n", place), "shared-blocks")
    release(documents.sparkSession)
    kinds = written(
        shared_blocks.groupBy("core", "full").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "start")).alias("place")), "block-kinds"
    )
    both = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b")).alias("pair")
    repeated_kinds = kinds.where("n > 1").select(both("core", "full"), "n")
    repeated_blocks = spread_join(shared_blocks.select(both("core", "full"), "id", "h", "start", "count"), repeated_kinds, "pair", "n", place).drop("pair")
    undecided = kinds.where("n = 1").select("core").distinct()
    wanted = kinds.join(undecided, "core", "left_semi").select("place.*").groupBy("id", "h").agg(F.collect_set("start").alias("starts"))
    strings = open_texts.join(wanted, ["id", "h"]).select("id", "h", "text", "asked", "starts").mapInArrow(
        _string_rows(length), "one long, two long, id long, h long, start long"
    )
    strings = written(strings, "strings")
    release(documents.sparkSession)
    named = strings.select(both("one", "two"), "id", "h", "start")
    twice = written(named.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-strings")
    repeated = repeated_blocks.union(spread_join(named, twice, "pair", "n", place).select("id", "h", "start", F.lit(1).cast("long")))
    more = written(repeated.groupBy("id", "h").agg(F.collect_list(F.struct("start", "count")).alias("more")), "repeated")
    release(documents.sparkSession)
    finished = open_texts.join(more, ["id", "h"], "left").select("doc_id", "text", "settled", "more").mapInArrow(
        _finish_texts(length), "doc_id long, " + RESULT
    )
    return done.unionByName(finished)
