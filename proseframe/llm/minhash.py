"""MinHash near-dedup: banded candidates, checked by odd sketches and then on the full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, spread_join, written
from .components import connected_components
from .textarrays import mixed, slices, span_hashes, words

#: What separates words: [\x20\x09-\x0D].
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

BANDS, BAND_ROWS = 32, 4
SAMPLES = 256  # of which the first BANDS * BAND_ROWS make the bands, and all the sketch
SKETCH_WORDS = 8  # of 64 bits, of the samples
WHOLE_WORDS = 16  # of 64 bits, of the whole set
#: Members of a bucket's main component that each other member is tried against in a round, and how many of all these in full.
PIVOTS, TRIED, ROUNDS = 2, 4, 1
#: Nodes of a bucket that one task tries in the last round.
PART_NODES = 512
_seeded = np.random.default_rng(8)
_FLIP = _seeded.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_TIMES = _seeded.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each row. Rows with fewer words have their whole sequence as one."""
    starts, ends, of_row = words(data, offsets, SEPARATOR)
    hashes = span_hashes(data, starts, ends)
    times = np.uint64(0xD6E8FEB86659FD93)
    run = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        run = run * times + hashes[k : k + len(run)]
    run = mixed(run)
    out = []
    for a, b in zip(of_row[:-1].tolist(), of_row[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(run[a : b - size + 1]))
        else:
            one = np.uint64(0)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    one = one * times + h
            out.append(mixed(np.array([one + np.uint64(b - a)], np.uint64)) if b > a else np.zeros(0, np.uint64))
    return out


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band keys, odd sketches of the samples, odd sketches of the whole sets) of non-empty sets."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    least = np.empty((len(sets), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        least[:, k] = np.minimum.reduceat((flat ^ _FLIP[k]) * _TIMES[k], at)
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for j in range(BAND_ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, j : BANDS * BAND_ROWS : BAND_ROWS] + np.arange(BANDS, dtype=np.uint64) * np.uint64(1 << 33))
    # each sample (function, minimum) turns over one bit
    samples = mixed(least + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)))
    bits = (samples % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
    odd = np.zeros((len(sets), 64 * SKETCH_WORDS), np.uint8)
    np.add.at(odd, (np.arange(len(sets))[:, None], bits), 1)
    # and so does each shingle in a second bitmap
    whole = np.zeros((len(sets), 64 * WHOLE_WORDS), np.uint8)
    flat = np.concatenate(sets)
    np.add.at(whole, (np.repeat(np.arange(len(sets)), [len(s) for s in sets]), (mixed(flat) % np.uint64(64 * WHOLE_WORDS)).astype(np.int64)), 1)
    packed = lambda bits: np.packbits(bits & 1, axis=1, bitorder="little").view(np.int64)
    return keys.view(np.int64), packed(odd), packed(whole)


def sketches(documents: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, keys, sketch, whole) of each row; set_a and set_b name its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                sets = shingle_sets(data, offsets, shingle_words)
                full = [k for k, s in enumerate(sets) if len(s)]
                keys, odd, whole = ([None] * len(sets) for _ in range(3))
                if full:
                    for k, *found in zip(full, *_signatures([sets[k] for k in full]), strict=True):
                        keys[k], odd[k], whole[k] = found
                names = [[int(mixed(s + np.uint64(seed)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for seed in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(n, pa.int64()) for n in names),
                     *(pa.array(x, pa.list_(pa.int64())) for x in (keys, odd, whole))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "keys", "sketch", "whole"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, sketch array<long>, whole array<long>"
    )


def full_sets(documents: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles array<long>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                sets = shingle_sets(data, offsets, shingle_words)
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("node"), pa.LargeListArray.from_arrays(ends, flat).cast(pa.list_(pa.int64()))], ["node", "shingles"]
                )

    return documents.mapInArrow(run, "node long, shingles array<long>")


def _distance(kind: str, a: str, b: str, longs: int) -> Column:
    """Bits in which two sketches differ; each of their longs is a column of its own, which joins test fastest."""
    return sum((F.bit_count(F.col(f"{kind}{k}_{a}").bitwiseXOR(F.col(f"{kind}{k}_{b}"))) for k in range(longs)), F.lit(0))


def _allowed(percent: int, a: str, b: str) -> Column:
    """Sizes and whole-set sketches of two nodes allow the threshold.

    A bit in which the sketches differ takes a shingle in one set only, so the distance never
    exceeds the symmetric difference, which at a similarity of t is (1 - t) / (1 + t) of both sizes
    together. This rules out nothing that reaches the threshold, but tells little of large sets.
    There the odd sketches of samples estimate the similarity; see sample_limit for the margin.
    """
    sizes = 100 * F.least(f"n_{a}", f"n_{b}") >= percent * F.greatest(f"n_{a}", f"n_{b}")
    whole = (100 + percent) * _distance("whole", a, b, WHOLE_WORDS) <= (100 - percent) * (F.col(f"n_{a}") + F.col(f"n_{b}"))
    return sizes & whole & (_distance("sketch", a, b, SKETCH_WORDS) <= sample_limit(percent))


def estimated_similarity(distance: int) -> float:
    """The similarity of two sets whose odd sketches of samples differ in this many bits."""
    n = 64 * SKETCH_WORDS
    return 1 + n / (4 * SAMPLES) * np.log(max(1 - 2 * distance / n, 1e-9))


def sample_limit(percent: int, sigmas: float = 7) -> int:
    """The most bits in which odd sketches of samples differ where sets reach the threshold, `sigmas` standard deviations above the mean.

    At a similarity of t, (1 - t) of the samples differ, with a binomial spread; each of them turns
    over two of n bits, and m turned bits leave n / 2 (1 - exp(-2 m / n)) of them odd. At seven
    deviations a pair at the threshold is ruled out with a probability below 1e-11, which the bands,
    at 5e-8, exceed by far.
    """
    n, apart = 64 * SKETCH_WORDS, 1 - percent / 100
    turned = np.exp(-4 * SAMPLES * apart / n)
    spread = np.hypot(2 * np.sqrt(SAMPLES * apart * (1 - apart)) * turned, np.sqrt(n * (1 - turned**2)) / 2)
    return int(np.ceil(n / 2 * (1 - turned) + sigmas * spread))


def _named(nodes: DataFrame, name: str) -> DataFrame:
    """The nodes with all columns marked by a name."""
    kinds = [("whole", WHOLE_WORDS), ("sketch", SKETCH_WORDS)]
    parts = [F.get(kind, k).alias(f"{kind}{k}_{name}") for kind, n in kinds for k in range(n)]
    return nodes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"), *parts)


def _best(pairs: DataFrame, nodes: DataFrame, percent: int, most: int) -> DataFrame:
    """Of pairs(a, b), for each b the `most` ones with the nearest sketches of samples, so the most alike, that the threshold allows."""
    counts = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n_pairs")), "pair-counts")
    near = spread_join(pairs, _named(nodes, "a").join(counts, "a"), "a", "n_pairs", F.col("b"), "inner", counts.agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).first()[0])
    near = near.join(_named(nodes, "b"), "b").where(_allowed(percent, "a", "b"))
    near = near.select("a", "b", _distance("sketch", "a", "b", SKETCH_WORDS).alias("distance"))
    ranked = near.groupBy("b").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "a"))), 1, most).alias("nearest"))
    return ranked.select(F.explode("nearest.a").alias("a"), "b")


def _sets_of(nodes: DataFrame, documents: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles) of the documents whose ids are nodes(node)."""
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    return written(full_sets(texts, shingle_words), "full-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs(a, b) whose full sets reach the threshold.

    A node has at most TRIED pairs as b, so sets move about as often; one that is a of very many
    meets them in several tasks.
    """
    counts = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n_pairs")), "pair-counts")
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).join(counts, "a")
    total = counts.agg(F.coalesce(F.sum("n_pairs"), F.lit(0))).first()[0]
    both = (
        spread_join(pairs, first, "a", "n_pairs", F.col("b"), "inner", total)
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .withColumn("shared", F.size(F.array_intersect("x", "y")))
    )
    return both.where(100 * F.col("shared") >= percent * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b")


def near_duplicates(documents: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents(doc_id, text) whose word shingle sets have a Jaccard similarity of percent or more.

    Words are runs outside [\\x20\\x09-\\x0D] with A-Z lower-cased. A text of fewer words than
    shingle_words has its whole sequence as one shingle; a text without words, and a null text or
    doc_id, is linked with nothing. Rows with one doc_id count as one document. Every row is
    returned; other columns are ignored; empty tables give an empty result. doc_id is an
    integer, or text that is one; other text is an error.

    Equal sets are one node, so copies cost nothing. Nodes meet in buckets of 32 bands of 4 minima
    (a pair at 0.8 is missed by all bands with probability 5e-8). Odd sketches of 256 minima estimate
    the similarity of partners in a bucket: they name the most alike and, with those of whole sets,
    rule out what cannot reach the threshold; full sets decide. First every node is tried against the nearest few of its buckets' smallest nodes. While
    buckets hold several components, the nodes outside a bucket's main one are tried against the
    nearest of some random members of it; that joins large groups without expanding their pairs.
    Nodes that stay apart are at last tried against all members of other components in their
    buckets that the sketches allow, so no link between components is lost that a band holds.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id is that
    smallest; true for null ids).
    """
    rows = written(sketches(documents, shingle_words), "sketches")
    usable = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = written(usable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "classes")
    nodes = (
        usable.join(classes.select("node", "set_a", "set_b"), ["set_a", "set_b"])
        .where(F.col("doc_id") == F.col("node"))
        .select("node", "n_shingles", "keys", "sketch", "whole")
    )
    nodes = written(nodes, "nodes")
    members = nodes.select("node", F.explode("keys").alias("bucket"))
    shared = written(
        members.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "buckets"
    )
    members = written(spread_join(members, shared, "bucket", "n", F.col("node"), "inner").drop("n"), "members")
    stars = members.where(F.col("node") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    first = written(_best(stars, nodes, percent, TRIED), "first-pairs")
    needed = written(first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
    links = written(_confirmed(first, _sets_of(needed, documents, shingle_words), percent), "links")
    release(documents.sparkSession)

    sets, apart = None, None
    for turn in range(ROUNDS + 1):
        placed = members.join(connected_components(links), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
        placed = written(placed, "placed")
        by_root = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
        main = by_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).where(F.col("roots") > 1)
        main = written(main.select("bucket", F.col("main.root").alias("main"), "n"), "main-parts")
        members = written(spread_join(placed, main, "bucket", "n", F.col("node"), "inner"), "mixed-buckets")
        others = members.where(F.col("root") != F.col("main"))
        n_apart = others.select("node").distinct().count()
        if turn == ROUNDS or n_apart == apart:  # a round without success: what is left is tried in full
            break
        apart = n_apart
        if sets is None:
            sets = _sets_of(written(members.select("node").distinct(), "needed"), documents, shingle_words)
        in_main = members.where(F.col("root") == F.col("main"))
        pivots = in_main.groupBy("bucket").agg(F.array_distinct(F.array(
            *(F.min_by("node", F.xxhash64("node", F.lit(turn * PIVOTS + k))) for k in range(PIVOTS)))).alias("pivots"), F.max("n").alias("n"))
        pivots = written(pivots, "pivots")
        tries = spread_join(others.drop("n"), pivots, "bucket", "n", F.col("node"), "inner").select(F.explode("pivots").alias("a"), F.col("node").alias("b")).distinct()
        found = _confirmed(written(_best(tries, nodes, percent, TRIED), "tries"), sets, percent)
        links = written(links.union(found), "links")
        members = members.select("bucket", "node")  # placed anew with the links found
        release(documents.sparkSession)

    if sets is not None and apart:
        # a bucket is dealt to parts of about PART_NODES nodes, and what is apart in it goes to each of them
        parts = F.ceil(F.col("n") / PART_NODES).cast("int")
        known = members.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).join(_named(nodes, "x"), F.col("node") == F.col("x"))
        known = written(known.drop("node"), "mixed-members")
        left = known.where(F.col("root") != F.col("main")).drop("main", "part").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
        left = left.select(*(F.col(c).alias(c[:-1] + "y" if c == "x" or c.endswith("_x") else f"{c}_y") for c in left.columns))
        # the test is part of the join, so only pairs that the sketches allow leave it
        in_part = (F.col("bucket") == F.col("bucket_y")) & (F.col("part") == F.col("part_y"))
        plausible = known.join(left, in_part & (F.col("root") != F.col("root_y")) & _allowed(percent, "x", "y"))
        cross = written(plausible.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cross-pairs")
        links = written(links.union(_confirmed(cross, sets, percent)), "links")
        release(documents.sparkSession)
    # documents that carry several sets under one id, and equal sets, are linked by their ids
    roots = written(connected_components(links.union(usable.join(classes.where("n > 1"), ["set_a", "set_b"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")))), "roots")
    return (
        rows.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
