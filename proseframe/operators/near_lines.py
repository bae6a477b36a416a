"""Near-duplicate documents by the multiset of their trimmed lines, and the portions that a later copy shares."""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import segment as S
from ..functions.wordlists import NEAR_DUPLICATE_SHARE


def trimmed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line: trimmed lines that are not blank."""
    rows = S.lines(docs).withColumn("line", F.btrim("line", F.lit(" \t\r\x0b\x0c")))
    return rows.where("line != ''")


def line_multisets(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, *columns, keys: a key for each copy of a trimmed line, so that common keys count the multiset intersection.

    Made inside each row: equal lines stand together in the sorted hashes, and each run of them is
    numbered. Documents without such lines are left out.
    """
    trimmed = F.filter(F.transform(S.lines_of(F.col("text")), lambda s: F.btrim(s, F.lit(" \t\r\x0b\x0c"))), lambda s: s != "")

    def numbered(h: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(h) - 1)
        starts = F.filter(places, lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))

        def of_run(firsts: Column, first: Column, j: Column) -> Column:
            copies = F.coalesce(F.get(firsts, j + 1), F.size(h)) - first
            return F.transform(F.sequence(F.lit(1), copies), lambda k: F.xxhash64(F.get(h, first), k))

        return S.let(starts, lambda firsts: F.flatten(F.transform(firsts, lambda first, j: of_run(firsts, first, j))))

    rows = docs.select("doc_id", *columns, F.array_sort(F.transform(trimmed, lambda s: F.xxhash64(s))).alias("h")).where(F.size("h") > 0)
    return rows.select("doc_id", *columns, F.array_sort(S.let(F.col("h"), numbered)).alias("keys"))


# Fixed value: classes of at most so many lines are matched by the sets of lines that they have to share.
SHORT = 4


def _short_pairs(classes: DataFrame, share: float, block: list[str]) -> DataFrame:
    """doc_a, doc_b: for each class of at most SHORT lines the first class that is as short and holds the same set of as many lines as the two sizes ask for.

    Such classes often consist of common lines alone, so that pairs of them by one line would grow
    with the square of the table. Each class lists its sets for each size of the other, 24 at most.
    """
    sets = []
    for n, m in itertools.product(range(1, SHORT + 1), repeat=2):
        needed = math.ceil(share * (n + m) / 2 - 1e-9)
        if needed <= min(n, m):
            of_size = [F.struct(F.lit(m).alias("other"), F.array(*(F.get("keys", F.lit(i)) for i in places)).alias("lines")) for places in itertools.combinations(range(n), needed)]
            sets.append(F.when(F.col("n") == n, F.array(*of_size)))
    empty = F.array().cast("array<struct<other: int, lines: array<bigint>>>")
    held = classes.where(F.col("n") <= SHORT).select("doc_id", "n", *block, F.explode(F.concat(*(F.coalesce(x, empty) for x in sets))).alias("s"))
    held = held.select("doc_id", *block, F.col("n").alias("own"), "s.other", "s.lines")
    firsts = held.groupBy(*block, "lines", F.col("own").alias("other"), F.col("other").alias("own")).agg(F.min("doc_id").alias("doc_a"))
    return held.join(firsts, [*block, "lines", "own", "other"]).where("doc_a < doc_id").select("doc_a", F.col("doc_id").alias("doc_b"))


def near_duplicates(docs: DataFrame, share: float = NEAR_DUPLICATE_SHARE, block: list[str] | None = None) -> DataFrame:
    """doc_a, doc_b, share: each document with the first earlier one whose Dice share of lines reaches the threshold.

    Documents with equal lines are one class, and only its smallest id is compared: it stands before
    all its copies, so they have the same first earlier document as it has, or else it itself. A pair
    at the threshold t has sizes within t / (2 - t) of each other and shares a key among the first
    n - ceil(n t / (2 - t)) + 1 of each document, when keys are sorted by how many classes hold them.
    Only these prefixes are joined, and the sizes of both bound the places of the key further; where
    both are short, see _short_pairs. The pairs found are then counted in full. `block` names columns
    that both documents must share, as a file name; a null there matches nothing.
    """
    block = block or []
    rows = line_multisets(docs.dropna(subset=block) if block else docs, *block)
    same = [*block, "same_a", "same_b"]
    rows = rows.withColumns({"same_a": F.xxhash64("keys"), "same_b": F.xxhash64(F.lit("second"), "keys")})
    classes = rows.groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")).withColumn("n", F.size("keys"))
    keys = classes.select("doc_id", "n", *block, F.explode("keys").alias("key"))
    frequency = keys.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    shared = keys.join(frequency.where("df > 1"), "key")  # a key of one class joins nothing
    ratio = share / (2 - share)
    prefix = F.col("n") - F.ceil(F.col("n") * ratio - 1e-9) + 1
    # keys of one class stand before all shared ones, so they use up places of the prefix
    of_class = W.partitionBy("doc_id")
    counted = shared.withColumn("rank", F.row_number().over(of_class.orderBy("df", "key"))).withColumn("n_shared", F.count(F.lit(1)).over(of_class))
    firsts = counted.withColumn("place", F.col("rank") + F.col("n") - F.col("n_shared")).where(F.col("place") <= prefix)
    side = lambda rows, x: rows.select(F.col("doc_id").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}"), F.col("place").alias(f"place_{x}"), "key", *block)
    # the first key that both hold has all others that they share behind it
    needed = F.ceil((F.col("n_x") + F.col("n_y")) * (share / 2) - 1e-9)
    fits = functools.reduce(lambda p, x: p & (F.col(f"place_{x}") <= F.col(f"n_{x}") - needed + 1), "xy", (F.col("doc_x") < F.col("doc_y")) | (F.col("n_x") <= SHORT))
    long_pairs = side(firsts, "x").join(side(firsts.where(F.col("n") > SHORT), "y"), ["key", *block]).where(fits)
    pairs = long_pairs.select(F.least("doc_x", "doc_y").alias("doc_a"), F.greatest("doc_x", "doc_y").alias("doc_b")).union(_short_pairs(classes, share, block)).distinct()
    sets = lambda name: classes.select(F.col("doc_id").alias(f"doc_{name}"), F.col("keys").alias(f"keys_{name}"))
    common = F.size(F.array_intersect("keys_a", "keys_b"))
    full = pairs.join(sets("a"), "doc_a").join(sets("b"), "doc_b").withColumn("share", 2.0 * common / (F.size("keys_a") + F.size("keys_b")))
    found = full.where(F.col("share") >= share).groupBy("doc_b").agg(F.min(F.struct("doc_a", "share")).alias("first"))
    first = classes.select(*same, F.col("doc_id").alias("smallest")).join(found.withColumnRenamed("doc_b", "smallest"), "smallest", "left")
    members = rows.select(F.col("doc_id").alias("doc_b"), *same).join(first, same)
    own = F.when(F.col("doc_b") != F.col("smallest"), F.struct(F.col("smallest").alias("doc_a"), F.lit(1.0).alias("share")))
    return members.withColumn("first", F.coalesce("first", own)).where("first is not null").select("first.doc_a", "doc_b", "first.share")


def copied_portions(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_a, doc_b, start, end: runs of lines of doc_b whose copies doc_a holds too. Blank lines end a run."""
    named = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id"))
    rows = trimmed_lines(docs.join(named, "doc_id", "left_semi"))  # only lines of these documents are sorted
    per = W.partitionBy("doc_id", "line").orderBy("line_no")
    numbered = rows.withColumn("occ", F.row_number().over(per))
    have = numbered.groupBy("doc_id", "line").agg(F.max("occ").alias("have"))
    later = pairs.select("doc_a", "doc_b").join(numbered.withColumnRenamed("doc_id", "doc_b"), "doc_b")
    held = later.join(have.withColumnRenamed("doc_id", "doc_a"), ["doc_a", "line"]).where(F.col("occ") <= F.col("have"))
    place = W.partitionBy("doc_a", "doc_b").orderBy("line_no")
    islands = held.withColumn("island", F.col("line_no") - F.row_number().over(place))
    return islands.groupBy("doc_a", "doc_b", "island").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end")).drop("island")


def merged_ranges(ranges: DataFrame, key: list[str]) -> DataFrame:
    """key, start, end: ranges of a key joined where they overlap or share a line."""
    place = W.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(place.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(place))
    return marked.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def without_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """docs(doc_id, text) without the lines of ranges(doc_id, start, end)."""
    cut = ranges.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", "end")))).alias("cut"))

    def left(ls: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(1), F.size(ls)), F.coalesce("cut", F.array().cast("array<int>")))
        return F.transform(kept, lambda i: F.get(ls, i - 1))

    return docs.join(cut, "doc_id", "left").withColumn("text", F.array_join(S.let(S.lines_of(F.col("text")), left), "\n")).drop("cut")
