"""Document fingerprints: sums of wide vectors hashed from paragraphs, modulo powers of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import written

#: A paragraph's vector: DIGEST lanes of 32 bits from its hash, then COUNTERS lanes of 16 bits of its pieces.
DIGEST, COUNTERS = 8, 128
LANES = DIGEST + COUNTERS
DIGEST_RANGE, COUNTER_RANGE = 1 << 32, 1 << 16
#: A piece: up to four words of a paragraph, counted from its start.
PIECE = "[^ ]+(?: +[^ ]+){0,3}"


def paragraphs(text: Column) -> Column:
    """The lines of a text; an empty one is one empty paragraph."""
    return F.split(text, "\n", -1)


def hashed(paragraph: Column) -> Column:
    """A paragraph's vector as array of (lane, value): 32 bits of SHA-256 in each digest lane, 1 or -1 in a counter for each piece."""
    number = lambda s, at, n: F.conv(F.substr(s, F.lit(at), F.lit(n)), 16, 10).cast("long")
    whole = F.sha2(paragraph, 256)
    digest = F.array(*(F.struct(F.lit(k).alias("lane"), number(whole, 8 * k + 1, 8).alias("value")) for k in range(DIGEST)))

    def counted(bits: Column) -> Column:
        return F.struct((F.pmod(bits, F.lit(COUNTERS)) + DIGEST).cast("int").alias("lane"), F.when(bits % (2 * COUNTERS) < COUNTERS, F.lit(1)).otherwise(F.lit(-1)).cast("long").alias("value"))

    pieces = F.transform(F.regexp_extract_all(paragraph, F.lit(PIECE), F.lit(0)), lambda p: number(F.md5(p), 1, 4))
    return F.concat(digest, F.transform(pieces, counted))


def _reduced(value: Column, lane: Column) -> Column:
    return F.pmod(value, F.when(lane < DIGEST, F.lit(DIGEST_RANGE)).otherwise(F.lit(COUNTER_RANGE)))


def _text(lanes: Column) -> Column:
    """An array of LANES reduced values as hexadecimal string."""
    return F.lower(F.array_join(F.transform(lanes, lambda x, k: F.lpad(F.hex(x), F.when(k < DIGEST, 8).otherwise(4), F.lit("0"))), ""))


def lanes_of(fingerprint: Column) -> Column:
    """The values that a fingerprint string holds."""
    at = lambda k: F.when(k < DIGEST, k * 8 + 1).otherwise(8 * DIGEST + (k - DIGEST) * 4 + 1)
    number = lambda k: F.conv(F.substr(fingerprint, at(k), F.when(k < DIGEST, 8).otherwise(4)), 16, 10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), number)


def inserted(fingerprint: Column, others: Column) -> Column:
    """The fingerprint of a text after the paragraphs of another one were added to it, wherever they stand."""
    return _text(F.transform(F.zip_with(lanes_of(fingerprint), lanes_of(others), lambda a, b: a + b), lambda x, k: _reduced(x, k)))


def deleted(fingerprint: Column, others: Column) -> Column:
    """The fingerprint of a text after paragraphs that it has were taken out of it."""
    return _text(F.transform(F.zip_with(lanes_of(fingerprint), lanes_of(others), lambda a, b: a - b), lambda x, k: _reduced(x, k)))


def _signed(lanes: Column) -> Column:
    return F.transform(F.slice(lanes, DIGEST + 1, COUNTERS), lambda x: F.when(x >= COUNTER_RANGE // 2, x - COUNTER_RANGE).otherwise(x))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def _likeness(a: Column, b: Column, norm_a: Column, norm_b: Column, equal: Column) -> Column:
    """a, b: signed counters; norms: their squares' sums."""
    cosine = _dot(a, b).cast("double") / F.sqrt(norm_a.cast("double") * norm_b.cast("double"))
    return F.when(equal, F.lit(1.0)).when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def likeness(one: Column, other: Column) -> Column:
    """0 to 1: how alike two fingerprint strings are.

    The product of two sums of vectors of random signs estimates how many pieces the texts have in
    common, so the cosine of the counters estimates the cosine of their pieces' counts, with a standard
    error of about 1 / sqrt(COUNTERS). Equal fingerprints have 1; a text without pieces has 0 with others.
    """
    a, b = _signed(lanes_of(one)), _signed(lanes_of(other))
    return _likeness(a, b, _dot(a, a), _dot(b, b), one == other)


def _summed(units: DataFrame, row: list[str], sums: list[str]) -> DataFrame:
    """Lane sums of units(row..., vector, in_...), one array of LANES for each name in sums, next to `row`."""
    spread = units.select(*row, *(f"in_{s}" for s in sums), F.explode("vector").alias("unit"))
    by_lane = spread.groupBy(*row, F.col("unit.lane").alias("lane")).agg(*(F.sum(F.col("unit.value") * F.col(f"in_{s}")).alias(s) for s in sums))
    by_row = by_lane.groupBy(*row).agg(F.map_from_entries(F.collect_list(F.struct("lane", F.struct(*sums)))).alias("lanes"))
    filled = lambda s: F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: _reduced(F.coalesce(F.col("lanes")[k][s], F.lit(0)), k))
    return by_row.select(*row, *(filled(s).alias(s) for s in sums))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint of documents(doc_id, text); null texts are empty, repeated rows are returned each.

    A fingerprint is the sum of its paragraphs' vectors (see `hashed`), each lane modulo a power of
    two: it doesn't depend on the order of paragraphs, and `inserted` and `deleted` update it without the text.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    units = rows.select("row", "doc_id", F.explode(paragraphs(F.col("text"))).alias("paragraph"))
    units = units.select("row", "doc_id", F.lit(1).alias("in_lanes"), hashed(F.col("paragraph")).alias("vector"))
    return _summed(units, ["row", "doc_id"], ["lanes"]).select("doc_id", _text(F.col("lanes")).alias("fingerprint"))


def _bucket(key: Column, tie: Column, bounds: list[int]) -> Column:
    """The number of bounds up to the key; keys that hold several bounds are dealt to as many buckets in the order of `tie`."""
    if not bounds:
        return F.lit(0)
    width = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    tops = F.array(*(F.lit(g[0]) for g in groups))
    rest = F.array(*(F.array(*(F.lit(x) for x in g)) for g in groups))

    def below(compare) -> Column:
        group = F.size(F.filter(tops, compare)) - 1
        return F.when(group < 0, 0).otherwise(group * width + F.size(F.filter(F.get(rest, F.greatest(group, F.lit(0))), compare)))

    low, high = below(lambda x: x < key), below(lambda x: x <= key)
    place = F.floor((tie.cast("double") / 2.0**64 + 0.5) * (high - low)).cast("int")
    return F.when(high == low, low).otherwise(low + 1 + F.least(place, high - low - 1))


def compare_edited(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint documents(doc_id, text) and their edited texts, and compare each with that and with the next document.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document by ascending doc_id; after the last comes the first. A null id is the
    largest; documents of one id follow each other by a hash of their text, and equal rows are each
    other's neighbours. A null text is empty. Further columns are ignored; an empty table gives
    nothing. A single document is its own next.

    Rows are dealt once, to ranges of doc_id, about four for each shuffle partition. A range also
    gets the first row of the next one, so that each document meets its neighbour in its own task.
    The edited fingerprint is the sum of the unchanged paragraphs' vectors, made once, and of those that the edit put in.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = documents.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    shares = [k / buckets for k in range(1, buckets)]
    bounds = documents.agg(F.percentile_approx(key, shares, 20 * buckets).alias("bounds")).first()[0] if shares else []
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", key.alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    rows = rows.withColumn("bucket", _bucket(F.col("key"), F.col("tie"), bounds or []))
    firsts = rows.groupBy("bucket").agg(F.min_by(F.struct("doc_id", "key", "tie", "text"), F.struct("key", "tie")).alias("row"))
    firsts = written(firsts, "first-rows")  # one row for each bucket at most
    before = F.coalesce(F.lag("bucket").over(W.orderBy("bucket")), F.max("bucket").over(W.partitionBy()))
    ghosts = firsts.select("row.*", before.alias("bucket"), F.lit(True).alias("ghost"))
    order = W.partitionBy("bucket").orderBy("ghost", "key", "tie")
    whole = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts).select(
        "bucket", "ghost", "doc_id", "text", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text")
    )
    whole = whole.withColumn("n_chars", F.length("text").cast("long")).withColumn("changed", (F.floor(F.col("n_chars") / 4)).cast("int"))
    kept = F.substr("text", F.lit(1), F.col("n_chars").cast("int") - F.col("changed"))
    whole = whole.withColumn("edited", F.concat(kept, F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), F.col("changed"))))
    whole = whole.withColumn("same", F.size(paragraphs(kept)) - 1)  # paragraphs that the edit leaves as they are
    row = ["bucket", "place", "ghost", "doc_id", "n_chars", "edited_sha256"]
    lines, edited = paragraphs(F.col("text")), paragraphs(F.col("edited"))
    tail = lambda x: F.slice(x, F.col("same") + 1, F.size(x))
    unit = lambda part, a, b: F.struct(part.alias("part"), F.lit(a).alias("in_own"), F.lit(b).alias("in_edited"))
    units = whole.select(
        *row[:-1], F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(unit(F.slice(lines, 1, F.col("same")), 1, 1), unit(tail(lines), 1, 0), unit(tail(edited), 0, 1))).alias("unit"),
    )
    units = units.select(*row, "unit.in_own", "unit.in_edited", F.explode("unit.part").alias("paragraph"))
    units = units.select(*row, "in_own", "in_edited", hashed(F.col("paragraph")).alias("vector"))
    found = _summed(units, row, ["own", "edited"])
    found = found.select(*row, "own", _text(F.col("own")).alias("fingerprint"), _text(F.col("edited")).alias("edited_fingerprint"), _signed(F.col("own")).alias("a"), _signed(F.col("edited")).alias("b"))
    found = found.withColumn("norm_a", _dot(F.col("a"), F.col("a"))).withColumn("norm_b", _dot(F.col("b"), F.col("b")))
    by_place = W.partitionBy("bucket").orderBy("place")
    following = F.lead(F.struct("fingerprint", "a", "norm_a")).over(by_place)
    found = found.withColumn("after", following).where(~F.col("ghost"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        _likeness(F.col("a"), F.col("b"), F.col("norm_a"), F.col("norm_b"), F.col("fingerprint") == F.col("edited_fingerprint")).alias("near_edited"),
        _likeness(F.col("a"), F.col("after.a"), F.col("norm_a"), F.col("after.norm_a"), F.col("fingerprint") == F.col("after.fingerprint")).alias("near_next"),
    )
