"""Embedding near-dedup: int8 tile products with error bounds, full precision where they leave doubt."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import two_hashes, written
from .components import connected_components


#: Rows of a tile that are multiplied at once.
BLOCK_ROWS = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, error) of unit vectors: a row differs from values * scale by at most error in the Euclidean norm."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    # a little more than measured, for the rounding of this very computation
    error = np.linalg.norm(x - q * scale[:, None], axis=1) + 1e-12
    return q, scale, error


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between 1/2 and 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def linked_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows of x, rows of y, pairs recomputed) of all pairs whose cosine in double precision is at least the threshold.

    Vectors are first scaled by powers of two, which rounds nothing, so that neither very large nor
    very small components leave the range of doubles when squared.

    For unit vectors u = u' + d and v = v' + e, with quantised u' and v', |u.v - u'.v'| is at most
    |d||v'| + |u'||e| + |d||e|. Only pairs whose int8 product plus that bound reaches the threshold
    are computed in double precision.
    """
    x, y = scaled(x), scaled(y)
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, ex), (qy, sy, ey) = quantise(x / norm_x[:, None]), quantise(y / norm_y[:, None])
    # products of int8 values summed below 2**24 are exact in single precision
    exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = (qx.astype(exact) @ qy.astype(exact).T).astype(np.float64) * sx[:, None] * sy[None, :]
    bound = ex[:, None] * (1 + ey)[None, :] + (1 + ex)[:, None] * ey[None, :] + (ex[:, None] * ey[None, :])
    i, j = np.nonzero(product + bound >= threshold - 1e-9)
    keep = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        keep[at : at + len(a)] = np.einsum("kd,kd->k", x[a], y[b]) / (norm_x[a] * norm_y[b]) >= threshold
    return i[keep], j[keep], len(i)


def _smallest_reachable(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id that each place reaches over the links (i, j)."""
    low = ids.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, new[i])
        if (new == low).all():
            return low
        low = new


def embedding_duplicates(embeddings: DataFrame, threshold: float = 0.98, tile_rows: int = 4096) -> DataFrame:
    """Link rows of embeddings(vec_id, embedding, label) of one label with a cosine of at least the threshold.

    Null labels, ids and vectors, zero vectors and those with null or non-finite components are
    linked with nothing; vectors of different lengths neither. Every row is returned; rows with one
    vec_id count as one vector's copies. Other columns are ignored; empty tables give nothing.

    Bitwise equal vectors of a label are one class, so copies cost nothing. Classes of a label are
    dealt to tiles of about tile_rows; each pair of tiles is one small task, whatever the size of
    the label, which works through it in blocks of BLOCK_ROWS. Vectors move as they are stored, in
    single precision if the column is, once for each tile of their label. A task returns link counts and, of its links, a spanning star for each part that
    they connect: never more rows than its tiles have.

    Returns vec_id, n_links (other vectors linked directly, copies included), component_id
    (smallest vec_id reachable; vec_id if none), kept (vec_id = component_id; true for null ids).
    """
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    )
    single = dict(embeddings.dtypes)["embedding"] in ("array<float>", "array<tinyint>", "array<smallint>")
    vector = F.col("embedding").cast("array<float>" if single else "array<double>")
    rows = embeddings.select("vec_id", "label", vector.alias("embedding")).withColumn("usable", usable)
    rows = rows.withColumn("name", F.when(F.col("usable"), two_hashes(F.struct("label", "embedding"))))
    classes = written(
        rows.where("usable").groupBy("name", "label").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    representatives = (
        rows.where("usable").join(classes.select("name", "node", "copies"), "name").where(F.col("vec_id") == F.col("node"))
        .select("label", F.size("embedding").alias("dims"), "node", "copies", "embedding").dropDuplicates(["label", "dims", "node", "embedding"])
    )
    representatives = written(representatives, "representatives")
    tiles = representatives.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"))
    tiles = written(tiles, "tile-counts")
    placed = representatives.join(tiles, ["label", "dims"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    # each tile goes to the pairs (tile, other) and (other, tile) with the smaller first
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "dims", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"),
        (F.col("tile") <= F.col("other")).alias("is_first"), (F.col("tile") >= F.col("other")).alias("is_second"), "node", "copies", "embedding",
    )

    def tile_pair(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", ignore_index=True)
        nodes, copies = part["node"].to_numpy(), part["copies"].to_numpy()
        x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
        first, second = np.flatnonzero(part["is_first"]), np.flatnonzero(part["is_second"])
        links, stars = np.zeros(len(nodes), np.int64), [np.zeros((2, 0), np.int64)]
        place = np.arange(len(nodes))
        for a in range(0, len(first), BLOCK_ROWS):
            for b in range(0, len(second), BLOCK_ROWS):
                rows_x, rows_y = first[a : a + BLOCK_ROWS], second[b : b + BLOCK_ROWS]
                i, j, _ = linked_pairs(x[rows_x], x[rows_y], threshold)
                i, j = rows_x[i], rows_y[j]
                if key[2] == key[3]:  # a tile with itself holds each pair twice
                    i, j = i[i < j], j[i < j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                low = _smallest_reachable(place, i, j)  # the block's links as stars, at most one for each row
                stars.append(np.stack([place, low])[:, low != place])
        root = nodes[_smallest_reachable(place, *np.hstack(stars))]  # nodes are sorted, so the first place has the smallest
        some = links > 0
        return pd.DataFrame({"node": nodes[some], "links": links[some], "root": root[some]})

    found = written(
        sent.groupBy("label", "dims", "first", "second").applyInPandas(tile_pair, "node long, links long, root long"), "tile-links"
    )
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    answer = (
        classes.join(counts, "node", "left").join(roots, "node", "left")
        .select("name", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    )
    return (
        rows.select("vec_id", "name").join(answer, "name", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
