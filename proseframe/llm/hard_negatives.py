"""Hard-negative mining: clusters of anchors share candidate lists, sorted once by an angular bound and walked until nothing can follow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import two_hashes, written

#: Candidates that a list's members look at before they ask again whether any may follow.
STEP_ROWS = 1024
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)
#: What rounding may add to a cosine or an angle.
SLACK = 1e-7


def directions(sample: np.ndarray, clusters: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of spherical k-means over unit vectors, begun with those that lie farthest from the ones before."""
    chosen = [0]
    nearest = sample @ sample[0]
    while len(chosen) < min(clusters, len(sample)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    centroids = sample[chosen]
    for _ in range(rounds):
        own = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1)
        centroids[length > 0] = sums[length > 0] / length[length > 0, None]
    return centroids


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled to length 1, lengths); a zero row becomes the first axis, with length 0."""
    top = np.abs(x).max(axis=1, initial=0)
    scaled = x / np.where(top > 0, top, 1)[:, None]
    length = np.linalg.norm(scaled, axis=1)
    out = scaled / np.where(length > 0, length, 1)[:, None]
    out[length == 0, :1] = 1
    return out, length * top


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products; in integers of any size where doubles might round, then cut to 64 bits."""
    most = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * x.shape[1]
    if most < EXACT:
        return (x @ y.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(x) @ whole(y).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def walk(anchors: np.ndarray, bands: list[list[tuple[int, int]]], usable: Callable[[int, np.ndarray], np.ndarray], rows: np.ndarray, ids: np.ndarray, centroids: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, band, row, score) of each anchor's k best rows of each of its bands: usable, with low <= score <= high.

    Anchors of one centroid are a cluster. If all its members lie within an angle r of the centroid,
    no member has a score above |anchor| * |row| * cos(angle(centroid, row) - r) with a row, nor above
    |anchor| * |row| with one nearer than r. Rows are sorted once for each cluster by that bound, without
    |anchor|. A member leaves the walk when the next row's bound is below all that its bands still take.
    """
    u, size_u = unit(anchors)
    v, size_v = unit(rows)
    own = np.argmax(u @ centroids.T, axis=1)
    place = np.argsort(ids, kind="stable")  # so that of equal scores the smaller id is met first in a step
    rank = np.empty(len(ids), np.int64)
    rank[place] = np.arange(len(ids))
    for cluster in np.unique(own):
        members = np.flatnonzero(own == cluster)
        angle = lambda x: np.arccos(np.clip(x @ centroids[cluster], -1, 1))  # noqa: B023, E731
        reach = angle(u[members]).max() + SLACK
        bound = size_v * (np.cos(np.maximum(angle(v) - reach - SLACK, 0)) + SLACK)
        order = np.argsort(-bound, kind="stable")
        best: dict[tuple[int, int], list[tuple[int, int]]] = {}
        #: the least score that each band of a member still takes
        least = {(m, b): low for m in members for b, (low, high) in enumerate(bands[m]) if low <= high}
        active = np.array([m for m in members if any((m, b) in least for b in range(len(bands[m])))], np.int64)
        for at in range(0, len(order), STEP_ROWS):
            floor = np.array([min(least[m, b] for b in range(len(bands[m])) if (m, b) in least) for m in active], float)
            active = active[size_u[active] * bound[order[at]] * (1 + SLACK) >= floor - 1]
            if not len(active):
                break
            step = order[at : at + STEP_ROWS]
            step = step[np.argsort(rank[step])]
            scores = _product(anchors[active], rows[step])
            for i, m in enumerate(active):
                fit = usable(m, step)
                for b, (_, high) in enumerate(bands[m]):
                    if (m, b) not in least:
                        continue
                    some = np.flatnonzero(fit & (scores[i] >= least[m, b]) & (scores[i] <= high))
                    if not len(some):
                        continue
                    if len(some) > k:
                        edge = np.partition(scores[i][some], len(some) - k)[len(some) - k]
                        above, level = some[scores[i][some] > edge], some[scores[i][some] == edge]
                        some = np.concatenate((above, level[: k - len(above)]))  # of equal scores the smaller ids
                    held = best.get((m, b), []) + [(-int(scores[i][j]), int(rank[step[j]])) for j in some]
                    best[m, b] = sorted(held)[:k]
                    if len(best[m, b]) == k:
                        least[m, b] = max(least[m, b], -best[m, b][-1][0])
        for (m, b), held in best.items():
            for score, j in held:
                yield int(m), b, int(place[j]), -score


def _finite(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))


def _sampled_directions(anchors: DataFrame, clusters: int, sample_rows: int) -> dict[int, np.ndarray]:
    """Centroids for each length of vectors, from at most sample_rows anchors of it."""
    by_hash = W.partitionBy("dims").orderBy(F.xxhash64("node"), "node")
    sample = anchors.select("dims", "node", "vector").withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= sample_rows)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x, _ = unit(np.stack(part.sort_values("n")["vector"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"dims": part["dims"].iloc[0], "centroid": list(directions(x, clusters))})

    found: dict[int, list[np.ndarray]] = {}
    for r in sample.groupBy("dims").applyInPandas(fit, "dims int, centroid array<double>").toLocalIterator():
        found.setdefault(r["dims"], []).append(np.array(r["centroid"]))
    return {dims: np.stack(x) for dims, x in found.items()}


def _tiled(asked: DataFrame, rows: DataFrame, groups: list[str], tile_anchors: int, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to tiles of a group: asked gets (groups, left, right) for each block of rows, rows for each block of anchors."""
    count = lambda x, n, name: x.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / n).cast("int").alias(name))
    sizes = written(count(asked, tile_anchors, "lefts").join(count(rows, tile_rows, "rights"), groups), "tile-counts")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    own = lambda name: F.pmod(F.xxhash64("node"), F.col(name)).cast("int")
    left = asked.join(sizes, groups).withColumn("left", own("lefts")).withColumn("right", every("rights"))
    right = rows.join(sizes, groups).withColumn("right", own("rights")).withColumn("left", every("lefts"))
    return left.drop("lefts", "rights"), right.drop("lefts", "rights")


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
    scale: float = 256, clusters: int = 16, sample_rows: int = 4096, tile_anchors: int = 4096, tile_rows: int = 16384,
) -> DataFrame:
    """For the anchors among embeddings(vec_id, label, embedding), negatives that are nearly as alike as a positive.

    Components become floor(scale * x); a score is the integer inner product with the anchor, cut to
    64 bits should it not fit. Higher scores come first, ties by smaller vec_id. An anchor's positives
    are its first `positives` other rows of its label; for each the answer has the first `negatives`
    rows of other labels with share[0] * positive <= share[1] * negative <= share[1] * positive, or all
    if there are fewer.

    Rows with a null label or vec_id, a null vector or null or non-finite components take no part;
    neither do vectors of other lengths than the anchor's, for that anchor. Rows that are repeated as a
    whole are one row; other rows that share a vec_id are rows of their own, but none is another row of
    an anchor with its vec_id. Further columns are ignored; an empty table gives nothing. `label` and
    `is_anchor` are columns over embeddings, so labels can be derived.

    Of equal vectors of one label only those with the smallest vec_ids can be among the first few, so
    no more of each are candidates: groups of copies cost nothing, and nothing is lost. Anchors meet the
    rows of their label, then all rows, in tiles of bounded size; in a tile, anchors of one centroid share
    a list (see `walk`). Centroids are fitted to at most sample_rows anchors; they decide
    how far a list is walked, never what is found. A tile returns the best of its own rows, and the best of those are taken.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    rows = embeddings.select("vec_id", (F.col("label") if label is None else label).alias("label"), is_anchor.alias("asked"), whole.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _finite("vector") & (F.size("vector") > 0))
    # floor() would make integers of 64 bits, which large components leave
    rows = rows.withColumn("vector", F.transform("vector", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).withColumn("dims", F.size("vector"))
    rows = rows.withColumn("class", two_hashes(F.struct("label", "vector"))).withColumn("node", F.xxhash64("vec_id", "class"))
    # copies beyond these can't be among the first positives or negatives of any anchor
    most = max(positives + 1, negatives)
    distinct = written(rows.groupBy("vec_id", "label", "class", "node", "dims").agg(F.max("asked").alias("asked"), F.any_value("vector").alias("vector")), "rows")
    anchors = distinct.where("asked").select("node", "vec_id", "label", "dims", "vector")
    copies = F.row_number().over(W.partitionBy("class").orderBy("vec_id"))
    kept = distinct.select("vec_id", "class").withColumn("copy", copies).where(F.col("copy") <= most).drop("copy")
    candidates = written(distinct.join(kept, ["vec_id", "class"], "left_semi").select("node", "vec_id", "label", "dims", "vector"), "candidates")
    centroids = _sampled_directions(anchors, clusters, sample_rows)

    matrix = lambda x: np.stack(x.to_numpy()).astype(np.float64)

    def best_positives(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or rows.empty:
            return pd.DataFrame({"node": [], "anchor_id": [], "positive_id": [], "score": []})
        ids, own = rows["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
        every = [[(-(1 << 63), (1 << 63) - 1)]] * len(asked)
        found = list(walk(matrix(asked["vector"]), every, lambda m, j: ids[j] != own[m], matrix(rows["vector"]), ids, centroids[int(asked["dims"].iloc[0])], positives))
        a, _, j, score = np.array(found, np.int64).reshape(-1, 4).T
        return pd.DataFrame({"node": asked["node"].to_numpy()[a], "anchor_id": own[a], "positive_id": ids[j], "score": score})

    left, right = _tiled(anchors, candidates, ["dims", "label"], tile_anchors, tile_rows)
    tile = ["dims", "label", "left", "right"]
    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(best_positives, "node long, anchor_id long, positive_id long, score long")
    first = lambda by, score, then: F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), then))
    chosen = written(found.withColumn("n", first(["anchor_id", "node"], "score", "positive_id")).where(F.col("n") <= positives), "positives")

    # the range of a negative's score is known before the walk; where it is empty nothing is asked
    part, all_of = share
    bands = chosen.where(part * F.col("score").cast("decimal(20,0)") <= all_of * F.col("score").cast("decimal(20,0)"))
    bands = bands.groupBy("node", F.col("anchor_id").alias("vec_id")).agg(F.collect_set(F.struct("positive_id", "score")).alias("bands"))
    asked = anchors.join(bands, ["node", "vec_id"])

    def best_negatives(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or rows.empty:
            return pd.DataFrame({"node": [], "anchor_id": [], "positive_id": [], "positive_score": [], "negative_id": [], "negative_score": []})
        ids, labels, own = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), asked["label"].to_numpy()
        ranges = [[(-(-part * int(b["score"]) // all_of), int(b["score"])) for b in x] for x in asked["bands"]]
        found = list(walk(matrix(asked["vector"]), ranges, lambda m, j: labels[j] != own[m], matrix(rows["vector"]), ids, centroids[int(asked["dims"].iloc[0])], negatives))
        a, b, j, score = np.array(found, np.int64).reshape(-1, 4).T
        of = [asked["bands"].iloc[x][y] for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"node": asked["node"].to_numpy()[a], "anchor_id": asked["vec_id"].to_numpy()[a], "positive_id": [x["positive_id"] for x in of], "positive_score": [x["score"] for x in of], "negative_id": ids[j], "negative_score": score})

    left, right = _tiled(asked, candidates, ["dims"], tile_anchors, tile_rows)
    tile = ["dims", "left", "right"]
    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInPandas(
        best_negatives, "node long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    ranked = found.withColumn("rank", first(["anchor_id", "node", "positive_id", "positive_score"], "negative_score", "negative_id")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
