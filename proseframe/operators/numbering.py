"""Numbering of rows inside groups that may be large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered(rows: DataFrame, keys: list[str], order: str, name: str = "rn", parts: int = 200) -> DataFrame:
    """rows with their number, from 1, among the rows of equal keys in ascending order of a numeric column.

    A window by the keys alone would put a group in one task. Here a group is cut at fixed
    quantiles of `order` into at most `parts` + 1 pieces, which are numbered apart; the sizes of the
    pieces before it are added to each number. Null keys are a group; a null order stands first.
    Rows of one key and one order are numbered in any order.
    """
    # `parts` numbers at most reach the driver; as literals they cut alike whenever a task runs again
    cuts = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)]).alias("cuts")).first()["cuts"]
    bounds = F.array(*(F.lit(c) for c in sorted(set(cuts or []))))
    piece = F.when(F.col(order).isNull(), F.lit(-1)).otherwise(F.size(F.filter(bounds, lambda c: c < F.col(order))))
    cut = rows.withColumn("_piece", piece)
    sizes = cut.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_piece").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = cut.withColumn("_own", F.row_number().over(W.partitionBy(*keys, "_piece").orderBy(order)))
    same = F.col("_piece") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return own.join(sizes, same).select(*rows.columns, (F.col("_own") + F.col("_before")).alias(name))
