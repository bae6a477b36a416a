"""Helpers that the training-corpus operators share."""

from __future__ import annotations

import functools
import gc
import re
import uuid

import pyarrow
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may leave spark.checkpoint.dir unset; it gets one below /tmp."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    Unlike a cached plan, the table survives a lost executor, and its real size is known to the
    planner, so whether a join broadcasts it is decided by spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made and that nothing reads any more; those of file systems that pyarrow does not know stay."""
    for table_ in tables:
        folder = table_.inputFiles()[0].rsplit("/", 1)[0]
        try:
            file_system, path = pyarrow.fs.FileSystem.from_uri(folder)
        except (pyarrow.ArrowInvalid, pyarrow.ArrowNotImplementedError):
            continue
        file_system.delete_dir(path)


def all_columns(df: DataFrame) -> list[Column]:
    """Every column of df, whatever is in its name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def row_key(id_col: Column, text: Column) -> Column:
    """Names a row by content, so that repeated ids and repeated rows get one defined answer each."""
    return F.struct(F.xxhash64(id_col, text).alias("a"), F.xxhash64(F.lit("row"), text, id_col).alias("b"))


def two_hashes(value: Column) -> Column:
    """128 bits: two 64-bit hashes of different seeds."""
    return F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit("second"), value).alias("b"))


#: A key is hot if it has more than one in HOT_SHARE of all rows, so fewer keys than this are hot, whatever the input.
HOT_SHARE = 20_000


def spread_join(rows: DataFrame, right: DataFrame, key: str, n: str, by: Column, how: str = "left_semi", total: int | None = None) -> DataFrame:
    """rows joined to right on key, with the rows of hot keys dealt to several tasks by the hash of `by`.

    right has each key once and in n how many of the rows hold it; total is the sum of n. A hot key
    is dealt to as many salts as it has shares, and its row of `right` is repeated for each of them,
    which takes 2 * HOT_SHARE rows at most. Only the hot keys, fewer than HOT_SHARE, are broadcast. Rows
    without a key are in no result.
    """
    if total is None:
        total = right.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    share = max(1, total // HOT_SHARE)
    salts = F.greatest(F.ceil(F.col(n) / share), F.lit(1)).cast("int")
    hot = right.where(F.col(n) > share).select(key, salts.alias("_salts"))
    salt = F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("_salts")).cast("int"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_salts")
    return dealt.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))), [key, "_salt"], how).drop("_salt")


def any_of(parts: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, parts)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished jobs now, not whenever the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
