"""Tables, text trees, transcripts and binary heads as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions.wordlists import EXECUTABLE_HEADS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; event times become timestamps of the session's zone."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else rows


def text_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, text of every file below a folder whose name fits the glob."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def file_kind(path: Column, text: Column | None = None) -> Column:
    """workflow, source or document, from a path and, for YAML, from the text."""
    yaml = path.rlike(r"(?i)\.ya?ml$")
    flow = path.rlike(r"(^|/)\.github/workflows/")
    if text is not None:
        flow = flow | (yaml & text.rlike(r"(?m)^on:") & text.rlike(r"(?m)^jobs:"))
    source = path.rlike(r"(?i)\.(go|rs|py|js|ts|tsx|jsx|java|c|cc|cpp|h|hpp|cs|rb|php|sh|sql|swift|kt|scala)$")
    return F.when(flow, "workflow").when(source | yaml, "source").otherwise("document")


# Folders of borrowed texts, and what generated texts say in their first lines.
BORROWED = [".git", "node_modules", "vendor", "third_party", "dist", "build"]
GENERATED = r"(?i)code generated .* do not edit|@generated|this file is (auto-?)?generated"


def own_texts(docs: DataFrame) -> DataFrame:
    """docs(path, text) that are neither borrowed nor generated."""
    parts = F.split("path", "/")
    head = F.array_join(F.slice(F.split("text", "\n", -1), 1, 5), "\n")
    return docs.where(~F.arrays_overlap(parts, F.array(*map(F.lit, BORROWED)))).where(~F.coalesce(head.rlike(GENERATED), F.lit(False)))


def executables(spark: SparkSession, root: str) -> DataFrame:
    """path, kind of files that start like an executable."""
    heads = spark.createDataFrame(EXECUTABLE_HEADS, "head string, kind string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = files.select("path", F.hex(F.substring("content", 1, 4)).alias("first"))
    return rows.join(heads, rows["first"].startswith(heads["head"])).select("path", "kind")  # seven heads


TRANSCRIPT = StructType([
    StructField("type", StringType()), StructField("timestamp", StringType()), StructField("sessionId", StringType()), StructField("isSidechain", BooleanType()),
    StructField("message", StructType([StructField("role", StringType()), StructField("content", StringType())])), StructField("_corrupt_record", StringType()),
])


def transcript(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """Records of a JSONL transcript; malformed lines, side chains and other sessions are left out."""
    rows = spark.read.schema(TRANSCRIPT).option("mode", "PERMISSIVE").json(path)
    rows = rows.where(F.col("_corrupt_record").isNull() & ~F.coalesce("isSidechain", F.lit(False))).drop("_corrupt_record")
    return rows if session is None else rows.where(F.col("sessionId") == session)


def transcript_blocks(records: DataFrame) -> DataFrame:
    """The blocks of records in their order: session, ts, record_no, role, at, kind, text, name, call_id, input, answers, is_error.

    The content of a message is a text, which is one block of kind text, or an array of blocks. A call
    has a name, an id and its input in canonical form; a result names the call it answers. Blocks of
    other kinds, and fields of other types, have nulls; a record without content has no block.
    """
    content = F.col("message.content")
    parsed = F.try_parse_json(content)
    is_array = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))
    rows = records.select(
        F.col("sessionId").alias("session"), F.to_timestamp("timestamp").alias("ts"), F.monotonically_increasing_id().alias("record_no"),
        F.col("message.role").alias("role"), content.alias("content"), F.when(is_array, parsed.cast("array<variant>")).alias("blocks"),
    ).where("content is not null")
    # a text is the one block of its record
    rows = rows.select("*", F.posexplode_outer("blocks").alias("at", "block"))
    own = lambda path, kind="string": F.try_variant_get("block", path, kind)
    return rows.select(
        "session", "ts", "record_no", "role", F.coalesce("at", F.lit(0)).alias("at"), F.when(F.col("blocks").isNull(), "text").otherwise(own("$.type")).alias("kind"),
        F.when(F.col("blocks").isNull(), F.col("content")).otherwise(own("$.text")).alias("text"), own("$.name").alias("name"), own("$.id").alias("call_id"),
        F.to_json(own("$.input", "variant")).alias("input"), own("$.tool_use_id").alias("answers"), F.coalesce(own("$.is_error", "boolean"), F.lit(False)).alias("is_error"),
    ).where("kind is not null")


def transcript_turns(blocks: DataFrame) -> DataFrame:
    """session, turn_no, sig, n_calls, started_at, ended_at of the turns that call anything: a user's text opens a turn, an answer to a call does not.

    The signature of a turn is its calls, name and canonical input, in order of their text.
    """
    place = W.partitionBy("session").orderBy("ts", "record_no", "at")
    opens = (F.col("role") == "user") & (F.col("kind") == "text")
    rows = blocks.withColumn("turn_no", F.sum(F.when(opens, 1).otherwise(0)).over(place))
    calls = rows.where("kind = 'tool_use'").withColumn("call", F.concat_ws(" ", "name", "input"))
    spans = rows.groupBy("session", "turn_no").agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    sums = calls.groupBy("session", "turn_no").agg(F.concat_ws("\n", F.array_sort(F.collect_list("call"))).alias("sig"), F.count(F.lit(1)).alias("n_calls"))
    return sums.join(spans, ["session", "turn_no"]).select("session", "turn_no", "sig", "n_calls", "started_at", "ended_at")


def rule_rows(rows: DataFrame, surface: str) -> DataFrame:
    """Rows of a rule table rule_rows(match, surface, case_sensitive, ...) that apply to a surface; without one they apply to all."""
    return rows.where(F.col("surface").isNull() | (F.col("surface") == surface))


def failing_rule_rows(rows: DataFrame) -> DataFrame:
    """Rows of rule_rows(rule_id, match, replace, case_sensitive, test_in, test_out) that do not turn their own test_in into test_out."""
    pattern = F.when(F.coalesce("case_sensitive", F.lit(False)), F.col("match")).otherwise(F.concat(F.lit("(?i)"), F.col("match")))
    got = F.regexp_replace("test_in", pattern, F.coalesce("replace", F.lit("")))
    return rows.where(~F.coalesce(F.regexp_like("test_in", pattern) & (got == F.coalesce("test_out", F.lit(""))), F.lit(False)))
