"""Chat formatting: collapse cumulative snapshots of a conversation, then render what remains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """Drop logged conversations that are a proper prefix of a longer one, and repeated ones.

    A conversation is the rows of one conv_id in the order (turn, role, text), nulls first. Each of
    its turns gets the rolling hash of all turns up to it, so the last hash names the conversation
    and the earlier ones name its prefixes. Of equal conversations the smallest conv_id stays (null
    is the smallest); an anti-join against all proper prefixes keeps the maximal ones.

    A null role or text counts as a value of its own, distinct from the empty string. Repeated rows
    are repeated turns. Other columns are ignored; an empty table gives an empty result. One
    conversation, being one record of the result, has to fit a task.

    Returns conv_id, n_turns, turns array<struct<turn, role, text>>, conversation_hash.
    """
    turns = (
        conversations.select("conv_id", F.struct("turn", "role", "text").alias("t"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
    )
    step = lambda hashes, t: F.array_append(
        hashes,
        F.sha2(
            F.concat_ws(
                "\u0001",
                F.coalesce(F.element_at(hashes, -1), F.lit("")),
                F.coalesce(F.concat(F.lit("r"), F.length(t["role"]).cast("string"), F.lit(":"), t["role"]), F.lit("-")),
                F.coalesce(F.concat(F.lit("t"), t["text"]), F.lit("-")),
            ),
            256,
        ),
    )
    # the first element is a seed and no turn's hash
    hashed = turns.withColumn("hashes", F.aggregate("turns", F.array(F.lit("seed")), step))
    keyed = written(
        hashed.select(
            "conv_id",
            "turns",
            F.size("turns").cast("long").alias("n_turns"),
            F.element_at("hashes", -1).alias("conversation_hash"),
            F.slice("hashes", 2, F.size("hashes") - 2).alias("prefix_hashes"),
        ),
        "conversations",
    )
    unique = keyed.groupBy("conversation_hash").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id")).alias("first"))
    prefixes = keyed.select(F.explode("prefix_hashes").alias("conversation_hash")).distinct()
    kept = unique.join(prefixes, "conversation_hash", "left_anti").select(F.col("first.conv_id").alias("kept_id"))
    return keyed.join(kept, keyed.conv_id.eqNullSafe(kept.kept_id), "left_semi").select("conv_id", "n_turns", "turns", "conversation_hash")


def format_chats(conversations: DataFrame, template: tuple[str, str, str] = ("<|", "|>\n", "\n")) -> DataFrame:
    """Collapse snapshots, then render each conversation left as one text.

    Each turn becomes template[0] + role + template[1] + text + template[2]; null roles and texts
    render as empty strings. See collapse_snapshots for what stays.

    Returns conv_id, n_turns, rendered.
    """
    before, between, after = template
    part = lambda t: F.concat(
        F.lit(before), F.coalesce(t["role"], F.lit("")), F.lit(between), F.coalesce(t["text"], F.lit("")), F.lit(after)
    )
    return collapse_snapshots(conversations).select(
        "conv_id", "n_turns", F.array_join(F.transform("turns", part), "").alias("rendered")
    )
