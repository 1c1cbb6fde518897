"""Conversation history: the part to keep, and the folded input for a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUMMARY_MARK = "summary"
KEEP = 6
MAX_CHARS = 3_000


def keep_recent_messages(messages: DataFrame, keep: int = KEEP) -> DataFrame:
    """User and assistant messages (conversation_id, message_id, role, content) as
    ``recent`` for the last ``keep`` of each conversation, else ``older``.

    A literal limit lets Spark cut each conversation before the shuffle; the older
    part is what remains, without ranking it.
    """
    talk = messages.filter(F.col("role").isin("user", "assistant"))
    order = Window.partitionBy("conversation_id").orderBy(F.desc("message_id"))
    last = talk.select("conversation_id", "message_id").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    marked = last.select("conversation_id", "message_id", F.lit(True).alias("_recent"))
    return talk.join(marked, ["conversation_id", "message_id"], "left").withColumn(
        "part", F.when(F.col("_recent"), "recent").otherwise("older")
    ).drop("_recent")


def fold_summary_input(messages: DataFrame, *, keep: int = KEEP, max_chars: int = MAX_CHARS) -> DataFrame:
    """(conversation_id, input): the older part in order with role names, an earlier
    summary first, and of all that the last ``max_chars`` characters.

    Every message has at least a character, so the last ``max_chars`` older messages
    hold all that can remain; those within the limit are collected, no more.
    """
    older = keep_recent_messages(messages, keep).filter(F.col("part") == "older")
    name = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    lines = older.select("conversation_id", "message_id", F.concat(name, F.lit(": "), "content", F.lit("\n")).alias("line"))
    back = Window.partitionBy("conversation_id").orderBy(F.desc("message_id"))
    near = lines.withColumn("place", F.row_number().over(back)).filter(F.col("place") <= max_chars)
    before = F.coalesce(
        F.sum(F.length("line")).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    used = near.withColumn("_after", before).filter(F.col("_after") < max_chars)
    text = used.groupBy("conversation_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("message_id", "line"))), lambda m: m["line"]), "").alias("talk")
    )
    summary = (
        messages.filter(F.col("agent_id") == SUMMARY_MARK)
        .groupBy("conversation_id")
        .agg(F.min_by("content", "message_id").alias("summary"))
    )
    head = F.when(F.col("summary").isNotNull(), F.concat(F.lit("Previous context: "), "summary", F.lit("\n\n"))).otherwise("")
    return text.join(summary, "conversation_id", "left").select(
        "conversation_id", F.right(F.concat(head, "talk"), F.lit(max_chars)).alias("input")
    )
