"""Conversation history on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import conversations as cv
from lexweave.plans.registry import Inputs, query


def _messages(t: Inputs):
    return t.conversations.select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("message_id"), "role", F.col("text").alias("content"),
        F.when(F.col("role") == "system", "summary").alias("agent_id"),
    )


@query("keep_recent_messages", "W6", """
    SELECT conv_id AS conversation_id, turn AS message_id,
      CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2 THEN 'recent' ELSE 'older' END AS part
    FROM conversations WHERE role IN ('user', 'assistant')""")
def keep_recent_messages(t: Inputs):
    return cv.keep_recent_messages(_messages(t), 2).select("conversation_id", "message_id", "part")


@query("fold_summary_input", "W7", """
    WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant')),
    o AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text || chr(10), '' ORDER BY turn) AS talk FROM m WHERE back > 2 GROUP BY 1),
    s AS (SELECT conv_id, arg_min(text, turn) AS summary FROM conversations WHERE role = 'system' GROUP BY 1)
    SELECT o.conv_id AS conversation_id, sha256(right(CASE WHEN summary IS NULL THEN '' ELSE 'Previous context: ' || summary || chr(10) || chr(10) END || talk, 700)) AS input
    FROM o LEFT JOIN s ON s.conv_id = o.conv_id""")
def fold_summary_input(t: Inputs):
    out = cv.fold_summary_input(_messages(t), keep=2, max_chars=700)
    return out.select("conversation_id", F.sha2("input", 256).alias("input"))
