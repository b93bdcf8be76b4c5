"""Chat exports turned into document text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Message kinds that carry text, and the marker of system notices.
NORMAL_MESSAGE = 0
RICH_MESSAGE = 24
SYSTEM_MARK = "[系统消息]"


def chat_lines(messages: DataFrame) -> DataFrame:
    """Keep text messages as ``account:content`` lines (doc_id, pos, line)."""
    kept = (
        ((F.col("type") == NORMAL_MESSAGE) & ~F.contains(F.col("content"), F.lit(SYSTEM_MARK)))
        | (F.col("type") == RICH_MESSAGE)
    )
    return messages.filter(kept).select(
        "doc_id", "pos",
        F.concat(F.col("account"), F.lit(":"), F.col("content")).alias("line"),
    )


def join_rows(rows: DataFrame, key: str, pos: str, text: str, sep: str) -> DataFrame:
    """Join a document's ordered rows into its text; a document is one cell, whatever its length."""
    return (
        rows.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).alias("_rows"))
        .select(key, F.array_join(F.transform("_rows", lambda r: r.t), sep).alias(text))
    )


def chat_export_to_text(messages: DataFrame) -> DataFrame:
    return join_rows(chat_lines(messages), "doc_id", "pos", "line", "\n").withColumnRenamed("line", "text")
