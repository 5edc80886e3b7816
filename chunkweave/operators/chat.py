"""Conversations: which turns are kept, and how a turn's answer is put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.text import parse_structured


def history(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of user and assistant turns; others are internal."""
    return turns.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", "text")


def answers(replies: DataFrame) -> DataFrame:
    """``id, response, result_count, search_suggestions, collection_title`` of one turn each.

    ``replies(id, text, result_count)``: the model's text and, where the retriever ran, the number of
    its results (else null). A structured answer gives the message; any other text is the response.
    """
    rows = replies.withColumn("s", parse_structured("text"))
    ran = F.col("result_count").isNotNull()
    none = F.array().cast("array<string>")
    return rows.select(
        "id",
        F.when(F.col("s").isNull(), F.col("text")).otherwise(F.coalesce("s.message", F.when(ran, F.lit("")).otherwise(F.col("text")))).alias("response"),
        "result_count",
        F.when(ran, F.coalesce("s.search_suggestions", none)).otherwise(none).alias("search_suggestions"),
        F.when(ran, F.coalesce("s.collection_title_suggestion", F.lit(""))).otherwise(F.lit("")).alias("collection_title"),
    )
