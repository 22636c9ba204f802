"""Conversations: owner checks, recency and character budget, formatting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.config import DEFAULTS, ROLE_NAMES, Settings
from corpuslake.operators import ranking


def completed(messages: DataFrame) -> DataFrame:
    """Only these messages enter a history or a prompt."""
    return messages.where(F.col("status") == "completed")


def messages_for(
    requests: DataFrame, conversations: DataFrame, messages: DataFrame, limit: int
) -> DataFrame:
    """Newest completed messages of requested conversations, owner-checked.

    ``requests`` has conversation_id and the asking user_id; a request for
    somebody else's conversation yields nothing.
    """
    owned = requests.distinct().join(conversations, ["conversation_id", "user_id"], "left_semi")
    mine = completed(messages).join(owned, "conversation_id")
    return ranking.top_k(
        mine, ["user_id", "conversation_id"], [F.desc("turn")], limit, out="age"
    )


def conversations_of(users: DataFrame, conversations: DataFrame) -> DataFrame:
    """Conversations of the given users, newest first."""
    return conversations.join(users, "user_id", "left_semi").orderBy(
        "user_id", F.desc("updated_at"), "conversation_id"
    )


def conversation_detail(
    requests: DataFrame, conversations: DataFrame, messages: DataFrame
) -> DataFrame:
    """All messages of owned conversations in time order, as rows: a long
    conversation stays spread over partitions."""
    owned = requests.distinct().join(conversations, ["conversation_id", "user_id"], "left_semi")
    return messages.join(owned, "conversation_id").orderBy("conversation_id", "turn")


def trim(
    messages: DataFrame, settings: Settings = DEFAULTS, exclusive: bool = False
) -> DataFrame:
    """Last completed messages within the character budget, newest first.

    Each text counts and is cut to at most the budget. The running sum never
    falls, so filtering it equals stopping at the first overflow. With
    ``exclusive`` the newest message, the question itself, is left out.
    """
    limit = settings.max_history_messages + int(exclusive)
    recent = ranking.top_k(
        completed(messages), ["conversation_id"], [F.desc("turn")], limit, out="age"
    )
    if exclusive:
        recent = recent.where("age > 0")
    budget = settings.history_total_chars
    text = F.substring(F.coalesce("text", F.lit("")), 1, budget)
    newest_first = Window.partitionBy("conversation_id").orderBy(F.desc("turn")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        recent.withColumn("text", text)
        .withColumn("running_chars", F.sum(F.length("text")).over(newest_first))
        .where(F.col("running_chars") <= budget)
    )


def format_history(trimmed: DataFrame) -> DataFrame:
    """``role: text`` lines of each conversation, oldest first, in one string."""
    role = F.col("role")
    for name, label in ROLE_NAMES:
        role = F.when(F.col("role") == name, F.lit(label)).otherwise(role)
    line = F.concat(role, F.lit(": "), F.col("text"))
    return trimmed.groupBy("conversation_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))),
                lambda item: item["line"],
            ),
            "\n",
        ).alias("history")
    )
