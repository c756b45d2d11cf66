"""Items of a message archive: its messages joined with their sources, conversations, senders and bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLE_CHARS = 60


def title(subject: Column, who: Column, text: Column) -> Column:
    """A message's subject, else who wrote it and how it begins."""
    begin = F.left(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit(TITLE_CHARS))
    own = F.trim(F.coalesce(subject, F.lit("")))
    return F.when(own != "", own).otherwise(F.concat(F.coalesce(who, F.lit("?")), F.lit(": "), begin))


def participants(messages: DataFrame, recipients: DataFrame, conversation_members: DataFrame) -> DataFrame:
    """(conversation_id, participant_id): all that are known of a conversation, from any of the three tables, once."""
    sent = messages.select("conversation_id", F.col("sender_id").alias("participant_id"))
    got = messages.select("conversation_id", "message_id").join(recipients, "message_id").select("conversation_id", "participant_id")
    return sent.union(got).union(conversation_members.select("conversation_id", "participant_id")).where("participant_id is not null").distinct()


def message_items(messages: DataFrame, sources: DataFrame, conversations: DataFrame, people: DataFrame, bodies: DataFrame) -> DataFrame:
    """Messages that are not deleted, as items; sender and body may be missing, source and conversation may not.

    Sources and conversations are joined as they come: Spark broadcasts them if they are small.
    """
    rows = messages.where("deleted_at is null").join(sources, "source_id").join(conversations, "conversation_id")
    rows = rows.join(people.select(F.col("participant_id").alias("sender_id"), F.col("name").alias("sender")), "sender_id", "left").join(bodies, "message_id", "left")
    return rows.select(
        F.concat_ws(":", "source_type", F.col("message_id").cast("string")).alias("item_id"), "source_type", title(F.col("subject"), F.coalesce("sender", "conversation"), F.col("body")).alias("title"), "sender", "conversation", "body", "sent_at"
    )
