"""Row-local operators over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions import chat
from granary.functions import text as T


def verdicts(documents: DataFrame, rules: T.FilterRules | None = None) -> DataFrame:
    """The text filter over a stream of documents (text, ...): no state, so rows pass as they come."""
    return T.with_verdict(documents, rules)


def routes(conversations: DataFrame, rules: chat.ChatRules | None = None) -> DataFrame:
    """The conversation rules over a stream of rows with messages."""
    return conversations.withColumn("reasons", chat.reasons(F.col("messages"), rules)).withColumn("route", chat.route(F.col("messages"), rules))


def distinct_conversations(conversations: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """A stream without conversations that came before within the delay, by their normalised hash; the watermark bounds what is remembered."""
    keyed = conversations.withColumn("digest", chat.full_hash(chat.normal_parts("messages")))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])
