"""Rows -> JSON messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import iso_text


def event_messages(df: DataFrame) -> DataFrame:
    """One JSON message per row of ``app.events``: NULL fields are kept as JSON
    ``null`` (Spark drops them by default), the payload is a JSON *string* inside the
    message, and ``created_at`` is ISO-8601 text as Python's ``isoformat`` prints it."""
    msg = F.struct(
        F.col("event_id"), F.col("user_id"), F.col("event_type"),
        F.col("payload").cast("string").alias("payload"),
        iso_text(F.col("created_at")).alias("created_at"))
    return df.select(F.to_json(msg, {"ignoreNullFields": "false"}).alias("value"))


def publish_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Batch publish of a ``value`` column (connector package from the session config)."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
