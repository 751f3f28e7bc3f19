"""Latency of streamed answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer_latency(events: DataFrame, idle: str = "10 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Seconds to the first token (the total when there is none) and in total, per answer.

    ``events``: answer_id, ts, kind (request, token, done, ...). Over a stream an
    answer is over when it was quiet for ``idle``; over a table every event counts.
    """
    keys = ["answer_id"]
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
        keys.append(F.session_window("ts", idle).alias("span"))
    at = F.col("ts").cast("timestamp").cast("double")
    start = F.min(F.when(F.col("kind") == "request", at))
    token = F.min(F.when(F.col("kind") == "token", at))
    last = F.max(F.when(F.col("kind").isin("token", "done"), at))
    spans = events.groupBy(*keys).agg(start.alias("start"), token.alias("token"), last.alias("last"))
    total = F.greatest(F.col("last") - F.col("start"), F.lit(0.0))
    return spans.filter("start is not null and last is not null").select(
        "answer_id",
        F.when(F.col("token").isNull(), total)
        .otherwise(F.greatest(F.col("token") - F.col("start"), F.lit(0.0)))
        .alias("first_token_latency"),
        total.alias("total_latency"),
    )
