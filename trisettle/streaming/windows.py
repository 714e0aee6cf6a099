"""Windows over an event stream; the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Counts and sums by window and type; ``late`` is the watermark of a stream."""
    if late:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Runs of a user's events less than ``gap`` apart."""
    if late:
        events = events.withWatermark("ts", late)
    rows = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return rows.select("user_id", "start", "last", "n")


def ingest_once(stream: DataFrame, key: str, late: str = "6 days") -> DataFrame:
    """Rows of a stream once by key; keys are remembered for as long as matching looks back."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def matched_within(credits: DataFrame, books: DataFrame, days: int = 3) -> DataFrame:
    """Bank credits with book rows of the same reference at most ``days`` days apart. As streams both sides wait twice
    as long as a match may reach, so that their state is bounded; nothing later than that can match."""
    late = f"{2 * days} days"
    a = credits.withWatermark("ts", late).select(F.col("utr").alias("a_utr"), F.col("ts").alias("a_ts"), F.col("event_id").alias("credit_id"))
    b = books.withWatermark("ts", late).select(F.col("utr").alias("b_utr"), F.col("ts").alias("b_ts"), F.col("event_id").alias("book_id"))
    near = F.expr(f"a_utr = b_utr AND b_ts BETWEEN a_ts - INTERVAL {days} DAYS AND a_ts + INTERVAL {days} DAYS")
    return a.join(b, near).select(F.col("a_utr").alias("utr"), "credit_id", "book_id", F.date_diff(F.to_date("b_ts"), F.to_date("a_ts")).alias("shift_days"))
