"""Incremental change history as a stream.

An extension: batches of the history are joined as they come, where the batch
operator ``merge_history`` unites two tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_events(stream: DataFrame, window_days: int = 90) -> DataFrame:
    """Each change event once; ids are remembered for the window, later events are dropped."""
    return stream.withWatermark("occurred_at", f"{window_days} days").dropDuplicatesWithinWatermark(["id"])


def weekly_activity(stream: DataFrame, late_days: int = 7) -> DataFrame:
    """Changed lines, changes and (approximate) authors of each unit and ISO week, once the week is over."""
    weeks = F.window("occurred_at", "7 days", startTime="4 days").alias("week")  # 1970-01-05 was a Monday
    rows = stream.withWatermark("occurred_at", f"{late_days} days").groupBy(weeks, "unit")
    return rows.agg(F.sum("lines").alias("lines"), F.count("*").alias("changes"), F.approx_count_distinct("author").alias("authors")).select(F.col("week.start").alias("week"), "unit", "lines", "changes", "authors")
